"""Command line: list queries, run one and write its rows, or print its plan.

    python -m lacewing.cli list
    python -m lacewing.cli run agg_merge_triples --data DIR [--out DIR --format json]
    python -m lacewing.cli explain agg_merge_triples --data DIR
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults of a run."""

    app: str = "lacewing"
    format: str = "parquet"
    time_zone: str = "UTC"


def session(settings: Settings):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(settings.app).config("spark.sql.session.timeZone", settings.time_zone).getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lacewing")
    p.add_argument("command", choices=["list", "run", "explain"])
    p.add_argument("query", nargs="?")
    p.add_argument("--data")
    p.add_argument("--out")
    p.add_argument("--format", default=Settings.format, choices=["parquet", "json", "csv"])
    a = p.parse_args(argv)
    from .catalog import QUERIES

    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if a.query not in QUERIES or not a.data:
        p.error("an existing query and --data are needed")
    df = QUERIES[a.query](session(Settings(format=a.format)), a.data)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").format(a.format).save(a.out)
    else:
        df.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
