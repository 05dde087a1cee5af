"""Sinks: JSON lines, partitioned stores, CSV splits and vector namespaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with keys in order of name."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def artefacts(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One folder of JSON lines for each table."""
    for name, df in tables.items():
        jsonl(df, f"{path}/{name}", mode)


def article_store(df: DataFrame, path: str, key: str = "article_id") -> None:
    """Append, one folder an article."""
    df.write.mode("append").partitionBy(key).parquet(path)


def csv_split(df: DataFrame, keep: Column, path: str) -> None:
    """``relevant``, ``rejected`` and ``full`` folders; null counts as rejected."""
    parts = {"relevant": df.where(keep), "rejected": df.where(~F.coalesce(keep, F.lit(False))), "full": df}
    for name, part in parts.items():
        part.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def vectors(df: DataFrame, path: str, namespace: str = "namespace") -> None:
    df.write.mode("overwrite").partitionBy(namespace).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, path: str) -> None:
    """All columns by key, new rows first; written to a new place, so ``old`` may be read from another."""
    cols = [c for c in old.columns if c != key]
    rows = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    rows.groupBy(key).agg(F.max_by(F.struct(*cols), "_s").alias("_v")).select(key, "_v.*").write.mode("overwrite").parquet(path)


def graph_store(*_args, **_kw) -> None:
    raise NotImplementedError("graph databases are not supported")
