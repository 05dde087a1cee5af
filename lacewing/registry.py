"""Registry of queries: name, builder over the driver's tables, and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one folder by attribute: ``t.orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``, with its oracle if there is one."""

    def keep(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return build

    return keep


def sql_case(mapping: dict[str, str], column: str, default: str) -> str:
    """A CASE expression for a mapping of strings."""
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + f" else {default} end"
