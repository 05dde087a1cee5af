"""Referential checks of article graphs and n-ary edges, as anti joins united into one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {"missing_treatment": "TREATMENT", "missing_outcome": "OUTCOME"}  # fixed values: roles each edge needs


def missing(rows: DataFrame, key: str, known: DataFrame, known_key: str, owner: str, error: str) -> DataFrame:
    """(owner, error, item) of the rows whose key is not known."""
    k = known.select(F.col(known_key).alias("_k")).distinct()
    return rows.join(k, F.col(key) == F.col("_k"), "left_anti").select(F.col(owner).alias("owner"), F.lit(error).alias("error"), F.col(key).cast("string").alias("item"))


def failing(rows: DataFrame, bad: Column, owner: str, error: str, item: str) -> DataFrame:
    return rows.where(bad).select(F.col(owner).alias("owner"), F.lit(error).alias("error"), F.col(item).cast("string").alias("item"))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks).distinct()


def statuses(owners: DataFrame, errors: DataFrame, warnings: DataFrame) -> DataFrame:
    """(owner, errors, warnings, status): FAIL with an error, WARN with a warning, else PASS."""
    e = errors.groupBy("owner").agg(F.count("*").alias("errors"))
    w = warnings.groupBy("owner").agg(F.count("*").alias("warnings"))
    d = owners.select("owner").distinct().join(e, "owner", "left").join(w, "owner", "left").na.fill(0, ["errors", "warnings"])
    return d.withColumn("status", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("PASS"))
