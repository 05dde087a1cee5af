"""Merging triples with provenance, and contradictions between merged triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V

KEY = ("head", "relation", "tail")


def quality(c: Column, k: Column, r: Column) -> Column:
    return F.lit(0.5) * c + F.lit(0.25) * k + F.lit(0.25) * r


def merge_triples(triples: DataFrame, threshold: float = 0.6, key: tuple[str, ...] = KEY) -> DataFrame:
    """Group by key: averages over rows, evidence over distinct articles, bonus of 0.03 a further article up to 0.10.

    ``triples`` has article and the scores c, r, k in hundredths.  Averages and the
    distinct count need one shuffle on the key; rows are combined before it.
    """
    pre = triples.groupBy(*key, "article").agg(F.count("*").alias("n"), *(F.sum(s).alias(s) for s in "crk"))
    g = pre.groupBy(*key).agg(F.sum("n").alias("members"), F.count("*").alias("evidence"), *(F.sum(s).alias(s) for s in "crk"), F.array_sort(F.collect_list("article")).alias("articles"))
    mean = {s: F.col(s) / F.col("members") / F.lit(100.0) for s in "crk"}
    conf = F.least(mean["c"] + F.least((F.col("evidence") - 1) * F.lit(0.03), F.lit(0.10)), F.lit(1.0))
    g = g.withColumns({"confidence": conf, "relevance": mean["r"], "clarity": mean["k"]}).drop(*"crk")
    return g.where(quality(F.col("confidence"), F.col("clarity"), F.col("relevance")) >= threshold)


def contradiction_pairs(spark, pairs=V.CONTRADICTIONS) -> DataFrame:
    """Both orders of the (constant, small) pairs."""
    return spark.createDataFrame([*pairs, *((b, a) for a, b in pairs)], "relation string, opposite string")


def contradictions(merged: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of merged triples of equal ends with contradicting relations; each pair once.

    The join is on both ends and the relation, never on the ends alone, so ends with
    many relations do not multiply.
    """
    left = merged.join(F.broadcast(pairs), "relation")
    right = merged.select("head", "tail", F.col("relation").alias("opposite"), F.col("confidence").alias("confidence2"), F.col("evidence").alias("evidence2"))
    return left.join(right, ["head", "tail", "opposite"]).where(F.col("relation") < F.col("opposite"))


def resolve(pairs: DataFrame) -> DataFrame:
    """Deterministic default arbiter: higher evidence, then higher confidence wins; a tie keeps both."""
    better = lambda a, b: (F.col(f"evidence{a}") > F.col(f"evidence{b}")) | ((F.col(f"evidence{a}") == F.col(f"evidence{b}")) & (F.col(f"confidence{a}") > F.col(f"confidence{b}")))
    return pairs.withColumn("decision", F.when(better("", "2"), "KEEP_A").when(better("2", ""), "KEEP_B").otherwise("KEEP_BOTH"))


def canonical_names(triples: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """A name through ``mapping`` (name, canonical); itself where it has none."""
    m = mapping.select(F.col("name").alias(column), "canonical")
    return triples.join(m, column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical")


def resolve_in_order(pairs: DataFrame, group: str = "component") -> DataFrame:
    """Arbitration in order of ``seq`` within each connected group: a pair is skipped if either side was rejected before.

    The order matters within a group only, so each group is folded on its own.
    """

    def fold(pdf):
        gone, out = set(), []
        for row in pdf.sort_values("seq").itertuples():
            if row.a in gone or row.b in gone:
                out.append("SKIPPED")
                continue
            out.append(row.decision)
            if row.decision == "KEEP_A":
                gone.add(row.b)
            elif row.decision == "KEEP_B":
                gone.add(row.a)
        pdf = pdf.sort_values("seq").copy()
        pdf["outcome"] = out
        return pdf[["seq", "a", "b", "outcome"]]

    return pairs.groupBy(group).applyInPandas(fold, "seq bigint, a string, b string, outcome string")
