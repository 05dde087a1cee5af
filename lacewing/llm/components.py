"""Connected components and id filters by DataFrame steps of bounded driver memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

FILTER_BITS = 25


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Large-star and small-star steps in turn: every node links its larger neighbours,
    then itself and its smaller ones, to the smallest of them, until each component
    is a star around its root.  Rounds go with the square of the logarithm of the
    number of nodes at most.  Every round is a table; nothing of the graph reaches
    the driver but a count and a sum.
    """
    def distinct(e):
        e = e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return e.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")

    def sign(e):
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())

    live = work.cut(distinct(edges), f"{name}-edges0")
    before, k = None, 0
    while (now := sign(live)) != before:
        before, k = now, k + 1
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = work.cut(distinct(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))), f"{name}-large{k}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        live = work.cut(distinct(small), f"{name}-edges{k}")
        work.drop(f"{name}-large{k}", f"{name}-edges{k - 1}")
    tops = live.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("root"))
    return live.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops)


class IdFilter:
    """A one-hash Bloom filter of 64-bit ids: a fixed number of bits, whatever the ids.

    Bits are gathered by an aggregation to at most 2**FILTER_BITS / 64 words, so
    the driver gets 4 MB at most.  ``test`` never misses an id; others pass as often
    as bits are set, and the caller joins what passed exactly.
    """

    def __init__(self, ids: DataFrame):
        slots = ids.select(self.slot("id").alias("s")).selectExpr("shiftright(s, 6) as w", "shiftleft(1L, cast(s % 64 as int)) as b")
        words = slots.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        self.bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        self.bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)

    def test(self, slots: np.ndarray) -> np.ndarray:
        return (self.bits[slots >> 6] >> (slots & 63)) & 1 == 1

    @staticmethod
    def slot(column: str | Column) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        return F.when(c.isNotNull(), F.pmod(F.xxhash64(c.cast("bigint")), F.lit(1 << FILTER_BITS)))

    def split(self, rows: DataFrame, key: str | Column) -> dict[bool, DataFrame]:
        """The rows whose key can be one of the ids (True), and the others; null keys are others."""
        held = rows.sparkSession.sparkContext.broadcast(self)
        tagged = rows.withColumn("_slot", F.coalesce(self.slot(key), F.lit(-1)))

        def part(wanted):
            def run(batches):
                for b in batches:
                    slot = np.asarray(b.column(b.num_columns - 1))
                    hit = (slot >= 0) & held.value.test(np.maximum(slot, 0))
                    yield b.filter(pa.array(hit == wanted)).select(list(range(b.num_columns - 1)))

            return tagged.mapInArrow(run, rows.schema)

        return {wanted: part(wanted) for wanted in (False, True)}
