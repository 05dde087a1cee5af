"""Entity linking and merge decisions: close names, nearest vectors, bands of similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector as VE

CLOSE = 0.92
LINK = 0.82
AUTO_MERGE, ASK_MERGE = 0.90, 0.78


def _segments(name: Column, cutoff: float) -> Column:
    """(length, text) of the pieces of a name of which one at least stands whole in every name close enough.

    Close names of lengths a and b leave at most (1 - cutoff) * (a + b) characters unmatched,
    and each run of those spoils one piece at most.
    """
    n = F.length(name)
    pieces = F.floor(F.lit(1 - cutoff) * (n + n * F.lit((2 - cutoff) / cutoff)) + 1e-9).cast("int") + 1

    def piece(i):
        start, end = F.floor(i * n / pieces).cast("int"), F.floor((i + 1) * n / pieces).cast("int")
        return F.struct((end - start).alias("size"), F.substring(name, start + 1, end - start).alias("piece"))

    return F.filter(F.transform(F.sequence(F.lit(0), pieces - 1), piece), lambda s: s["size"] > 0)


def fuzzy_link(mentions: DataFrame, names: DataFrame, mention: str = "mention", name: str = "name", cutoff: float = CLOSE) -> DataFrame:
    """(mention, name, ratio): for each distinct mention the closest name, if close enough.

    The ratio is that of difflib; of equal ratios the last name in order counts.  Candidates
    come from an equi join on pieces of the mention, which loses none; a name is cut into
    windows of the lengths that pieces have.
    """
    m = mentions.select(F.col(mention).alias("m")).where("m <> ''").distinct()
    d = names.select(F.col(name).alias("d")).where("d <> ''").distinct()
    keyed = m.withColumn("s", F.explode(_segments(F.col("m"), cutoff))).select("m", "s.size", "s.piece")
    sizes = keyed.select("size").distinct()  # a row for each length of a piece
    starts = F.sequence(F.lit(1), F.length("d") - F.col("size") + 1)
    windows = d.join(F.broadcast(sizes), F.length("d") >= F.col("size")).withColumn("piece", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("d"), i, F.col("size")))))).select("d", "size", "piece")
    near = F.lit(2.0) * F.least(F.length("m"), F.length("d")) >= F.lit(cutoff) * (F.length("m") + F.length("d"))
    pairs = keyed.join(windows, ["size", "piece"]).where(near).select("m", "d").distinct()

    def ratios(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for pdf in frames:
            yield pdf.assign(ratio=[SequenceMatcher(None, d, m).ratio() for m, d in zip(pdf["m"], pdf["d"], strict=True)])

    close = pairs.mapInPandas(ratios, "m string, d string, ratio double").where(F.col("ratio") >= cutoff)
    best = close.groupBy("m").agg(F.max(F.struct("ratio", "d")).alias("b"))
    return best.select(F.col("m").alias(mention), F.col("b.d").alias(name), F.col("b.ratio").alias("ratio"))


def dense_link(mentions: DataFrame, hits: DataFrame, threshold: float = LINK) -> DataFrame:
    """(q, candidates, best, linked, reason) from the ranked hits (q, id, score) of each mention (q)."""
    best = hits.groupBy("q").agg(F.count("*").alias("candidates"), F.max_by("id", F.struct("score", -F.col("id"))).alias("best"), F.max("score").alias("score"))
    enough = F.col("score") >= threshold
    reason = F.when(F.col("candidates").isNull(), "dense retrieval returned no candidates").when(~enough, "dense candidate below auto-link threshold")
    return mentions.select("q").join(best, "q", "left").select("q", F.coalesce("candidates", F.lit(0)).alias("candidates"), "best", F.when(enough, F.col("best")).alias("linked"), reason.alias("reason"))


def merge_outcome(score: Column, compatible: Column, verdict: Column) -> Column:
    """What becomes of a pair: merged at once, as the scorer's verdict says, for review, or nothing.

    ``verdict`` is the scorer's answer for pairs of the middle band (null: none came).
    """
    stated = F.when(verdict.isin("MERGE", "RELATED_TO", "DIFFERENT_SCOPE", "CONTRADICTS"), verdict).otherwise("REVIEW")
    return F.when((score >= AUTO_MERGE) & compatible, "MERGE").when(score >= ASK_MERGE, stated).otherwise("NONE")


def foremost(queries: DataFrame, corpus: DataFrame, decided: Callable[..., np.ndarray], places: int = 4) -> DataFrame:
    """(q, id, score): of each query (k, id, x), the rows of the corpus with equal k that can end its search.

    Every pair is scored, by pairs of blocks.  Of each block of the corpus the first pair in order
    of score that ``decided(score, q, id)`` holds for is kept; where there is none, any pair without its score.
    """
    scale = 10.0**places

    def run(k, one: VE.Side, two: VE.Side, same: bool) -> Iterator[dict]:
        import pyarrow as pa

        score, best = np.full(len(one.ids), -np.inf), np.full(len(one.ids), two.ids.min())
        for a, b, s, known in VE.tiles(one, two):
            s = VE.half_up(s * scale) / scale
            q, other = one.ids[a, None], two.ids[None, b]
            s = np.where(decided(s, q, other) & (True if known is None else known), s, -np.inf)
            top = s.max(1)
            own = np.where(s == top[:, None], other, np.iinfo(np.int64).max).min(1)
            better = (top > score[a]) | ((top == score[a]) & (top > -np.inf) & (own < best[a]))
            score[a], best[a] = np.where(better, top, score[a]), np.where(better, own, best[a])
        yield {"q": one.ids, "id": best, "score": pa.array(score, mask=score == -np.inf)}

    return VE.block_pairs(queries, corpus, run, "q bigint, id bigint, score double")


def first_decision(pairs: DataFrame) -> DataFrame:
    """(q, target, outcome): candidates of q in order of score; the first that is decided ends the search.

    ``pairs`` has q, id, score and outcome.  Without a decision the row is new.
    """
    order = F.struct((-F.col("score")).alias("s"), "id")
    decided = pairs.where("outcome in ('MERGE', 'RELATED_TO', 'DIFFERENT_SCOPE', 'CONTRADICTS')").groupBy("q").agg(F.min_by("id", order).alias("target"), F.min_by("outcome", order).alias("outcome"))
    rows = pairs.select("q").distinct().join(decided, "q", "left")
    return rows.select("q", F.when(F.col("outcome") == "MERGE", F.col("target")).alias("merged_into"), F.coalesce("outcome", F.lit("NEW")).alias("outcome"))
