"""Exact top-k inner products by the threshold algorithm over sorted lists.

Vectors become whole numbers, floor(scale * x).  Candidates are held in blocks;
in a block every dimension has a list of its rows in order of value.  A query
walks the lists of its components near the largest (within NEAR_LARGEST) at once,
from the end that each component favours.  Rows met for the first time are scored in
full (random access).  A row not met yet has no more in a dimension than the value
that its list has come to, and no longer vector than the longest of the block; the
largest product under both limits (``bound``) ends the walk once it is below the k-th
best score so far.  Equal scores go to the smaller id, so a walk goes on while the
bound equals the k-th score.

The bound stops a walk early where the k best are much nearer than the rest, as in
clustered vectors.  In a block of unit vectors without structure no bound of this kind
can: the best of many random products is well below what sorted lists allow.

The k-th score a query has in one small block of fixed size (``SEED_ROWS``), found in a
pass over the queries, is given to all other blocks as a starting bound; only rows that
can be among the k best leave a block.

Queries are taken in blocks of at most ``QUERY_ROWS`` vectors; what is broadcast
is one block.  Scores are exact in 64-bit integers; components so large that products
leave 64 bits have no defined score.

Null vectors and vectors with null or non-finite components take no part; vectors
of another length than the query's are no candidates for it.  Rows of one id are
one vector: a query takes the smallest of them, a candidate counts once with its
best score, and none of them is a candidate for its own id.  A null id is no
query and no candidate.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace, ship

QUERY_ROWS = 32_768
SEED_ROWS = 4_096
BLOCK_ROWS = 32_768
DEPTH = 8
NEAR_LARGEST = 1.2


def bound(q: np.ndarray, caps: np.ndarray, longest: float) -> float:
    """The largest q . v (q > 0) of a v with v_d <= caps_d that is no longer than ``longest``.

    At the best v some dimensions are at their caps and all others in proportion to q.
    """
    plain = float(q @ caps)
    order = np.argsort(caps / q)
    q, caps = q[order], caps[order]
    rest = np.maximum(longest**2 - np.concatenate([[0], np.cumsum(caps * caps)[:-1]]), 0)
    slope = np.sqrt(rest / np.cumsum((q * q)[::-1])[::-1])  # of v on q, if the dimensions before are at their caps
    free = np.flatnonzero(slope <= caps / q)
    if not len(free) or (caps < 0).any():
        return plain
    k = free[0]
    return min(plain, float(q[:k] @ caps[:k] + slope[k] * (q[k:] @ q[k:])))


class Lists:
    """Rows of one block with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(rows, self.order, 0)
        self.largest = int(np.abs(rows).max(initial=1))
        self.longest = float(np.sqrt((rows.astype(float) ** 2).sum(1).max(initial=0)))
        self.scored = 0
        self.fast = rows.astype(np.float32) if self.largest < 1 << 16 else None

    def search(self, own: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the block's rows that can be among the k best."""
        n = len(self.rows)
        live = np.flatnonzero(q)
        strength = np.abs(q[live]).astype(float)
        up = q[live] > 0
        walked = strength * NEAR_LARGEST >= strength.max(initial=0)
        caps = np.where(up, self.values[n - 1, live], -self.values[0, live]).astype(float)
        met = np.zeros(n, bool)
        met[self.ids == own] = True
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kth = floor
        depth, step = 0, DEPTH
        while True:
            if depth >= n:
                break
            if depth and kth is not None and len(live):
                at = np.where(up[walked], n - 1 - depth, depth)
                caps[walked] = np.where(up[walked], 1, -1) * self.values[at, live[walked]]
                if bound(strength, caps, self.longest) * (1 + 1e-9) + 1e-3 < kth:
                    break
            end = min(n, depth + step)
            if len(live):
                span = np.arange(depth, end)
                heads = self.order[np.where(up[walked][None, :], (n - 1 - span)[:, None], span[:, None]), live[walked][None, :]].ravel()
            else:
                heads, end = np.arange(n), n
            fresh = np.zeros(n, bool)
            fresh[heads] = True
            fresh &= ~met
            met |= fresh
            new = np.flatnonzero(fresh)
            if len(new):
                self.scored += len(new)
                got = self.score(new, q)
                if kth is not None:
                    hit = got >= kth
                    new, got = new[hit], got[hit]
                ids, scores = np.concatenate([ids, self.ids[new]]), np.concatenate([scores, got])
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))
                    first = np.unique(ids[best], return_index=True)[1]
                    best = best[np.sort(first)][:k]
                    ids, scores = ids[best], scores[best]
                if len(np.unique(ids)) >= k:
                    low = int(np.sort(scores)[-k])
                    kth = low if kth is None else max(kth, low)
            depth, step = end, max(DEPTH, end // 2)
        return ids, scores

    def score(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.fast is not None and int(np.abs(q).max(initial=0)) * self.largest * len(q) < 1 << 24:  # whole numbers are exact there
            return (self.fast[rows] @ q.astype(np.float32)).astype(np.int64)
        return self.rows[rows] @ q


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id bigint, v array<bigint>) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size(v) > 0)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fit).select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of an array column as matrices, one for each length: places, values."""
    values = np.asarray(column.flatten())
    size = np.asarray(column.value_lengths())
    start = np.cumsum(size) - size
    return [(at := np.flatnonzero(size == d), values[start[at][:, None] + np.arange(d)]) for d in np.unique(size)]


def _query_blocks(q: DataFrame):
    last = None
    while True:
        more = q if last is None else q.where(F.col("id") > last)
        got = more.orderBy("id").limit(QUERY_ROWS).collect()
        if not got:
            return
        yield [(r.id, np.array(r.v, np.int64), r.floor) for r in got]
        last = got[-1].id


def with_floors(queries: DataFrame, seed: list, k: int) -> DataFrame:
    """The queries (id, v) with their k-th score among the seed rows; null if these are fewer."""
    by_size: dict[int, list] = {}
    for r in seed:
        by_size.setdefault(len(r.v), []).append((r.id, r.v))
    held = queries.sparkSession.sparkContext.broadcast({d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64)) for d, x in by_size.items()})

    def run(batches):
        seeds = {d: Lists(*x) for d, x in held.value.items()}
        for b in batches:
            floors: list[int | None] = [None] * b.num_rows
            ids = np.asarray(b.column(0))
            for at, v in _matrix(b.column(1)):
                if v.shape[1] in seeds:
                    for j, q in zip(at.tolist(), v, strict=True):
                        got, scores = seeds[v.shape[1]].search(int(ids[j]), q, k, None)
                        floors[j] = int(scores.min()) if len(got) == k else None
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(floors, pa.int64())], ["id", "v", "floor"])

    return queries.mapInArrow(run, "id bigint, v array<bigint>, floor bigint")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k best rows for each query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id bigint, vec_id bigint, score bigint"
    names = ["query_id", "vec_id", "score"]
    rows = whole(vectors, id_col, vector_col, scale)
    queries = whole(vectors.where(is_query), id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    seed = rows.orderBy(F.xxhash64("id"), "id").limit(SEED_ROWS).collect()
    work, parts = Workspace(spark, "topk"), []
    queries = work.cut(with_floors(queries, seed, k), "queries")
    for number, block in enumerate(_query_blocks(queries)):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            def answer(parts):
                for d, pieces in parts.items():
                    block = Lists(np.concatenate([i for i, _ in pieces]), np.concatenate([v for _, v in pieces]))
                    out = []
                    for own, q, floor in held.value:
                        if len(q) == d:
                            ids, scores = block.search(own, q, k, floor)
                            out.append((np.full(len(ids), own), ids, scores))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names)

            kept, size = {}, 0
            for b in batches:
                ids = np.asarray(b.column(0))
                for at, v in _matrix(b.column(1)):
                    for k0 in range(0, len(at), BLOCK_ROWS):
                        kept.setdefault(v.shape[1], []).append((ids[at[k0 : k0 + BLOCK_ROWS]], v[k0 : k0 + BLOCK_ROWS]))
                        size += len(at[k0 : k0 + BLOCK_ROWS])
                        if size >= BLOCK_ROWS:
                            yield from answer(kept)
                            kept, size = {}, 0
            yield from answer(kept)

        part = rows.mapInArrow(run, schema)
        if number:
            part = work.cut(part, f"block{number}")
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    found = reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
