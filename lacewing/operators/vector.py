"""Vectors as arrays of doubles: exact scores, top-k and clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

DIM_BLOCK = 4096
QUERIES, ROWS = 256, 2048
BLOCK, TILE = 4096, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalize(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def doubles(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("array<double>"))


def half_up(x: np.ndarray) -> np.ndarray:
    """Whole numbers, halves away from zero, as SQL rounds."""
    import numpy as np

    return np.copysign(np.floor(np.abs(x) + 0.5), x)


class Side(NamedTuple):
    """Rows of one block: ids, unit vectors (zeros where there is none), lengths (-1: null or with a null component)."""

    ids: np.ndarray
    unit: np.ndarray
    sizes: np.ndarray


def _side(t: pa.Table) -> Side:
    import numpy as np

    column = t.column("x").combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(-1)).astype(np.int64)
    flat, rows = column.flatten(), np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    at = np.arange(len(rows)) - np.repeat(np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), np.maximum(sizes, 0))
    x = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)))
    x[rows, at] = flat.to_numpy(zero_copy_only=False)
    sizes[rows[np.asarray(flat.is_null())]] = -1
    x[sizes < 0] = 0
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return Side(np.asarray(t.column("id")), x / np.where(n == 0, 1, n), sizes)


def tiles(one: Side, two: Side) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray | None]]:
    """Cosines of two blocks, some rows and columns at a time, and which of them are known (None: all)."""
    import numpy as np

    wide = max(one.unit.shape[1], two.unit.shape[1])
    u, v = (np.pad(s.unit, ((0, 0), (0, wide - s.unit.shape[1]))) for s in (one, two))
    even = len(np.union1d(one.sizes, two.sizes)) == 1 and one.sizes[0] >= 0
    for i in range(0, len(u), TILE):
        for j in range(0, len(v), TILE):
            a, b = slice(i, i + TILE), slice(j, j + TILE)
            yield a, b, u[a] @ v[b].T, None if even else (one.sizes[a, None] == two.sizes[None, b]) & (one.sizes[a, None] >= 0)


def block_pairs(left: DataFrame, right: DataFrame | None, run: Callable[[object, Side, Side, bool], Iterator[dict]], schema: str, block: int = BLOCK) -> DataFrame:
    """What ``run`` makes of all pairs of rows (k, id, x) of ``left`` and ``right`` with the same k, by pairs of blocks.

    A key is cut into blocks of about ``block`` rows by hashes of the ids, and each pair of blocks
    is a group of its own: no task holds more than two blocks, and a large key goes to many tasks.
    Without ``right`` each pair of blocks of ``left`` is met once; ``run`` is told of a block that meets itself.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    half = right is None

    def blocks(df, n):
        return df.where("k is not null").groupBy("k").agg(F.ceil(F.count("*") / block).cast("int").alias(n))  # a row for each key

    sizes = blocks(left, "n1")
    sizes = sizes.withColumn("n2", F.col("n1")) if half else sizes.join(blocks(right, "n2"), "k")

    def dealt(df, n):
        return df.join(F.broadcast(sizes), "k").withColumn("b", F.pmod(F.xxhash64("id"), F.col(n).cast("bigint")).cast("int"))

    one = dealt(left, "n1").withColumn("j", F.explode(F.sequence(F.col("b") if half else F.lit(0), F.col("n2") - 1)))
    two = dealt(left if half else right, "n2").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b") if half else F.col("n1") - 1)))
    rows = one.selectExpr("k", "b as i", "j", "0 as side", "id", "x").unionByName(two.where("i <> b" if half else "true").selectExpr("k", "i", "b as j", "1 as side", "id", "x"))

    def both(t: pa.Table) -> pa.Table:
        k, same = t.column("k")[0], half and t.column("i")[0] == t.column("j")[0]
        a, b = (_side(t.filter(pc.equal(t.column("side"), n))) for n in (0, 0 if same else 1))
        if not len(a.ids) or not len(b.ids):
            return empty
        out = [pa.table([pa.array(x[f.name], f.type, from_pandas=False) for f in empty.schema], empty.schema) for x in run(k.as_py(), a, b, same)]
        return pa.concat_tables(out) if out else empty

    return rows.repartition("k", "i", "j").groupBy("k", "i", "j").applyInArrow(both, schema)


def extremes(df: DataFrame) -> DataFrame:
    """(k, least, most): of the cosines of all pairs of rows (k, id, x) with equal k and different ids; no row for a key without."""

    def run(k, one: Side, two: Side, same: bool) -> Iterator[dict]:
        import numpy as np

        found = []
        for a, b, s, known in tiles(one, two):
            if same:
                apart = one.ids[a, None] != two.ids[None, b]
                known = apart if known is None else known & apart
            s = s if known is None else s[known]
            if s.size:
                found += [s.min(), s.max()]
        if found:
            yield {"k": [k], "least": [np.min(found)], "most": [np.max(found)]}

    parts = block_pairs(df, None, run, f"k {df.schema['k'].dataType.simpleString()}, least double, most double")
    return parts.groupBy("k").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def pair_counts(df: DataFrame) -> DataFrame:
    """(k, pairs): pairs of rows (k, id) with equal k and id < id; no row for a key without."""
    n = df.where("k is not null and id is not null").groupBy("k", "id").agg(F.count("*").alias("m")).groupBy("k").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("own"))
    return n.select("k", ((F.col("n") * F.col("n") - F.col("own")) / 2).cast("bigint").alias("pairs")).where("pairs > 0")


def pair_cosines(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, score): cosine of each pair of rows (k, id, x) of the two sides with equal k and different ids; null without vectors of one length."""

    def run(k, one: Side, two: Side, same: bool) -> Iterator[dict]:
        import numpy as np
        import pyarrow as pa

        for a, b, s, known in tiles(one, two):
            ids, others = one.ids[a], two.ids[b]
            apart = ids[:, None] != others[None, :]
            i, j = np.nonzero(apart)
            unknown = None if known is None else ~known[apart]
            yield {"a": ids[i], "b": others[j], "score": pa.array(s[apart], mask=unknown)}

    return block_pairs(left, right, run, "a bigint, b bigint, score double")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_rows: int = DIM_BLOCK, places: int | None = None) -> DataFrame:
    """Exact cosine top-k of each query (q, qv) over the corpus (id, v): q, id, score, rank.

    A stated query set is taken in blocks of ``query_rows`` vectors.  Each block is
    sent to the corpus partitions as one matrix; a partition returns its k best for
    each query, so what is shuffled is k rows a query and partition.  Scores are
    computed in doubles and, if asked, rounded to ``places``; equal scores rank by id.
    A worker holds the scores of ``QUERIES`` queries and ``ROWS`` rows at a time.
    """
    import numpy as np
    import pyarrow as pa

    spark = corpus.sparkSession
    scale = None if places is None else 10.0**places
    margin = 0.0 if places is None else 0.51 / scale
    parts = []
    last = None
    while True:
        more = queries.where(F.col("q") > last) if last is not None else queries
        block = more.orderBy("q").limit(query_rows).collect()
        if not block:
            break
        last = block[-1].q
        qm = np.array([r.qv for r in block], float)
        qm = qm / np.maximum(np.linalg.norm(qm, axis=1, keepdims=True), 1e-12)
        held = spark.sparkContext.broadcast((np.array([r.q for r in block], np.int64), qm))

        def run(batches, held=held):
            ids, m = held.value
            # rows not met yet stand at the end: no score, the largest id
            best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
            best = np.full((len(ids), k), -np.inf)
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    x = np.asarray(part.column(1).flatten(), float).reshape(part.num_rows, -1)
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    own = np.asarray(part.column(0))
                    for q in range(0, len(ids), QUERIES):
                        score = m[q : q + QUERIES] @ x.T
                        score[np.isnan(score)] = -np.inf
                        hot = np.flatnonzero(score.max(1) >= best[q : q + QUERIES, -1] - margin)
                        if not len(hot):
                            continue
                        score = score[hot] if scale is None else half_up(score[hot] * scale) / scale
                        hot += q
                        score = np.hstack([best[hot], score])
                        known = np.hstack([best_id[hot], np.broadcast_to(own, (len(hot), len(own)))])
                        if score.shape[1] > k:  # at the k-th score ids decide, so all of that score are kept for the sort
                            least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                            wide = int((score >= least).sum(1).max())
                            pick = np.argpartition(-score, min(wide, score.shape[1]) - 1, axis=1)[:, :wide]
                            score, known = np.take_along_axis(score, pick, 1), np.take_along_axis(known, pick, 1)
                        order = np.lexsort((known, -score), axis=1)[:, :k]
                        best[hot], best_id[hot] = np.take_along_axis(score, order, 1), np.take_along_axis(known, order, 1)
            met = best > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, met.sum(1))), pa.array(best_id[met]), pa.array(best[met])], ["q", "id", "score"])

        parts.append(corpus.select("id", "v").mapInArrow(run, "q bigint, id bigint, score double"))
    if not parts:
        return spark.createDataFrame([], "q bigint, id bigint, score double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def centroid(df: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """(key, pos, mean): sums of whole billionths, so the order of rows does not matter."""
    d = df.select(key, F.posexplode(column).alias("pos", "x"))
    return d.groupBy(key, "pos").agg((F.sum(F.round(F.col("x") * 1e9).cast("bigint")) / F.count("*") / 1e9).alias("mean"))
