"""Document quality by ordinal cumulative-link regression on graded ratings.

One shared weight for each hashed feature gives a score s; ordered thresholds
t1 < t2 < ... give P(grade >= j) = 1 / (1 + exp(t_j - s)).  From these come the
expected grade and the tail probability by which documents are selected.

Features of the whole text, each counted once: its words (A-Z lowered), the first BEGIN
bytes of its words without signs, so that words of one stem that are rare themselves
share a weight, and buckets of its shape (shares of upper-case, digit and other signs,
word length, share of distinct words).  In fitting a feature has as its value how far
the odds of the best grade move where it stands (absolute log ratio, one count added),
which keeps words that tell little from learning single documents by heart.

Fitting takes at most about ``bound`` rated documents, chosen by a hash of the
id; that is the only sample, every row is scored.

Null and empty texts have grade 0 expected, tail probabilities 0 and are not
kept.  Ratings with nulls are ignored; a document rated twice counts twice.
Without ratings nothing is known and every row with a word is kept.  Repeated
rows each get their own result; other columns are passed through as asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import Words, chunks, mix, strings
from .shared import ship

BITS = 18
GRADES = 3
BEGIN = 5
CUT = 0.5
_SIGN = np.zeros(256, bool)
_SIGN[:128] = [not chr(k).isalnum() for k in range(128)]


def _shape(data: np.ndarray, off: np.ndarray, w: Words, distinct: np.ndarray) -> np.ndarray:
    """Six buckets a row, as feature numbers."""
    def per_row(flags):
        run = np.concatenate([[0], np.cumsum(flags)])
        return run[off[1:]] - run[off[:-1]]

    size, count = np.maximum(np.diff(off), 1), w.counts()
    upper = per_row((data >= 65) & (data <= 90))
    digit = per_row((data >= 48) & (data <= 57))
    odd = per_row((data > 32) & (data < 127) & ~((data >= 48) & (data <= 57)) & ~((data | 32) >= 97) | (data == 124))
    shares = [upper / size, digit / size, odd / size]
    cols = [np.minimum(15, np.sqrt(s * 225)).astype(np.int64) for s in shares]
    cols.append(np.minimum(15, (per_row(data > 32) / np.maximum(count, 1)).astype(np.int64)))
    length = np.minimum(3, np.log2(np.maximum(count, 1)) / 3).astype(np.int64)
    cols.append(length * 16 + np.minimum(15, 16 * distinct / np.maximum(count, 1)).astype(np.int64))
    cols.append(np.minimum(15, np.log2(np.maximum(count, 1))).astype(np.int64))
    tag = np.stack([c + (k + 1) * 4096 for k, c in enumerate(cols)], 1).astype(np.uint64)
    return (mix(tag) >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows of a chunk and offsets; a row without words has none."""
    w = Words(data, off)
    rows, size = len(off) - 1, 1 << BITS

    def numbered(words: Words, h: np.ndarray) -> np.ndarray:
        return np.unique((np.repeat(np.arange(rows), words.counts()) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))

    distinct = np.bincount(numbered(w, w.hash) >> BITS, minlength=rows)
    shape = _shape(data, off, w, distinct)
    own = np.flatnonzero(w.counts())
    more = ((own[:, None] << BITS) | shape[own]).ravel()
    plain = Words(np.where(_SIGN[data], np.uint8(32), data), off, BEGIN)
    key = np.unique(np.concatenate([numbered(w, w.hash), numbered(plain, mix(plain.begin + np.uint64(BEGIN))), more]))
    return key & (size - 1), np.searchsorted(key >> BITS, np.arange(rows + 1))


class CumulativeLink:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, numbers: np.ndarray, off: np.ndarray, grades: np.ndarray, rounds: int = 120, rate: float = 0.05, decay: float = 2e-3) -> CumulativeLink:
        """Maximum likelihood with weight decay; features of fewer than 3 documents stay 0."""
        common = np.bincount(numbers, minlength=1 << BITS) >= 3
        used = np.flatnonzero(common)
        place = np.cumsum(common) - 1
        keep = common[numbers]
        row = np.repeat(np.arange(len(grades)), np.diff(off))[keep]
        col = place[numbers[keep]]
        levels = GRADES - 1
        share = [np.clip((grades >= j).mean(), 0.02, 0.98) for j in range(1, levels + 1)]
        first = -np.log(share[0] / (1 - share[0]))
        p = np.concatenate([np.zeros(len(used)), [first], np.zeros(levels - 1)])
        m, v = np.zeros_like(p), np.zeros_like(p)
        n = len(grades)
        best = grades == levels
        odds = [(np.bincount(col, weights=b[row], minlength=len(used)) + 1) / (b.sum() + 2) for b in (best, ~best)]
        value = np.abs(np.log(odds[0] / odds[1]))
        for step in range(1, rounds + 1):
            w, t = p[: len(used)], np.cumsum(np.concatenate([p[len(used) : len(used) + 1], np.exp(p[len(used) + 1 :])]))
            s = np.bincount(row, weights=(w * value)[col], minlength=n)
            above = [np.ones(n), *(1 / (1 + np.exp(np.clip(tj - s, -30, 30))) for tj in t), np.zeros(n)]
            at = np.stack(above)[grades, np.arange(n)] - np.stack(above)[grades + 1, np.arange(n)]
            at = np.maximum(at, 1e-9)
            ds, dt = np.zeros(n), np.zeros(levels)
            for j in range(1, levels + 1):
                slope = above[j] * (1 - above[j])
                part = ((grades == j).astype(float) - (grades == j - 1)) * slope / at
                ds += part
                dt[j - 1] = -part.sum()
            grad = np.zeros_like(p)
            grad[: len(used)] = value * np.bincount(col, weights=ds[row], minlength=len(used)) / n - decay * w
            down = np.cumsum(dt[::-1])[::-1] / n
            grad[len(used)] = down[0]
            grad[len(used) + 1 :] = down[1:] * np.exp(p[len(used) + 1 :])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights = np.zeros(1 << BITS, np.float32)
        weights[used] = p[: len(used)] * value
        return cls(weights, np.cumsum(np.concatenate([p[len(used) : len(used) + 1], np.exp(p[len(used) + 1 :])])))

    def tails(self, numbers: np.ndarray, off: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each row; 0 for a row without features."""
        run = np.concatenate([[0.0], np.cumsum(self.weights[numbers], dtype=np.float64)])
        s = run[off[1:]] - run[off[:-1]]
        out = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -30, 30)))
        out[np.diff(off) == 0] = 0
        return out


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Graded rating: 0 toxic, 1 poor, 2 good."""
    return F.when(F.col(toxic) != 0, 0).when(F.col(quality) == 0, 1).otherwise(2)


def fit(docs: DataFrame, ratings: DataFrame, bound: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> CumulativeLink | None:
    """A model from rated documents; ``ratings`` has the id and an integer ``grade``."""
    ship(docs.sparkSession)
    ratings = ratings.select(F.col(id_col).alias("rated"), F.col("grade").cast("int").alias("grade")).where("rated is not null and grade is not null")
    n = ratings.count()
    if not n:
        return None
    space = 1 << 30
    taken = ratings.where(F.pmod(F.xxhash64(F.col("rated").cast("string")), F.lit(space)) < min(space, int(space * bound / n) + 1))
    rows = docs.select(F.col(id_col).alias("rated"), F.col(text_col).alias("text")).join(F.broadcast(taken), "rated").select("text", "grade")

    def run(batches):
        for b in batches:
            data, off = strings(b.column(0))
            for first, end, piece, own in chunks(data, off):
                numbers, to = features(piece, own)
                packed = [numbers[to[k] : to[k + 1]].astype("<u4").tobytes() for k in range(end - first)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), b.column(1).slice(first, end - first)], ["x", "grade"])

    got = sorted((bytes(r.x), r.grade) for r in rows.mapInArrow(run, "x binary, grade int").collect())
    if not got:
        return None
    numbers = np.frombuffer(b"".join(x for x, _ in got), "<u4").astype(np.int64)
    off = np.concatenate([[0], np.cumsum([len(x) // 4 for x, _ in got])])
    return CumulativeLink.fit(numbers, off, np.clip([g for _, g in got], 0, GRADES - 1).astype(np.int64))


def score(docs: DataFrame, model: CumulativeLink | None, keep: list[str], text_col: str = "text", cut: float = CUT, only_kept: bool = False) -> DataFrame:
    """``keep`` columns, then expected_grade, p_poor_or_better, p_good, kept (p_good >= cut).

    With ``only_kept`` the rejected rows go and no column is added.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    place = [docs.columns.index(c) for c in keep]
    base = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    added = ["expected_grade", "p_poor_or_better", "p_good", "kept"]
    schema = docs.select(*keep).schema if only_kept else base + ", expected_grade double, p_poor_or_better double, p_good double, kept boolean"

    def run(batches):
        m = held.value
        for b in batches:
            data, off = strings(b.column(at))
            found = [np.zeros((0, GRADES - 1))]
            for _, _, piece, own in chunks(data, off):
                numbers, to = features(piece, own)
                found.append(m.tails(numbers, to) if m else np.repeat((np.diff(to) > 0).astype(float)[:, None], GRADES - 1, 1))
            p = np.concatenate(found)
            kept = pa.array(p[:, -1] >= cut)
            columns = [b.column(k) for k in place]
            if only_kept:
                yield pa.RecordBatch.from_arrays(columns, keep).filter(kept)
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, -1]), kept], [*keep, *added])

    return docs.mapInArrow(run, schema)
