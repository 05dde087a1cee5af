"""Hidden Markov language model with exact sequence likelihood.

Tokens are words (A-Z lowered) and one end mark for each text.  Training texts
give counts of all tokens.  The most frequent OWN tokens are emission classes of
their own; every other token belongs to one of BUCKETS classes by its hash, where
its share is that of its count + 1/2.  Each bucket has one unseen token, of count 0,
so probabilities sum to 1 and an unseen token has about what its base gives it.  So
the parameters of the latent states have a fixed size while every token of the corpus
keeps its own probability.  Emissions have the shares of the classes among all tokens
as their prior, with the weight of PRIOR tokens in each state; where a state has seen
little it speaks like the whole corpus.

Training: Baum-Welch.  Each task walks its texts forwards and backwards, many
texts in step, and returns expected counts of starts, transitions and emissions and
the logarithm of its texts' likelihood; Spark adds them over all partitions.  Texts
are walked from their first token to their last.  Rounds go on until the likelihood
gains less than TOLERANCE of itself twice in succession and no more the second time:
from states that are nearly alike the gains are small at first and then grow.  That is
done with about FEW tokens first, which only gives the states to begin with, and then
with all training texts.

Scoring: scaled forward recursion over the whole text, exact for any length, plus
the shares of tokens within buckets.  Counts of the TOP most frequent tokens are
broadcast (fixed size); all others are joined with the table of counts.

Null text counts as empty: one token, the end.  A null id counts as the empty
text for the split.  Repeated rows and ids each get their own result.  Without
training texts every probability is that of one unseen token.  Extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, chunks, strings
from .shared import Workspace, ship

STATES = 6
OWN = 2048
BUCKETS = 2048
TOP = 65_536
STEADY = 512
TOLERANCE = 1e-4
PRIOR = 400.0
FEW = 1_000_000
GROUP = 1_000_000
TRAINED = 3_000_000
COUNTED = 1_000_000
END = np.int64(0x5BD1E995)
SLOTS = 20


class Known:
    """Counts and classes of the most frequent tokens, by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hash, self.count = hashes[order], counts[order]
        own = np.argsort(np.argsort(-counts, kind="stable"), kind="stable")[order]
        self.own = np.where(own < OWN, own, -1)
        slot = (self.hash.view(np.uint64) >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.slots = np.full(1 << SLOTS, -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.slots[np.flatnonzero(np.bincount(slot, minlength=1 << SLOTS) > 1)] = -2

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it isn't known."""
        if not len(self.hash):
            return np.full(len(h), -1, np.int32)
        at = self.slots[(h.view(np.uint64) >> np.uint64(64 - SLOTS)).astype(np.int64)]
        full = np.flatnonzero(at == -2)
        at[full] = np.minimum(np.searchsorted(self.hash, h[full]), len(self.hash) - 1)
        at[(at >= 0) & (self.hash[at] != h)] = -1
        return at

    def classes(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = OWN + (h & np.int64(BUCKETS - 1))
        if len(self.hash):
            own = self.own[at]
            c = np.where((at >= 0) & (own >= 0), own, c)
        return c


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a chunk, each row's end mark included, and offsets."""
    w = Words(data, off)
    return np.insert(w.hash.view(np.int64), w.off[1:], END), w.off + np.arange(len(w.off))


class Model:
    """Start, transition and emission probabilities of the states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: class by state

    @classmethod
    def first(cls, share: np.ndarray) -> Model:
        r = np.random.default_rng(7)
        emit = share[:, None] * r.uniform(0.5, 1.5, (len(share), STATES))
        move = r.uniform(0.5, 1.5, (STATES, STATES)) + np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
        start, move, emit = start + 1e-3, move + 1e-3, emit + PRIOR * share[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def expect(self, cls: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions over some sequences."""
        return self.expect_and_log(cls, off)[:3]

    def expect_and_log(self, cls: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The expected counts, and the log of the probability of all the sequences."""
        cls, live, begin, _ = in_step(cls, off)
        move, emit = self.move.astype(np.float32), np.ascontiguousarray(self.emit.T, np.float32)
        alpha, scale = np.empty((STATES, len(cls)), np.float32), np.empty(len(cls), np.float32)  # state by token, as all below
        a = None
        for n, b in zip(live, begin, strict=True):
            a = emit[:, cls[b : b + n]] * (self.start.astype(np.float32)[:, None] if a is None else move.T @ a[:, :n])
            s = a.sum(0)
            a /= s
            alpha[:, b : b + n], scale[b : b + n] = a, s
        moves = np.zeros((STATES, STATES))
        first = int(live[0]) if len(live) else 0
        beta = np.ones((STATES, first), np.float32)
        for t in range(len(live) - 1, 0, -1):
            n, b = live[t], begin[t]
            here = alpha[:, b : b + n]
            if t % STEADY == 0:  # alpha times beta sums to 1 but for rounding
                beta[:, :n] /= (here * beta[:, :n]).sum(0)
            right = emit[:, cls[b : b + n]] * beta[:, :n]
            right /= scale[b : b + n]
            here *= beta[:, :n]
            moves += alpha[:, begin[t - 1] : begin[t - 1] + n] @ right.T
            beta[:, :n] = move @ right
        alpha[:, :first] *= beta  # now the share of each state in each token
        out = np.stack([np.bincount(cls, weights=alpha[j], minlength=OWN + BUCKETS) for j in range(STATES)], 1)
        return alpha[:, :first].sum(1, dtype=np.float64), moves * self.move, out, float(np.log(scale).sum(dtype=np.float64))

    def log10(self, cls: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence, by scaled forward recursion."""
        cls, live, begin, row = in_step(cls, off)
        scale, a = np.empty(len(cls)), None
        for n, b in zip(live, begin, strict=True):
            a = self.emit.T[:, cls[b : b + n]] * (self.start[:, None] if a is None else self.move.T @ a[:, :n])
            scale[b : b + n] = s = a.sum(0)
            a /= s
        return np.bincount(row, weights=np.log10(scale), minlength=len(off) - 1)


def in_step(cls: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes with all first tokens before all second ones and so on, longer sequences first.

    Also, for each step, how many sequences still go on and where its tokens begin, and the
    sequence of each token.
    """
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    begin = np.cumsum(live) - live
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    place = begin[np.arange(len(row)) - off[:-1][row]] + rank[row]
    moved, of = np.empty_like(cls), np.empty_like(row)
    moved[place], of[place] = cls, row
    return moved, live, begin, of


def _groups(batches, column: int, most: int):
    """Token hashes and offsets of whole rows, about ``most`` tokens at a time, with the batches they are from."""
    held, n = [], 0
    for b in batches:
        data, off = strings(b.column(column))
        for first, end, piece, own in chunks(data, off):
            h, to = tokens(piece, own)
            held.append((b.slice(first, end - first), h, to))
            n += len(h)
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def _coded_groups(batches, most: int):
    """Classes and offsets of whole rows of a binary column, about ``most`` tokens at a time."""
    held, n = [], 0
    for b in batches:
        data, off = strings(b.column(0))
        for _, _, piece, own in chunks(data, off):
            held.append((piece.view("<u2"), own // 2))
            n += len(piece) // 2
            if n >= most:
                yield _end_to_end(held)
                held, n = [], 0
    if held:
        yield _end_to_end(held)


def _end_to_end(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    base = np.cumsum([0, *(len(x) for x, _ in held)])
    return np.concatenate([x for x, _ in held]), np.concatenate([[0], *(to[1:] + base[k] for k, (_, to) in enumerate(held))])


def _joined(held) -> tuple[np.ndarray, np.ndarray]:
    return _end_to_end([(h, to) for _, h, to in held])


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, c): how often each token is in the texts, end marks included."""

    def run(batches):
        kept, n = [], 0

        def flush():
            h = np.concatenate([x for x, _ in kept])
            c = np.concatenate([x for _, x in kept])
            u, to = np.unique(h, return_inverse=True)
            return u, np.bincount(to, weights=c).astype(np.int64)

        for b in batches:
            data, off = strings(b.column(0))
            for _, _, piece, own in chunks(data, off):
                h, _ = tokens(piece, own)
                kept.append(np.unique(h, return_counts=True))
                n += len(kept[-1][0])
                if n > COUNTED:
                    kept = [flush()]
                    n = len(kept[0][0])
                    if n > COUNTED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], ["h", "c"])
                        kept, n = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in flush()], ["h", "c"])

    return texts.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame):
    """The most frequent tokens, at most TOP, as a pandas frame.

    A histogram over powers of 2**(1/8) (a few hundred rows) tells down to which
    count they are few enough; only those rows come to the driver.
    """
    level = F.floor(F.log2("c") * 8)
    sizes = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    taken, least = 0, None
    for k in sorted(sizes, reverse=True):
        taken += sizes[k]
        if taken > TOP:
            break
        least = k
    rows = counts.where(level >= least) if least is not None else counts.where("false")
    return rows.orderBy(F.desc("c"), "h").toPandas()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from rows whose crc32 of the id as text leaves another remainder than 1
    by 5; held_out is that remainder being 1.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "lm")
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 1
    train = docs.where(~held_out).select(id_col, text_col)
    counts = work.cut(count_tokens(train.select(text_col)), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts)
    known = Known(top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64))
    own = known.hash[known.own >= 0]
    in_bucket = counts.groupBy(F.col("h").bitwiseAND(BUCKETS - 1).alias("k")).agg(F.sum(F.col("c") + 0.5).alias("z")).collect()
    mass = np.full(BUCKETS, 0.5)
    for r in in_bucket:
        mass[r.k] += r.z
    mine = known.own >= 0
    np.subtract.at(mass, own & (BUCKETS - 1), known.count[mine] + 0.5)
    mass = np.maximum(mass, 0.5)
    share = np.concatenate([np.zeros(OWN), mass])
    share[known.own[mine]] = known.count[mine] + 0.5
    share /= share.sum()
    model = Model.first(share)
    states = [f"s{j}" for j in range(STATES)]
    tables = spark.sparkContext.broadcast(known)

    def coded(batches):
        """Classes of each text's tokens, as unsigned 16-bit integers."""
        know = tables.value
        for b in batches:
            data, off = strings(b.column(1))
            for first, end, piece, own in chunks(data, off):
                h, to = tokens(piece, own)
                c = know.classes(h, know.find(h)).astype("<u2")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array([c[i:j].tobytes() for i, j in zip(to[:-1], to[1:], strict=True)], pa.binary())], ["pick", "classes"])

    def trained(model: Model, texts: DataFrame) -> Model:
        """Rounds over the texts until the likelihood is steady."""
        logs, small = [], 0
        while small < 2:
            now = spark.sparkContext.broadcast(model)

            def expect(batches, now=now):
                m = now.value
                start, move, emit, log = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((OWN + BUCKETS, STATES)), np.zeros(STATES)
                for cls, off in _coded_groups(batches, TRAINED):
                    s, v, e, p = m.expect_and_log(cls, off)
                    start, move, emit = start + s, move + v, emit + e
                    log[0] += p
                table = np.vstack([start, move, emit, log])
                full = np.flatnonzero(table.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(table[full, j]) for j in range(STATES))], ["row", *states])

            sums = texts.mapInArrow(expect, "row bigint, " + ", ".join(f"{s} double" for s in states)).groupBy("row").agg(*(F.sum(s).alias(s) for s in states)).toPandas()
            table = np.zeros((2 + STATES + OWN + BUCKETS, STATES))
            table[sums["row"].to_numpy(np.int64)] = sums[states].to_numpy()
            model = Model.of(table[0], table[1 : 1 + STATES], table[1 + STATES : -1], share)
            now.unpersist()
            logs.append(table[-1, 0])
            gains = np.diff(logs)
            less = len(gains) > 0 and not gains[-1] > tolerance * abs(logs[-1])
            small = (small + 1 if small == 0 or not gains[-1] > gains[-2] else 1) if less else 0
        return model

    if total.n:
        texts = train.select(F.xxhash64(id_col, text_col).alias("pick"), F.col(text_col).alias("text")).mapInArrow(coded, "pick bigint, classes binary")
        texts = work.cut(texts, "classes")
        if total.n > 2 * FEW:
            few = texts.where(F.pmod("pick", F.lit(int(total.n // FEW))) == 0).select("classes")
            model = trained(model, work.cut(few.coalesce(2), "few"))  # about FEW tokens, whatever the table
        model = trained(model, texts.select("classes"))
        work.drop("classes")
    final = spark.sparkContext.broadcast((model, np.log10(mass)))
    denominator = float(np.log10(total.n + 0.5 * (total.v + 1)))
    kind = docs.schema[id_col].dataType.simpleString()

    def local(batches):
        (m, log_mass), know = final.value, tables.value
        logs = np.log10(know.count + 0.5) if len(know.hash) else np.zeros(1)
        key = TaskContext.get().partitionId() << 36
        for held in _groups(batches, 2, GROUP):
            h, off = _joined(held)
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            at = know.find(h)
            cls = know.classes(h, at)
            found = at >= 0
            score = m.log10(cls, off)
            bucket = cls >= OWN
            base = np.where(found, logs[at], 0.0)
            within = np.where(bucket, base - log_mass[cls - np.where(bucket, OWN, cls)], 0.0)
            rows = len(off) - 1
            base = np.bincount(row, weights=base, minlength=rows)
            score += np.bincount(row, weights=within, minlength=rows)
            n_known = np.bincount(row, weights=found, minlength=rows).astype(np.int64)
            rare = np.flatnonzero(~found)
            order = rare[np.lexsort((h[rare], row[rare]))]
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order))).astype(np.int32)
            ends = np.searchsorted(row[order][first], np.arange(rows + 1)).astype(np.int32)
            b = pa.Table.from_batches([x for x, _, _ in held]).combine_chunks()
            b = b.to_batches()[0] if b.num_rows else held[0][0]
            yield pa.RecordBatch.from_arrays([
                pa.array(key + np.arange(rows)), b.column(0), b.column(1), pa.array(np.diff(off)), pa.array(n_known), pa.array(base), pa.array(score),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(h[order][first])), pa.ListArray.from_arrays(pa.array(ends), pa.array(times)),
            ], ["key", id_col, "held_out", "n_tokens", "n_known", "base", "score", "rare", "times"])
            key += rows

    schema = f"key bigint, `{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, times array<int>"
    rows = work.cut(docs.select(F.col(id_col), held_out.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(local, schema), "rows")
    rare = rows.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    more = rare.join(counts, "h", "left").groupBy("key").agg(
        F.sum(F.col("times") * F.log10(c + 0.5)).alias("logs"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    zero = F.lit(0.0)
    return rows.drop("rare", "times").join(more, "key", "left").select(
        id_col, "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total.n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", zero) - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        (F.col("score") + F.coalesce("logs", zero)).alias("score"),
    )
