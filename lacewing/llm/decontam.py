"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some word positions of a window and ignores the others, so a
substituted word at an ignored position does not change the hash.  Hashes of all
masked windows of the benchmark are held by every task; each document's windows
are looked up there, and each hit fixes a diagonal (where item word 0 would stand
in the document).  On that diagonal the words of item and document are compared
and the best stretch is scored: +1 for an equal word, -3 for a substituted one (of
equal scores the stretch that ends first).  Items of fewer than four words have a
mask of their own length, so they are found where they stand whole.

A pair is an overlap if the stretch has at least ``min(least, words of the item)
* identity`` equal words and a share of at least ``identity`` of its words equal.

Memory.  The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words (a longer
item is a block), and a task holds one block at a time; a benchmark of several blocks
is one pass a block.  Hits are counted before they are expanded.  Documents are taken
in runs of at most ``HITS`` hits; a document of more is compared item by item, and with
an item that it hits more often than there are diagonals every diagonal is compared.
Diagonals are compared in slices of about ``SLICE`` words.  Nothing has a cap.

Null and empty texts overlap with nothing, and items without words with no document.
Repeated rows each give their own result.  Of several diagonals for one
document row and item the one with most equal words counts, then the earliest.
Extra columns are passed through by ``remove_contaminated`` and otherwise ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import IdFilter
from .kernel import Words, chunks, mix, strings
from .shared import Workspace, ship

#: Kept positions of the windows.
MASKS = ("1111", "11011", "110101", "101011")
#: For items of just so many words.
WHOLE = ("1", "11", "111")
BLOCK_WORDS = 400_000
HITS = 1_000_000
SLICE = 1_000_000
LEAST = 12
IDENTITY = 0.8


def masked(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the kept positions of each window."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, hash_of(mask), np.uint64)
    for j, keep in enumerate(mask):
        if keep == "1":
            g = mix(g * np.uint64(0xA0761D6478BD642F) + hashes[j : j + n])
    return g


def hash_of(mask: str) -> np.uint64:
    return np.uint64(int(mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64))


class Hits:
    """Windows of a chunk under one mask that the benchmark has: word, first of their places, how many."""

    def __init__(self, at: np.ndarray, lo: np.ndarray, many: np.ndarray):
        self.at, self.lo, self.many = at, lo, many

    def rows(self, first: int, end: int) -> Hits:
        """Those of the words from ``first`` to ``end``."""
        p = slice(*np.searchsorted(self.at, [first, end]))
        return Hits(self.at[p], self.lo[p], self.many[p])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Word and number of the place of every hit."""
        inside = np.arange(self.many.sum()) - np.repeat(np.cumsum(self.many) - self.many, self.many)
        return np.repeat(self.at, self.many), np.repeat(self.lo, self.many) + inside


class Block:
    """Masked windows of some benchmark items, sorted by hash and place."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, off = strings(pa.array(texts, pa.string()))
        w = Words(data, off)
        self.ids, self.hashes, self.off = np.array(ids, np.int64), w.hash, w.off
        size = np.diff(w.off)
        keys, places = [], []
        for mask in MASKS + WHOLE:
            g = masked(w.hash, mask)
            item = np.searchsorted(w.off, np.arange(len(g)), "right") - 1
            inside = np.arange(len(g)) + len(mask) <= w.off[item + 1]
            if mask in WHOLE:
                inside &= size[item] == len(mask)
            keys.append(g[inside])
            places.append(np.flatnonzero(inside))
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.lexsort((place, key))
        self.key, self.place = key[order], place[order]
        self.item = np.searchsorted(self.off, self.place, "right") - 1
        self.group = np.cumsum(np.diff(self.key, prepend=self.key[:1]) != 0) * len(ids) + self.item  # ascending
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.key >> np.uint64(42)).astype(np.int64)] = True
        self.masks = MASKS + tuple(m for m in WHOLE if (size == len(m)).any())

    def hits(self, w: Words, mask: str) -> Hits:
        g = masked(w.hash, mask)
        at = np.flatnonzero(self.seen[(g >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, g[at], "left"), np.searchsorted(self.key, g[at], "right")
        hit = (hi > lo) & (at + len(mask) <= w.off[np.searchsorted(w.off, at, "right")])
        return Hits(at[hit], lo[hit], (hi - lo)[hit])

    def search(self, w: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """Overlaps of a chunk: row, item number, first word, words, equal words."""
        hits = [self.hits(w, mask) for mask in self.masks]
        per_row = np.zeros(len(w.off) - 1, np.int64)
        for h in hits:
            np.add.at(per_row, np.searchsorted(w.off, h.at, "right") - 1, h.many)
        rows, first = np.flatnonzero(per_row), 0
        run = np.concatenate([[0], np.cumsum(per_row[rows])])
        while first < len(rows):
            end = max(first + 1, int(np.searchsorted(run, run[first] + HITS, "right")) - 1)
            part = [h.rows(w.off[rows[first]], w.off[rows[end - 1] + 1]) for h in hits]
            if run[end] - run[first] <= HITS:
                yield from self._together(w, part)
            else:
                yield from self._apart(w, int(rows[first]), part)
            first = end

    def _together(self, w: Words, hits: list[Hits]) -> Iterator[tuple[int, int, int, int, int]]:
        """Overlaps of rows with few hits."""
        src, k = (np.concatenate(x) for x in zip(*(h.pairs() for h in hits), strict=True))
        row, item = np.searchsorted(w.off, src, "right") - 1, self.item[k]
        diagonal = src - w.off[row] - (self.place[k] - self.off[item])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, start, n, same in self._compare(w, np.unique(np.stack([row, item, diagonal], 1), axis=0)):
            new = (same, -start, n)
            best[row, item] = max(best.get((row, item), new), new)
        for (row, item), (same, at, n) in sorted(best.items()):
            yield row, item, -at, n, same

    def _apart(self, w: Words, row: int, hits: list[Hits]) -> Iterator[tuple[int, int, int, int, int]]:
        """Overlaps of one row with many hits, item by item."""
        own = int(w.off[row + 1] - w.off[row])
        times = np.zeros(len(self.ids), np.int64)
        for h in hits:
            lo, first, often = np.unique(h.lo, return_index=True, return_counts=True)
            for k, n, c in zip(lo.tolist(), h.many[first].tolist(), often.tolist(), strict=True):
                np.add.at(times, self.item[k : k + n], c)
        for item in np.flatnonzero(times).tolist():
            size = int(self.off[item + 1] - self.off[item])
            if times[item] > own + size:
                diagonal = np.arange(1 - size, own)
            else:
                found = []
                for h in hits:
                    g = self.group[h.lo] // len(self.ids) * len(self.ids) + item
                    lo = np.searchsorted(self.group, g, "left")
                    src, k = Hits(h.at, lo, np.searchsorted(self.group, g, "right") - lo).pairs()
                    found.append(src - w.off[row] - (self.place[k] - self.off[item]))
                diagonal = np.unique(np.concatenate(found))
            best = None
            for _, _, start, n, same in self._compare(w, np.stack([np.full(len(diagonal), row), np.full(len(diagonal), item), diagonal], 1)):
                if best is None or (same, -start) > (best[2], -best[0]):
                    best = start, n, same
                if same == size:  # diagonals come in order, so no other can be better
                    break
            if best:
                yield row, item, *best

    def _compare(self, w: Words, triples: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Best stretches of (row, item, diagonal), in their order, if they are overlaps."""
        row, item, diagonal = triples.T
        lo = np.maximum(0, -diagonal)
        n = np.minimum(np.diff(self.off)[item], np.diff(w.off)[row] - diagonal) - lo
        keep = (n > 0) & (n >= IDENTITY * np.minimum(LEAST, np.diff(self.off)[item]))
        row, item, diagonal, lo, n = (x[keep] for x in (row, item, diagonal, lo, n))
        ends, first = np.cumsum(n + 1), 0
        while first < len(n):
            done = ends[first] - n[first] - 1
            end = max(first + 1, int(np.searchsorted(ends, done + SLICE, "right")))
            p = slice(first, end)
            yield from self._stretches(w, row[p], item[p], diagonal[p], lo[p], n[p])
            first = end

    def _stretches(self, w: Words, row: np.ndarray, item: np.ndarray, diagonal: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """As above for one slice; each diagonal is a run of n + 1 sums, the first of them 0."""
        base = np.cumsum(n + 1) - n - 1
        of = np.repeat(np.arange(len(n)), n + 1)
        word = np.arange(len(of)) - base[of] - 1
        real = word >= 0
        equal = np.zeros(len(of), bool)
        equal[real] = w.hash[((w.off[row] + diagonal + lo)[of] + word)[real]] == self.hashes[((self.off[item] + lo)[of] + word)[real]]
        run = np.cumsum(np.where(equal, 1, -3) * real)
        run -= run[base][of]
        step = of * (4 * int(n.max()) + 4)  # puts each diagonal's sums below those of the one before
        low = np.minimum.accumulate(run - step) + step
        gain = run - low
        at = np.flatnonzero(gain == np.maximum.reduceat(gain, base)[of])
        stop = at[np.searchsorted(of[at], np.arange(len(n)))]
        start = np.maximum.accumulate(np.where(run == low, np.arange(len(of)), 0))[stop]
        sums = np.cumsum(equal)
        same, words = sums[stop] - sums[start], stop - start
        ok = (words > 0) & (same >= IDENTITY * np.minimum(LEAST, np.diff(self.off)[item])) & (same >= IDENTITY * words)
        cols = (row, item, diagonal + lo + start - base, words, same)
        yield from zip(*(c[ok].tolist() for c in cols), strict=True)


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark in blocks of at most BLOCK_WORDS words (a longer item is a block)."""
    ids: list[int] = []
    texts: list[str] = []
    words = 0
    for item, text in benchmark.select(item_col, text_col).where(f"`{item_col}` is not null and `{text_col}` is not null").toLocalIterator():
        n = len(text.split())
        if ids and words + n > BLOCK_WORDS:
            yield Block(ids, texts)
            ids, texts, words = [], [], 0
        ids.append(item)
        texts.append(text)
        words += n
    yield Block(ids, texts)


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[Iterator[Block], bool]:
    """The blocks, and whether there are several; no more than two are held by the driver."""
    found = blocks(benchmark, item_col, text_col)
    head = list(islice(found, 2))
    return chain(head, found), len(head) > 1


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per overlapping (document row, item): doc_id, item_id, start_word, n_words, n_equal, item_words."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[doc_col].dataType.simpleString()
    schema = f"`{doc_col}` {kind}, item_id bigint, start_word int, n_words int, n_equal int, item_words int"
    names = [doc_col, "item_id", "start_word", "n_words", "n_equal", "item_words"]
    work, parts = Workspace(spark, "overlaps"), []
    found, several = _passes(benchmark, item_col, item_text_col)
    for k, block in enumerate(found):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            known = held.value
            size = np.diff(known.off)
            for b in batches:
                data, off = strings(b.column(1))
                rows, out = [], []
                for first, _, piece, own in chunks(data, off):
                    for row, item, start, n, same in known.search(Words(piece, own)):
                        rows.append(first + row)
                        out.append((known.ids[item], start, n, same, size[item]))
                cols = np.array(out, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:].astype(np.int32))], names)

        part = docs.select(doc_col, text_col).mapInArrow(run, schema)
        if several:  # each result is written before the next block is held
            part = work.cut(part, f"block{k}")
            held.unpersist()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The document rows, with all their columns, that overlap with no item.

    With one block this is one pass over the rows.  With several, each pass writes the
    digests of the texts that overlap with its block; rows of those texts go.  Rows outside
    a bit filter of the digests stay at once, and only the others are joined with them.
    """
    spark = docs.sparkSession
    ship(spark)
    at = docs.columns.index(text_col)
    work, parts = Workspace(spark, "contaminated"), []
    found, several = _passes(benchmark, item_col, item_text_col)
    for k, block in enumerate(found):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held, at=1 if several else at):
            for b in batches:
                data, off = strings(b.column(at))
                bad = np.zeros(b.num_rows, bool)
                for first, _, piece, own in chunks(data, off):
                    for row, *_ in held.value.search(Words(piece, own)):
                        bad[first + row] = True
                yield b.filter(pa.array(~bad)) if not several else b.filter(pa.array(bad)).select([0])

        if not several:
            return docs.mapInArrow(run, docs.schema)
        digest = F.sha2(F.col(text_col), 256)
        parts.append(work.cut(docs.where(F.col(text_col).isNotNull()).select(digest.alias("digest"), F.col(text_col).alias("text")).mapInArrow(run, "digest string").distinct(), f"block{k}"))
        held.unpersist()
    gone = work.cut(reduce(DataFrame.unionByName, parts).distinct().select(F.xxhash64("digest").alias("id"), "digest"), "gone")
    maybe = IdFilter(gone).split(docs, F.xxhash64(F.sha2(F.col(text_col), 256)))
    return maybe[False].unionByName(maybe[True].join(gone.select("digest"), F.sha2(maybe[True][text_col], 256) == F.col("digest"), "left_anti"))
