"""Token ids in binary files coded by a static range asymmetric numeral system.

Format.  A dataset has two tables of Parquet rows, which any store that Spark
reaches can hold: ``table`` (symbol, freq; the frequencies add up to 2**SCALE) is
shared by all blocks, and ``blocks`` has a row for each block: part and seq (order
of blocks), start (ids in this part before it), docs and sizes (documents and their
numbers of ids), body (bytes).  A body is little-endian:

    magic "LWR1", scale u32, lanes u32, ids u64, words u64, interval u32,
    checkpoints u32, crc32 of the table u32, of the ids u32, of all after this u32,
    lane states u64 x lanes, per checkpoint: word position u64, states u64 x lanes,
    words u32 x words

Id number i belongs to lane i mod lanes; all lanes share one stream of words.
Blocks are independent of each other, and decoding can begin at any checkpoint, so
a block can be decoded by several readers.

Documents are in ascending order of id: they are dealt into ranges by quantiles of
the id column and sorted there.  Ids per block have a bound (a longer document has
a block of its own); frequencies are counts over all documents.

Null text counts as empty (the end id alone).  Null ids come first; rows of equal
id follow each other in order of their token ids.  Extra columns are not read.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, ship

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 2048
INTERVAL = 256
BLOCK = 1 << 20
HEAD = struct.Struct("<4sIIQQIIIII")

#: Texts of these characters alone are cut into words here; the library encodes each word once.
NOT_PLAIN = re.compile("[^\\t-\\r -~À-ÖØ-öø-įı-ſ]|<\\|")
# The word pattern of this vocabulary.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
KEPT = 700_000


class Encoder:
    """The tokenizers library with a dictionary of runs between white space met before."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        from .bpe import byte_symbols

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = array("HI"[self.width // 4]).typecode
        self.kept: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        """Ids as little-endian unsigned integers of ``width`` bytes."""
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def word(self, w: str) -> bytes:
        if not w.isascii():
            w = w.encode().decode("latin-1").translate(self.symbols)
        return self.pack([t.id for t in self.model.tokenize(w)])

    def known(self, w: str) -> bytes:
        ids = self.kept.get(w)
        if ids is None:
            ids = self.kept[w] = self.word(w)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed."""
        if NOT_PLAIN.search(text):
            return self.pack(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        runs = text.lower().split()  # no word goes over white space
        if len(self.kept) > KEPT:
            self.kept.clear()
        for run in set(runs).difference(self.kept):
            self.kept[run] = self.known(run) if run.isalpha() else b"".join(map(self.known, WORD.findall(run)))
        return b"".join(map(self.kept.__getitem__, runs))


_LOADED: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _LOADED:
        _LOADED[file] = Encoder(file)
    return _LOADED[file]


class Table:
    """Quantised frequencies of all symbols."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Every symbol that occurs has a frequency of 1 at least; what is over or missing goes to the most frequent."""
        total = max(1, int(counts.sum()))
        freq = np.where(counts > 0, np.maximum(1, counts.astype(np.int64) * (1 << SCALE) // total), 0)
        if not freq.any():
            freq[0] = 1 << SCALE
        order = np.argsort(-freq, kind="stable")
        over = int(freq.sum()) - (1 << SCALE)
        if over <= 0:
            freq[order[0]] -= over
        for k in order if over > 0 else ():
            take = min(over, max(0, int(freq[k]) // 2))
            freq[k] -= take
            over -= take
            if not over:
                break
        return cls(freq)


def encode(ids: np.ndarray, table: Table) -> bytes:
    """The body of one block."""
    n = len(ids)
    lanes = int(np.clip(n // 64, 1, LANES))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    limit = freq << np.uint64(63 - SCALE)
    out, marks, written = [], [], 0
    for t in range(steps - 1, -1, -1):
        f, at = freq[t * lanes : (t + 1) * lanes], slice(t * lanes, (t + 1) * lanes)
        y = x[: len(f)]
        full = y >= limit[at]
        out.append(y[full].astype(np.uint32))  # the low half
        y = np.where(full, y >> np.uint64(32), y)
        written += len(out[-1])
        q = y // f
        x[: len(f)] = (q << np.uint64(SCALE)) + (y - q * f) + start[at]
        if t and t % INTERVAL == 0:
            marks.append((written, x.copy()))
    words = np.concatenate([np.zeros(0, np.uint32), *reversed(out)])
    rest = [x.astype("<u8").tobytes()]
    for done, state in reversed(marks):
        rest += [struct.pack("<Q", len(words) - done), state.astype("<u8").tobytes()]
    body = b"".join([*rest, words.astype("<u4").tobytes()])
    return HEAD.pack(b"LWR1", SCALE, lanes, n, len(words), INTERVAL, len(marks), table.crc, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode(body: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids between two checkpoints (0: the start; None: to the end); checksums are verified."""
    magic, scale, lanes, n, count, interval, marks, table_crc, ids_crc, crc = HEAD.unpack_from(body)
    if magic != b"LWR1" or scale != SCALE or table_crc != table.crc or zlib.crc32(memoryview(body)[HEAD.size :]) != crc:
        raise ValueError("a block is damaged or belongs to another table")
    at, pos, step = HEAD.size, 0, 8 * lanes + 8
    if first:
        at += first * step
        (pos,) = struct.unpack_from("<Q", body, at - 8)
    x = np.frombuffer(body, "<u8", lanes, at).astype(np.uint64)
    words = np.frombuffer(body, "<u4", count, HEAD.size + 8 * lanes + marks * (8 * lanes + 8)).astype(np.uint64)
    steps = -(-n // lanes)
    begin, end = first * interval, steps if last is None else min(steps, last * interval)
    out = np.empty(max(0, min(n, end * lanes) - begin * lanes), np.uint32)
    low = np.uint64((1 << SCALE) - 1)
    for t in range(begin, end):
        k = min(lanes, n - t * lanes)
        y = x[:k]
        slot = y & low
        s = table.symbol[slot.astype(np.int64)]
        out[(t - begin) * lanes : (t - begin) * lanes + k] = s
        y = table.freq[s] * (y >> np.uint64(SCALE)) + slot - table.start[s]
        dry = np.flatnonzero(y < LOW)
        y[dry] = (y[dry] << np.uint64(32)) | words[pos : pos + len(dry)]
        pos += len(dry)
        x[:k] = y
    if first == 0 and last is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("decoded ids don't have the block's checksum")
    return out


def write(docs: DataFrame, file: str, path: str, work: Workspace, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts, each followed by ``end_id``, into the dataset at ``path``."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.col(id_col).cast("double").alias("k")).approxQuantile("k", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = np.unique(np.array(cuts, float))

    def tokenise(batches):
        enc = encoder(file)
        end, width = enc.pack([end_id]), enc.width
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            raw = [enc.encode(t or "") + end for t in b.column(1).to_pylist()]
            key = np.nan_to_num(np.asarray(b.column(0).cast(pa.float64()).fill_null(-np.inf)), neginf=-np.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.searchsorted(bounds, key, "left").astype(np.int32)), pa.array([len(x) // width for x in raw], pa.int32()), pa.array(map(pack, raw), pa.binary())], ["doc", "part", "n", "ids"])

    def gather(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        pack = zstandard.ZstdCompressor(level=3).compress
        width = encoder(file).width
        names = ["part", "seq", "start", "docs", "sizes", "ids"]
        state = {"part": None, "seq": 0, "start": 0}
        docs_, sizes, ids, n = [], [], [], 0

        def flush():
            nonlocal docs_, sizes, ids, n
            out = pa.RecordBatch.from_arrays([pa.array([state["part"]], pa.int32()), pa.array([state["seq"]], pa.int32()), pa.array([state["start"]], pa.int64()), pa.array([docs_], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack(np.frombuffer(b"".join(ids), f"<u{width}").astype("<u4").tobytes())], pa.binary())], names)
            state["seq"] += 1
            state["start"] += n
            docs_, sizes, ids, n = [], [], [], 0
            return out

        for b in batches:
            for doc, part, size, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != state["part"]:
                    if sizes:
                        yield flush()
                    state = {"part": part, "seq": 0, "start": 0}
                if sizes and n + size > BLOCK:
                    yield flush()
                docs_.append(doc)
                sizes.append(size)
                ids.append(unpack(packed))
                n += size
        if sizes:
            yield flush()

    dealt = docs.select(id_col, text_col).mapInArrow(tokenise, f"doc {kind}, part int, n int, ids binary").repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc", "ids")
    runs = work.cut(dealt.select(F.col("doc").cast("bigint").alias("doc"), "part", "n", "ids").mapInArrow(gather, "part int, seq int, start bigint, docs array<bigint>, sizes array<int>, ids binary"), "runs", "uncompressed")

    def tally(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        total = np.zeros(1, np.int64)
        for b in batches:
            for packed in b.column(0).to_pylist():
                c = np.bincount(np.frombuffer(unpack(packed), "<u4"))
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["symbol", "c"])

    counts = runs.select("ids").mapInArrow(tally, "symbol bigint, c bigint").groupBy("symbol").agg(F.sum("c").alias("c")).toPandas()
    total = np.zeros(1 + int(counts["symbol"].max()) if len(counts) else 1, np.int64)
    total[counts["symbol"].to_numpy(np.int64)] = counts["c"].to_numpy(np.int64)
    table = Table.of_counts(total)
    rows = [(int(k), int(table.freq[k])) for k in np.flatnonzero(table.freq)]
    spark.createDataFrame(rows, "symbol bigint, freq bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    held = spark.sparkContext.broadcast(table)

    def code(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k in range(b.num_rows):
                body = encode(np.frombuffer(unpack(b.column(5)[k].as_py()), "<u4"), held.value)
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in b.columns[:5]), pa.array([body], pa.binary())], ["part", "seq", "start", "docs", "sizes", "body"])

    runs.mapInArrow(code, "part int, seq int, start bigint, docs array<bigint>, sizes array<int>, body binary").write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> Table:
    rows = spark.read.parquet(f"{path}/table").toPandas()
    freq = np.zeros(1 + int(rows["symbol"].max()), np.int64)
    freq[rows["symbol"].to_numpy(np.int64)] = rows["freq"].to_numpy(np.int64)
    return Table(freq)


def documents(spark: SparkSession, path: str, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Documents read back: id, start, n_tokens, and ids (binary) or, with ``digest``, ids_crc32."""
    ship(spark)
    held = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("n")).collect()}  # a row a part
    ahead, n = {}, 0
    for part in sorted(sizes):
        ahead[part] = n
        n += sizes[part]
    last = "ids_crc32" if digest else "ids"

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                part, _, start, docs, size, body = (c[k].as_py() for c in b.columns)
                raw = decode(body, held.value).astype("<u4").tobytes()
                ends = np.cumsum(np.array(size, np.int64))
                begin = ends - np.array(size, np.int64)
                pieces = [raw[4 * i : 4 * j] for i, j in zip(begin, ends, strict=True)]
                column = pa.array([zlib.crc32(x) for x in pieces], pa.int64()) if digest else pa.array(pieces, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begin + start + ahead[part]), pa.array(np.array(size, np.int64)), column], [id_col, "start", "n_tokens", last])

    columns = blocks.select("part", "seq", "start", "docs", "sizes", "body")
    return columns.mapInArrow(run, f"`{id_col}` bigint, start bigint, n_tokens bigint, {last} {'bigint' if digest else 'binary'}")
