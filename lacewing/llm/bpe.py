"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

Encoding.  Text is cut into pretokens (a pretoken never holds a visible
character followed by white space, so text can be sliced there).  Inside a
pretoken, merges are applied to a window of bytes and a token is emitted as soon
as no continuation can change it.  How many bytes must be known beyond a token
is computed from the merge list alone (``sufficient_lookahead``), so a pretoken
of any length is encoded in constant memory.  Encodings of short pretokens are
kept in a dictionary of bounded size.

Decoding.  Ids become bytes by table lookup and bytes become text by an
incremental state machine that carries an unfinished character over to the next
block; malformed bytes become U+FFFD.

Null text counts as empty: 0 tokens, digests of the empty string.  Rows with
equal ids, repeated rows and extra columns are passed over row by row; only the
named columns are read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import ship

# The pretoken pattern of this vocabulary family.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The same pattern for texts of ASCII and Latin letters alone, for the faster of two regular-expression modules.
PLAIN_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_PLAIN = r"[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]"
SLICE = 1 << 16
SHORT = 48
KEPT = 300_000
DECODED = 1 << 16
_NONE = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    symbol = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [symbol[b] for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], width: list[int]) -> int:
    """Bytes that must be known after a token's end before it is final.

    Let two texts agree up to byte q.  While merges are applied in order, let d be
    the point up to which both have the same tokens; at first d = q.  Only a merge
    (u, v) with v starting at d moves d, to the left by the width of u, and from
    then on the token starting at d is u in one of the texts.  Later moves
    therefore need a merge whose right part has that u on its left spine.  The
    heaviest chain of such merges bounds how far d can move.
    """
    left = {new: a for a, _, new in merges}
    moved: dict[int, int] = {}
    most = 0
    for a, b, _ in merges:
        before, t = 0, b
        while t is not None:
            before = max(before, moved.get(t, 0))
            t = left.get(t)
        total = before + width[a]
        moved[a] = max(moved.get(a, 0), total)
        most = max(most, total)
    return most


class Vocabulary:
    """Tables of one byte-level BPE file, with encoder and decoder."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        vocab = spec["model"]["vocab"]
        self.base = [vocab[s] for s in symbols]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in chain(vocab.items(), self.special.items()):
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.width = [*map(len, self.bytes_of)]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a << 20) | b: (k << 20) | new for k, (a, b, new) in reversed([*enumerate(merges)])}  # order of merging, then the new id
        self.lookahead = sufficient_lookahead(merges, self.width)
        self.pattern = regex.compile(PRETOKEN.replace("^\\s", "^" + WHITE).replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]"))
        self.plain, self.not_plain = re.compile(PLAIN_PRETOKEN), re.compile(NOT_PLAIN)
        self.cut = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.kept: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """All merges on a piece, lowest rank and leftmost first."""
        get = self.rank.get
        ids = [self.base[b] for b in piece]
        due = [get((a << 20) | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while due:
            first = min(due)
            if first == _NONE:
                break
            k = due.index(first)
            ids[k] = first & 0xFFFFF
            del ids[k + 1], due[k]
            if k:
                due[k - 1] = get((ids[k - 1] << 20) | ids[k], _NONE)
            if k < len(due):
                due[k] = get((ids[k] << 20) | ids[k + 1], _NONE)
        return ids

    def stream(self, pieces: Iterator[bytes]) -> Iterator[int]:
        """Ids of one pretoken that arrives in pieces, each as soon as it is final."""
        held = b""
        for piece in pieces:
            held += piece
            if len(held) < 2 * self.lookahead:
                continue
            final = len(held) - self.lookahead
            done = 0
            for i in self.merge(held):
                if done + len(self.bytes_of[i]) > final:
                    break
                yield i
                done += len(self.bytes_of[i])
            held = held[done:]
        yield from self.merge(held)

    def pretoken(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) <= SHORT:
            return array("I", self.merge(raw)).tobytes()
        step = max(SHORT, self.lookahead)
        return np.fromiter(self.stream(raw[k : k + step] for k in range(0, len(raw), step)), "<u4").tobytes()

    def slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            cut = self.cut.search(text, at + SLICE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> Iterator[bytes]:
        """Blocks of ids of a text as little-endian unsigned 32-bit integers."""
        at = 0
        for mark in self.marks.finditer(text) if self.marks else ():
            yield from self._plain(text[at : mark.start()])
            yield np.array([self.special[mark[0]]], "<u4").tobytes()
            at = mark.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[bytes]:
        for part in self.slices(text):
            pattern = self.pattern if self.not_plain.search(part) else self.plain
            if len(part) <= 2 * SLICE:
                yield self._words(pattern.findall(part))
                continue
            found = (m[0] for m in pattern.finditer(part))  # no place to cut: a block of words at a time
            while words := list(islice(found, SLICE)):
                yield self._words(words)

    def _words(self, words: list[str]) -> bytes:
        if len(self.kept) > KEPT:
            self.kept.clear()
        fresh = set(words).difference(self.kept)
        self.kept.update(zip(fresh, map(self.pretoken, fresh), strict=True))
        ids = b"".join(map(self.kept.__getitem__, words))
        for w in fresh if len(fresh) and len(max(fresh, key=len)) > SHORT else ():
            if len(w) > SHORT:
                del self.kept[w]
        return ids

    def decode(self, blocks: Iterator[bytes]) -> Iterator[str]:
        """Text of blocks of ids; a character may span blocks."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for block in blocks:
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, np.frombuffer(block, "<u4").tolist())))
        yield machine.decode(b"", True)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(file: str) -> Vocabulary:
    if file not in _LOADED:
        _LOADED[file] = Vocabulary(file)
    return _LOADED[file]


def encode_documents(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        voc = vocabulary(file)
        for b in batches:
            ids = [b"".join(voc.encode(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [id_col, "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary")


def decode_documents(encoded: DataFrame, file: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, text decoded from ``ids``; null ids give the empty text."""
    ship(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        voc = vocabulary(file)
        for b in batches:
            texts = ["".join(voc.decode([x or b""])) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def encode_and_decode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256, lossless, ids.

    The ids given out are themselves decoded, DECODED of them at a time; lossless
    says whether the result is the text.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def row(voc: Vocabulary, text: str) -> tuple[int, str, str, bool, bytes]:
        ids = b"".join(voc.encode(text))
        out = hashlib.sha256()
        for piece in voc.decode(ids[k : k + 4 * DECODED] for k in range(0, len(ids), 4 * DECODED)):
            out.update(piece.encode("utf-8", "surrogatepass"))
        same = out.digest() == hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), out.hexdigest(), same, ids

    types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary()]

    def run(batches):
        voc = vocabulary(file)
        for b in batches:
            rows = [row(voc, t or "") for t in b.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, types, strict=True))], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "lossless", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, lossless boolean, ids binary")


def round_trip(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256, lossless.

    Ids and decoded text go by in blocks and only their digests are held.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(voc: Vocabulary, text: str) -> tuple[int, str, str]:
        ids, out, n = hashlib.sha256(), hashlib.sha256(), 0

        def tee():
            nonlocal n
            for block in voc.encode(text):
                ids.update(block)
                n += len(block) // 4
                yield block

        for piece in voc.decode(tee()):
            out.update(piece.encode("utf-8", "surrogatepass"))
        return n, ids.hexdigest(), out.hexdigest()

    def run(batches):
        voc = vocabulary(file)
        for b in batches:
            rows = [digest(voc, t or "") for t in b.column(1).to_pylist()]
            n, ids, out = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
