"""BPE transducer and range coder: equality with the library, exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lacewing.llm import rans
from lacewing.llm.bpe import Vocabulary, decode_documents, encode_documents, round_trip
from lacewing.llm.shared import Workspace

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n x", "it's  été 中文字 ²³ªº _x_", "<|endoftext|>a <|endoftext|>", "a\x1cb\x85c\xa0 d", "=-" * 900, "x" * 3000 + " " * 3000 + "y", "é İ Σας ΣΑΣ ﬁ"]


@pytest.fixture(scope="module")
def voc():
    return Vocabulary(BYTE)


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(BYTE)


def ids_of(voc, text):
    return np.frombuffer(b"".join(voc.encode(text)), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoding_equals_library(text):
    v, t = _pair()
    assert ids_of(v, text) == t.encode(text, add_special_tokens=False).ids


_CACHE: list = []


def _pair():
    if not _CACHE:
        _CACHE.extend([Vocabulary(BYTE), Tokenizer.from_file(BYTE)])
    return _CACHE


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(voc, lib, text):
    ids = ids_of(voc, text)
    assert ids == lib.encode(text, add_special_tokens=False).ids
    blocks = (np.array([i], "<u4").tobytes() for i in ids)  # one id a block: characters span blocks
    assert "".join(voc.decode(blocks)) == lib.decode(ids, skip_special_tokens=False) == text


def test_stream_emits_within_lookahead(voc):
    """A token is final once ``lookahead`` bytes after it are known, whatever follows."""
    raw = ("the" * 300 + "abc" * 500).encode()
    whole = voc.merge(raw)
    assert list(voc.stream(raw[k : k + 7] for k in range(0, len(raw), 7))) == whole
    seen = []
    pieces = iter([raw[:1200]])
    for i in voc.stream(pieces):
        seen.append(i)
    assert voc.lookahead < 1000 and len(seen) > 0


def test_malformed_ids_decode_like_library(voc, lib):
    ids = [voc.base[0xC3], voc.base[0x28], voc.base[0xE2], voc.base[0x82]]
    assert "".join(voc.decode([np.array(ids, "<u4").tobytes()])) == lib.decode(ids, skip_special_tokens=False)


def test_round_trip_rows(spark, lib):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(0, ODD[3]), (99, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("text", "text").selectExpr("*", "1 as n_tokens", "'x' as ids")
    got = sorted(tuple(r) for r in round_trip(df, BYTE).collect())
    want = []
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    back = decode_documents(encode_documents(df, BYTE), BYTE).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((k, t or "") for k, t in rows)
    assert round_trip(df.where("false"), BYTE).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=400), st.integers(1, 5))
def test_blocks_round_trip(ids, repeat):
    ids = np.array(ids * repeat, np.uint32)
    table = rans.Table.of_counts(np.bincount(ids, minlength=1))
    body = rans.encode(ids, table)
    assert np.array_equal(rans.decode(body, table), ids)


def test_checkpoints_and_damage():
    ids = (np.random.default_rng(0).zipf(1.3, 700_000) % 40_000).astype(np.uint32)
    table = rans.Table.of_counts(np.bincount(ids))
    body = rans.encode(ids, table)
    step = rans.LANES * rans.INTERVAL
    assert np.array_equal(rans.decode(body, table, 1), ids[step:])
    assert np.array_equal(rans.decode(body, table, 1, 2), ids[step : 2 * step])
    with pytest.raises(ValueError):
        rans.decode(body[:-1] + bytes([body[-1] ^ 1]), table)
    with pytest.raises(ValueError):
        rans.decode(body, rans.Table.of_counts(np.bincount(ids) + 1))


def test_dataset(spark):
    lib = Tokenizer.from_file(WORD)
    rows = [(5, "B"), (3, None), (9, "c " * 500), *((k, t) for k, t in enumerate(ODD, 20)), (4, ""), (1, "Tail")]
    work = Workspace(spark, "test")
    rans.write(spark.createDataFrame(rows, "doc_id bigint, text string"), WORD, work.path("d"), work)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.documents(spark, work.path("d"), digest=True).collect()}
    start, want = 0, {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    work.close()


def test_text_without_a_place_to_cut(voc, lib, monkeypatch):
    monkeypatch.setattr("lacewing.llm.bpe.SLICE", 50)
    for text in ("ab1!" * 400, " " * 700, "\u4e2d\u6587" * 300, "a1" * 300 + " b" * 300):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(voc.encode(text)), "<u4").tolist() == ids


def test_dataset_of_odd_tables(spark):
    """Empty table, repeated and null ids, a very long text, clashing columns."""
    lib = Tokenizer.from_file(WORD)
    work = Workspace(spark, "test")
    rows = [(3, "same"), (3, "other words"), (3, "same"), (None, "no id"), (None, None), (-4, "w " * 60_000), (7, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as start", "'x' as ids", "2 as part", "3 as n_tokens")
    rans.write(table, WORD, work.path("d"), work)
    got = rans.documents(spark, work.path("d"), digest=True).collect()
    want = []
    for k, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((k is not None, k or 0, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order[:-1])]).tolist()
    assert [r.doc_id for r in order] == [None, None, -4, 3, 3, 3, 7]
    rans.write(table.where("false"), WORD, work.path("e"), work)
    assert rans.documents(spark, work.path("e"), digest=True).count() == 0
    work.close()
