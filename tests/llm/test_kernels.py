"""Array kernels against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lacewing.llm.kernel import Words, chunks, shingles, strings

TEXT = st.text(alphabet="aBé \n\t,", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 4))
def test_words_and_shingles(texts, n):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [[w for w in (t or "").translate(lower).replace("\n", " ").replace("\t", " ").split(" ") if w] for t in texts]
    data, off = strings(pa.array(texts, pa.string()))
    seen: dict = {}
    rows = []
    for _, _, piece, own in chunks(data, off, 16):
        w = Words(piece, own)
        g, to = shingles(w, n)
        for k in range(len(own) - 1):
            rows.append((w.hash[w.off[k] : w.off[k + 1]].tolist(), g[to[k] : to[k + 1]].tolist()))
    assert [len(h) for h, _ in rows] == [len(x) for x in want]
    for (hashes, grams), ws in zip(rows, want, strict=True):
        for h, w in zip(hashes, ws, strict=True):
            assert seen.setdefault(w, h) == h
        plain = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)] or ([tuple(ws)] if ws else [])
        for g, p in zip(grams, plain, strict=True):
            assert seen.setdefault((n, p), g) == g
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns_and_nulls():
    col = pa.array(["x y", None, "", "z"]).slice(1)
    data, off = strings(col)
    assert bytes(data) == b"z" and off.tolist() == [0, 0, 0, 1]
    assert np.array_equal(Words(data, off).counts(), [0, 0, 1])
