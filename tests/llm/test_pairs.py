"""Top-k, near-duplicates and the pipeline against brute force."""

import hashlib
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.llm import bpe, neardup, topk
from lacewing.llm import components as C
from lacewing.llm.shared import Workspace

SF = "/root/testdata/sf0.001"


def brute_top(rows, k=5):
    v = {}
    for i, x in rows:
        if i is None or x is None or not len(x) or any(c is None or not np.isfinite(c) for c in x):
            continue
        v.setdefault(i, []).append([int(np.floor(256 * float(c))) for c in x])
    out = []
    for q in sorted(i for i in v if i % 50 == 0):
        mine = min(v[q])
        s = sorted((-max(int(np.dot(mine, c)) for c in cs if len(c) == len(mine)), i) for i, cs in v.items() if i != q and any(len(c) == len(mine) for c in cs))
        out += [(q, r + 1, i, -m) for r, (m, i) in enumerate(s[:k])]
    return out


@pytest.mark.parametrize("blocks", [(4096, 32768, 32768), (7, 3, 20)])
def test_top_k(spark, monkeypatch, blocks):
    for name, n in zip(("SEED_ROWS", "QUERY_ROWS", "BLOCK_ROWS"), blocks, strict=True):
        monkeypatch.setattr(topk, name, n)
    r = np.random.default_rng(1)
    rows = [(k, [float(np.float32(x)) for x in r.normal(size=6).round(1)]) for k in range(420)]
    rows += [(500, [1.0] * 6), (501, [1.0] * 6), (502, None), (550, [float("nan")] + [0.0] * 5), (600, [float("inf")] * 6), (650, [0.0] * 6), (700, [1.0, 2.0]), (None, [1.0] * 6), (3, [9.0] * 6), (750, [None] + [1.0] * 5), (800, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_bound_is_the_largest_product():
    r = np.random.default_rng(2)
    for _ in range(200):
        q, caps, longest = np.abs(r.normal(size=5)) + 0.01, r.uniform(0, 2, 5), r.uniform(0.1, 4)
        got = topk.bound(q, caps, longest)
        v = np.minimum(np.abs(r.normal(size=(4000, 5))), caps)
        v *= np.minimum(1, longest / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9))
        assert (v @ q).max() <= got + 1e-9
        low, high = 0.0, 1e6  # the multiple of q at which the capped vector has the length allowed
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.linalg.norm(np.minimum(mid * q, caps)) <= longest else (low, mid)
        assert np.isclose(got, np.minimum(low * q, caps) @ q, rtol=1e-6)


def test_walks_of_clustered_vectors_stop_early():
    r = np.random.default_rng(3)
    centre = r.normal(size=(200, 32))
    v = np.repeat(centre, 20, 0) + r.normal(size=(4000, 32)) * 0.05
    v = np.floor(256 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    block = topk.Lists(np.arange(4000), v)
    for q in range(0, 4000, 100):
        ids, scores = block.search(q, v[q], 5, None)
        want = v @ v[q]
        want[q] = -(10**9)
        assert sorted(scores.tolist()) == sorted(want)[-5:]
    assert block.scored < 0.2 * 40 * 4000


def test_large_components_are_exact(spark):
    rows = [(k, [float((k * 7919) % 1000003 + 0.5), float(k)]) for k in range(120)]
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows)


def brute_groups(rows, n, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in rows:
        w = (t or "").translate(lower).split()
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((k, len(sets[k]), find(k), find(k) == k) for k in keys)


def corpus():
    r = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    base = [list(r.choice(words, 90)) for _ in range(6)]
    rows = []
    for g, b in enumerate(base):  # near copies of falling likeness, many in the first group
        for c in range(60 if g == 0 else 8):
            x = b.copy()
            for p in r.choice(90, int(r.integers(0, 14)), replace=False):
                x[p] = str(r.choice(words))
            rows.append(" ".join(x))
    rows += [rows[0]] * 5 + ["Only Two", "only two", "one", "one", "ONE", "", " ", None, "a b c", "a b d"]
    chain = list(r.choice(words, 120))
    for c in range(12):  # each like the next only
        chain = chain[2:] + list(r.choice(words, 2))
        rows.append(" ".join(chain))
    return list(enumerate(rows))


@pytest.mark.parametrize("n, small, block", [(2, 16, 512), (5, 3, 8)])
def test_near_duplicates(spark, monkeypatch, n, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("x")).withColumn("id", F.lit(0)).repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, n=n).collect())
    assert got == brute_groups(rows, n)


def test_near_duplicates_of_about_k_shingles(spark):
    rows = []
    for a, b, both in ((64, 64, 57), (64, 62, 56), (62, 61, 55), (60, 58, 53), (54, 52, 48), (64, 52, 52), (64, 64, 56), (70, 64, 60)):
        for c in range(20):
            word = [f"w{a}x{b}x{both}x{c}x{k}" for k in range(a + b - both)]
            rows += [" ".join(word[:a]), " ".join(word[a - both :])]
    rows = list(enumerate(rows))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), n=1).collect())
    assert got == brute_groups(rows, 1)
    assert sum(not kept for *_, kept in got) == 140  # all pairs but those of 64, 64 and 56: 0.78


def test_no_link_is_lost_between_sets_about_k(spark):
    """A set of up to K shingles inside or beside one of other size, at 0.78 to 0.85, in groups of their own."""
    rows, pair = [], []
    r = np.random.default_rng(8)
    for a in range(40, 91, 3):
        for b in range(int(0.8 * a), a + 1, 4):
            for share in (0.78, 0.8, 0.81, 0.85):
                both = min(b, int(np.ceil(share * (a + b) / (1 + share))))
                for c in range(3):
                    word = [f"w{int(r.integers(1 << 40))}" for _ in range(a + b - both)]
                    pair.append((len(rows), 100 * both >= 80 * (a + b - both)))
                    rows += [" ".join(word[:a]), " ".join(word[a - both :])]
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), n=1).collect()}
    assert [got[k + 1] == k for k, _ in pair] == [linked for _, linked in pair] and sum(x for _, x in pair) > 500


def test_deduplicate_keeps_columns_and_odd_rows(spark):
    df = spark.createDataFrame([(3, "x y z u v w", "a"), (1, "X y z u v w", "b"), (2, None, "c"), (4, "", "d"), (None, "p q", "e")], "doc_id bigint, text string, _slot string")
    got = neardup.deduplicate(df.withColumnRenamed("_slot", "root"))
    assert got.columns == ["doc_id", "text", "root"] and sorted(r.root for r in got.collect()) == ["b", "c", "d", "e"]
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    work = Workspace(spark, "test")
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (105, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a bigint, b bigint"), work, "t").collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 105: 100}
    assert C.components(spark.createDataFrame([], "a bigint, b bigint"), work, "e").count() == 0
    ids = spark.range(0, 5000, 7)
    f = C.IdFilter(ids)
    slots = spark.range(7000).select("id", C.IdFilter.slot("id").alias("s")).toPandas()
    hit = f.test(slots["s"].to_numpy())
    assert hit[slots["id"].to_numpy()[slots["id"].to_numpy() < 5000][::7]].all() and hit.sum() < 800
    work.close()


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    from lacewing.llm.queries import BYTE_BPE, tokenizer_file

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    work = Workspace(spark, "test")
    kept = []
    for name, stage in P.STAGES[:-1]:
        after = work.cut(stage(spark, docs, SF), name)
        assert after.columns == docs.columns
        before_ids, ids = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= before_ids
        if name == "near_duplicates":
            want = {k for k, _, _, keep in brute_groups([(r.doc_id, r.text) for r in docs.collect()], 5) if keep}
            assert ids == want
        if name == "decontamination":
            bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not [r for r in after.collect() if any(b in r.text for b in bench)]
        if name == "pii":
            assert ids == before_ids and not after.where(r"text rlike '[a-z]+[.][0-9]+@mail'").count() and not after.where("length(text) <> n_chars").count()
        kept.append(len(ids))
        docs = after
    assert kept == sorted(kept, reverse=True) and kept[0] < 200 and kept[-1] > 50
    lib = Tokenizer.from_file(tokenizer_file(BYTE_BPE))
    text = {r.doc_id: r.text for r in docs.collect()}
    out = P.run(spark, SF).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in out} == {k: lib.encode(t, add_special_tokens=False).ids for k, t in text.items()}
    work.close()


def test_pipeline_tokens_are_decoded(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(1, "plain words"), (2, None), (3, ""), (4, "\u00e4\u4e2d\U0001f600 <|endoftext|> x"), (5, "ab \u4e2d" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = {r.doc_id: r for r in P.tokens(spark, docs, SF).collect()}
    assert {k: (r.decoded_sha256, r.lossless) for k, r in out.items()} == {k: (sha(t or ""), True) for k, t in rows}
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in out.values())
    spec = json.loads(Path(P.tokenizer_file(P.BYTE_BPE)).read_text())
    spec["model"]["vocab"]["x"], spec["model"]["merges"] = spec["model"]["vocab"]["y"], []  # one id for two bytes: it can't decode to both
    (tmp_path / "v.json").write_text(json.dumps(spec))
    bad = bpe.encode_and_decode(spark.createDataFrame([(1, "axb"), (2, "ab")], "doc_id long, text string"), str(tmp_path / "v.json")).collect()
    assert {r.doc_id: (r.lossless, r.decoded_sha256 == sha("ayb")) for r in bad} == {1: (False, True), 2: (True, False)}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows, very long texts, columns with names used within."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert P.run(spark, f"{tmp_path}/empty").count() == 0
    own = " ".join(f"unique{k}" for k in range(30_000))
    odd = [(None, "no id but words"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, own), (10**6 + 2, own), (10**6 + 3, "mail me at some.body@mail.example now please all of you")]
    more = spark.createDataFrame(odd, "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' as lang", "cast(null as string) as source", f"cast(length(text) as {docs.schema['n_chars'].dataType.simpleString()}) as n_chars")
    table = docs.limit(60).unionByName(more).selectExpr("*", "1 as id", "2 as _slot_", "'x' as spans", "3 as digest", "4 as root", "5 as ratio", "6 as term")
    table.write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(f"{tmp_path}/odd/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        after = stage(spark, now, f"{tmp_path}/odd")
        assert after.columns == now.columns
        now = after
    texts = {(r.doc_id, r.text) for r in now.collect()}
    assert (None, "no id but words") in texts and not any(k in (10**6, 10**6 + 1) for k, _ in texts)
    assert sum(k == 10**6 + 2 for k, _ in texts) == 1 and any("[EMAIL]" in t for k, t in texts if k == 10**6 + 3)
    out = P.run(spark, f"{tmp_path}/odd").collect()
    assert all(r.lossless for r in out) and {r.doc_id for r in out} == {k for k, _ in texts}
