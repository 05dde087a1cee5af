import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.functions import scorers as S
from lacewing.functions import text as T
from lacewing.operators import cluster as CL
from lacewing.operators import linking as L
from lacewing.operators import merge as M
from lacewing.operators import vector as VE
from lacewing.sources import readers as R
from lacewing.sources import sinks as K


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, want", [("  A  b\n", "a b"), ("", ""), (None, None)])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize, text) == want


@pytest.mark.parametrize("text, want", [("Red  Widget!", "red_widget"), ("--", "unknown"), ("", "unknown")])
def test_slugify(spark, text, want):
    assert one(spark, T.slugify, text) == want


def test_truncation_stops_but_key_sentences_skip(spark):
    long = "a " * 99 + "b"
    text = f"{long}. one two. " + "c " * 200 + ". d"
    assert one(spark, T.truncate_words, text) == f"{long}."
    kept = one(spark, lambda x: F.array_join(T.greedy_words(F.split(x, r"\. "), 103, skip=True), "|"), text)
    assert kept == f"{long}|one two|d"


def test_json_payload(spark):
    for raw in ('{"k": 1}', 'so ```json\n{"k": 1}\n``` ok', 'x {"k": 1} y'):
        assert json.loads(one(spark, T.json_payload, raw)) == {"k": 1}
    assert one(spark, T.json_payload, "nothing") is None


def test_merge_bonus_counts_articles_not_rows(spark):
    rows = [("h", "r", "t", a, 90, 90, 90) for a in (1, 1, 2)] + [("h", "r", "low", 1, 10, 10, 10)]
    got = M.merge_triples(spark.createDataFrame(rows, "head string, relation string, tail string, article int, c int, r int, k int")).collect()
    assert [(g.tail, g.members, g.evidence, round(g.confidence, 6)) for g in got] == [("t", 3, 2, 0.93)]


def test_fold_skips_after_rejection(spark):
    rows = [(0, 1, "a", "b", "KEEP_A"), (0, 2, "b", "c", "KEEP_B"), (0, 3, "c", "d", "KEEP_BOTH")]
    got = M.resolve_in_order(spark.createDataFrame(rows, "component int, seq bigint, a string, b string, decision string")).collect()
    assert [r.outcome for r in sorted(got, key=lambda r: r.seq)] == ["KEEP_A", "SKIPPED", "KEEP_BOTH"]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 101), (105, 101), (5, 5)]
    got = {r.node: r.root for r in CL.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 105: 100}
    assert CL.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_meet_all_edges_once(spark, monkeypatch):
    """Stars are made of a few edges a node; links between groups that are nobody's least or greatest neighbour join them."""
    met, stars = [], CL._stars

    def seen(edges):
        met.append(edges.count())
        return stars(edges)

    monkeypatch.setattr(CL, "_stars", seen)
    edges = [e for g in range(4) for j in range(9) for h in (g, 1000 + g) for e in ((h, 100 + 10 * g + j), (100 + 10 * g + j, h))] + [(101, 112), (112, 122), (None, 5), (7, 7)]
    edges += [(5000 + a, 5000 + b) for a in range(20) for b in range(a)]
    got = {r.node: r.root for r in CL.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {n: 0 if g < 3 else 3 for g in range(4) for n in (g, 1000 + g, *range(100 + 10 * g, 109 + 10 * g))} | dict.fromkeys(range(5000, 5020), 5000)
    assert got == want and len(met) == 2 and met[1] == 2


def vectors(spark, n=60):
    x = np.random.default_rng(3).normal(size=(n, 4))
    return x, spark.createDataFrame([(k, k % 3, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id bigint, label int, embedding array<double>")


def test_complete_linkage_keeps_every_pair_similar(spark):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = CL.complete_linkage(df, "label", 0.7).collect()
    assert len(got) == 60
    for a in got:
        for b in got:
            if (a.label, a.cluster) == (b.label, b.cluster):
                assert u[a.vec_id] @ u[b.vec_id] >= 0.7 - 1e-9


def test_first_fit_replayed(spark):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.vec_id: r.cluster for r in CL.first_fit(df, "label", 0.8, most=5).collect()}
    for label in range(3):
        clusters = []
        for k in range(label, 60, 3):
            for c in clusters:
                s = sum(u[m] for m in c)
                if len(c) < 5 and u[k] @ s / np.linalg.norm(s) >= 0.8:
                    c.append(k)
                    break
            else:
                clusters.append([k])
        assert all(got[m] == c[0] for c in clusters for m in c)


def test_top_k_in_blocks(spark):
    x, df = vectors(spark)
    q = df.where("vec_id < 7").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    got = VE.top_k(q, df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 3, query_rows=3).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(7):
        want = np.lexsort((np.arange(60), -(u @ u[k])))[:3].tolist()
        assert [r.id for r in sorted((g for g in got if g.q == k), key=lambda r: r["rank"])] == want


def test_scorer_retries_caches_and_falls_back(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "k string, p string")
    cache = spark.createDataFrame([("a", "old")], "k string, answer string")
    state = {"n": 0}

    def flaky(texts, state=state):
        state["n"] += 1
        if state["n"] == 1:
            raise RuntimeError
        return [t.upper() for t in texts]

    got = {r.k: (r.answer, r.status) for r in S.score(df.coalesce(1), "k", "p", flaky, lambda x: ["none"] * len(x), cache).collect()}
    assert got == {"a": ("old", "cached"), "b": ("Y", "retry_succeeded"), "c": ("none", "fallback")}
    assert S.usage(S.score(df, "k", "p", None, lambda x: ["n"] * len(x))).first().calls == 0
    assert S.render("{{a}} {b} {c}", a="x", b=[1]) == "x [1] {c}"
    assert not S.valid_payload("{}") and S.valid_payload(json.dumps(dict.fromkeys(S.PAYLOAD_KEYS)))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "kg").mkdir()
    graph = {"entities": [{"name": "A"}], "triples": [{"head": "A", "relation": "r", "tail": "B", "confidence": 0.5}]}
    (tmp_path / "kg" / "a1_kg.json").write_text(json.dumps(graph, indent=1))
    (tmp_path / "kg" / "unified_kg.json").write_text(json.dumps(graph))
    entities, triples = R.article_graphs(spark, str(tmp_path / "kg"))
    assert [(r.article_id, r.name) for r in entities.collect()] == [("a1", "A")]
    assert [(r.confidence, r.clarity) for r in triples.collect()] == [(0.5, 0.0)]
    row = {"selected_claim_id": "2", "claims": [{"claim_id": "1", "claim_text": "x"}, {"claim_id": "2", "claim_text": "y"}]}
    (tmp_path / "c.jsonl").write_text(json.dumps(row) + "\n" + json.dumps(row | {"selected_claim_id": "9"}) + "\n" + json.dumps({"claims": []}))
    assert sorted(r.claim_text for r in R.claims(spark, str(tmp_path / "c.jsonl")).collect()) == ["x", "y"]
    (tmp_path / "cat.csv").write_text("entity_id,name,entity_type,synonyms\n# seed\n1,A,T,a;b|c\n2,,T,\n")
    assert [r.synonyms for r in R.catalog(spark, str(tmp_path / "cat.csv")).collect()] == [["a", "b", "c"]]
    (tmp_path / "p.toml").write_text('[a]\nb = "t"\n')
    assert R.prompts(str(tmp_path / "p.toml"), ("a.b",))["a.b"] == "t"
    with pytest.raises(KeyError):
        R.prompts(str(tmp_path / "p.toml"), ("a.c",))
    assert R.document(spark, "some words").first().text == "some words"
    df = spark.createDataFrame([(1, "In", 3), (2, None, 4)], "id bigint, v string, n int")
    K.csv_split(df, F.col("v") == "In", str(tmp_path / "split"))
    assert spark.read.option("header", True).csv(str(tmp_path / "split/rejected")).count() == 1
    K.jsonl(df, str(tmp_path / "out"))
    lines = [x for part in (tmp_path / "out").glob("part-*") for x in part.read_text().splitlines()]
    assert sorted(json.loads(x)["id"] for x in lines) == [1, 2] and all(list(json.loads(x)) in (["id", "n", "v"], ["id", "n"]) for x in lines)
    K.upsert(df, df.where("id = 2").withColumn("n", F.lit(9)), "id", str(tmp_path / "up"))
    assert {r.id: r.n for r in spark.read.parquet(str(tmp_path / "up")).collect()} == {1: 3, 2: 9}
    K.vectors(df.withColumn("namespace", F.lit("x")), str(tmp_path / "vec"))
    assert R.vector_namespace(spark, str(tmp_path / "vec"), "x").count() == 2
    with pytest.raises(NotImplementedError):
        K.graph_store()


def test_command_line(spark, tmp_path, capsys):
    from lacewing.cli import main

    assert main(["list"]) == 0 and "agg_merge_triples" in capsys.readouterr().out
    assert main(["run", "agg_degree", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "o"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "o")).count() > 0


def test_alias_components_by_brute_force(spark):
    from lacewing.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    orders = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{folder}/orders.parquet").collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        if r.l_orderkey in orders:
            a, b = sorted((find(orders[r.l_orderkey]), find(-1 - r.l_partkey)))
            root[b] = a
    assert {r.node: r.root for r in QUERIES["clu_alias_unionfind"](spark, folder).collect()} == {x: find(x) for x in list(root)}


def test_fuzzy_links_by_brute_force(spark):
    import difflib

    from lacewing.operators import linking as L

    r = np.random.default_rng(7)
    names = ["".join(r.choice(list("abcde "), int(r.integers(1, 40)))) for _ in range(150)] + ["ab", "abc", "aaaaaaaaaaaaaa"]
    mentions = []
    for x in names * 3:
        y = list(x)
        for _ in range(int(r.integers(0, 4))):
            at = int(r.integers(0, len(y) + 1))
            y[at : at + int(r.integers(0, 2))] = list(r.choice(list("abcde"), int(r.integers(0, 2))))
        mentions.append("".join(y))
    got = L.fuzzy_link(spark.createDataFrame([(m,) for m in [*mentions, None]], "mention string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string"))
    got = {x.mention: x.name for x in got.collect()}
    want = {m: c[0] for m in set(mentions) - {""} if (c := difflib.get_close_matches(m, sorted(set(names)), n=1, cutoff=0.92))}
    assert got == want and len(want) > 150


def test_runs_resume_only_with_their_fingerprint(spark, tmp_path):
    from lacewing.streaming.runs import FingerprintMismatch, Run

    folder = f"file://{tmp_path}/run"
    run = Run(spark, folder)
    assert run.prepare({"input": "a"}) is False and run.records("compose").count() == 0
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, v string")
    run.append("compose", rows, "id")
    run.append("compose", rows.where("id = 2").withColumn("v", F.lit("z")), "id")
    run.mark("compose", "done", 2)
    again = Run(spark, folder)
    assert again.prepare({"input": "a"}) is True and again.done("compose") and not again.done("critic")
    assert {r.key: json.loads(r.record)["v"] for r in again.records("compose").collect()} == {"1": "x", "2": "z"}
    more = spark.createDataFrame([(2, "n"), (3, "n")], "id bigint, v string")
    assert [r.id for r in again.pending("compose", more, "id").collect()] == [3]
    with pytest.raises(FingerprintMismatch):
        Run(spark, folder).prepare({"input": "b"})
    fresh = Run(spark, folder)
    assert fresh.prepare({"input": "b"}, resume=False) is False and fresh.records("compose").count() == 0


def test_scorers_of_many_items_and_embeddings(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "bad")], "k bigint, t string")
    tries = {"n": 0}

    def scorer(texts, tries=tries):
        tries["n"] += 1
        return ["no list" if t == "bad" and tries["n"] < 9 else json.dumps([{"name": w} for w in t.split()]) for t in texts]

    got = S.score_many(df.coalesce(1), "k", "t", scorer, lambda x: ['[{"name": "default"}]'] * len(x), "name string").collect()
    assert sorted((r.k, r.pos, r.name, r.status) for r in got) == [(1, 0, "a", "ok"), (1, 1, "b", "ok"), (3, 0, "default", "fallback")]
    vectors = S.embedded(df, "k", "t", lambda texts: [[len(t), 1] for t in texts]).collect()
    assert sorted((r.k, r.embedding) for r in vectors) == [(1, [3.0, 1.0]), (2, [0.0, 1.0]), (3, [3.0, 1.0])]


@pytest.mark.parametrize("block", [1024, 7])
def test_complete_links_by_brute_force(spark, block, monkeypatch):
    """In parts as over the whole key: the nearest two clusters merge while all of their pairs are close."""
    from lacewing.operators import cluster as CL

    monkeypatch.setattr(CL.linked_parts, "__defaults__", (block,))
    r = np.random.default_rng(11)
    x = np.repeat(r.normal(size=(12, 5)), 5, 0) + r.normal(size=(60, 5)) * 0.35
    rows = [(k, k % 2, x[k].tolist()) for k in range(60)]
    got = {g.vec_id: g.cluster for g in CL.complete_linkage(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"), "label", 0.6).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for label in (0, 1):
        clusters = [[k] for k in range(60) if k % 2 == label]
        while True:
            far = [(max(1 - u[a] @ u[b] for a in p for b in q), p, q) for i, p in enumerate(clusters) for q in clusters[i + 1 :]]
            d, p, q = min(far, key=lambda f: f[0])
            if d > 0.4:
                break
            clusters.remove(q)
            p.extend(q)
        want |= {k: min(c) for c in clusters for k in c}
    assert got == want and len(set(want.values())) < 50


def pairs_table(spark, n=90):
    """Vectors with copies, a null, a null component, a zero vector, another length, an id twice, a label of one row and none."""
    rng = np.random.default_rng(5)
    rows = [(k, k % 3, rng.normal(size=4).tolist()) for k in range(n)]
    rows += [(n + k, 0, rows[0][2]) for k in range(5)]
    rows += [(200, 0, None), (201, 1, [1.0, None, 0.0, 0.0]), (202, 2, [0.0] * 4), (203, 2, [1.0] * 3), (7, 1, [1.0, 0.0, 0.0, 0.0]), (204, 8, [1.0] * 4), (205, None, [1.0] * 4), (206, 9, None), (207, 9, None)]
    return rows, spark.createDataFrame(rows, "id bigint, k int, x array<double>")


def plain_cosine(x, y):
    if x is None or y is None or len(x) != len(y) or None in x or None in y:
        return None
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return float(np.dot(x, y) / n) if n else 0.0


@pytest.mark.parametrize("block", [7, 4096])
def test_extremes_of_pairs_by_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(VE.block_pairs, "__defaults__", (block,))
    monkeypatch.setattr(VE, "TILE", 5)
    rows, df = pairs_table(spark)
    want = {}
    for i, k, x in rows:
        for j, other, y in rows:
            if k is not None and k == other and i < j:
                want.setdefault(k, []).append(plain_cosine(x, y))
    assert {r.k: r.pairs for r in VE.pair_counts(df).collect()} == {k: len(v) for k, v in want.items()}
    got = {r.k: (round(r.least, 9), round(r.most, 9)) for r in VE.extremes(df).collect()}
    known = {k: [x for x in v if x is not None] for k, v in want.items()}
    assert got == {k: (round(min(v), 9), round(max(v), 9)) for k, v in known.items() if v}


@pytest.mark.parametrize("name", ["vec_sim_matrix", "agg_intra_cluster"])
def test_pairs_of_a_label_are_met_by_blocks(spark, name, tmp_path):
    """A label of 1,500 rows goes through no join of rows with rows."""
    from lacewing.catalog import QUERIES

    rng = np.random.default_rng(2)
    spark.createDataFrame([(k, rng.normal(size=4).tolist(), 0) for k in range(1500)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "vec_id" not in "".join(x for x in plan.splitlines() if " Join " in x) and "FlatMapGroupsInArrow" in plan
    assert df.count() == 1


def canonical_tables(spark, folder):
    """Head 1 has 45 tails of one line each, head 2 two tails in three lines, head 3 one line without a brand."""
    lines = [(k, 1, k, 1) for k in range(45)] + [(50, 2, 0, 1), (51, 2, 0, 2), (52, 2, 1, 1), (53, 3, 99, 1)]
    kinds = "l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string, l_discount double, l_quantity double, l_tax double"
    rows = [(o, s, p, n, "NAR"[o % 3], 0.01 * (o % 5), 10.0 + o % 7, 0.02 * (o % 3)) for o, s, p, n in lines]
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, f"Brand#{k % 45}" if k < 90 else None) for k in range(100)], "p_partkey bigint, p_brand string").write.parquet(f"{folder}/part.parquet")


def test_canonical_core_where_no_tail_is_common(spark, tmp_path):
    from oracle import duckdb, oracle_rows, rows

    from lacewing.catalog import ORACLES, QUERIES

    canonical_tables(spark, tmp_path)
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert rows(QUERIES["agg_canonical_v2"](spark, str(tmp_path))) == oracle_rows(con, ORACLES["agg_canonical_v2"])


def test_canonical_edge_has_all_its_parts(spark, tmp_path):
    from lacewing.catalog import QUERIES

    canonical_tables(spark, tmp_path)
    got = {r["head"]: r for r in QUERIES["agg_canonical_v2"](spark, str(tmp_path)).collect()}
    assert (got[1].core, got[1].claim, got[1].relations) == ("Brand#0|Brand#1", "1 associated_with Brand#12", "associated_with:15|increases:15|reduces:15")
    assert (got[2].core, got[2].n, got[2].articles, got[3].core, got[3].claim) == ("Brand#0|Brand#1", 3, "10|11|12", None, None)


@pytest.mark.parametrize("block", [3, 256])
def test_first_fit_in_blocks(spark, block):
    """Many clusters a label, with and without room, copies among the rows."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 5))
    x[100:130] = x[7]
    df = spark.createDataFrame([(k, int(k % 2), v.tolist()) for k, v in enumerate(x)], "vec_id bigint, label int, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for most in (None, 4):
        got = {r.vec_id: r.cluster for r in CL.first_fit(df, "label", 0.7, most=most, block=block).collect()}
        for label in range(2):
            clusters = []
            for k in range(label, len(x), 2):
                for c in clusters:
                    s = sum(u[m] for m in c)
                    if (most is None or len(c) < most) and u[k] @ s / np.linalg.norm(s) >= 0.7:
                        c.append(k)
                        break
                else:
                    clusters.append([k])
            assert {m: got[m] for c in clusters for m in c} == {m: c[0] for c in clusters for m in c}


@pytest.mark.parametrize("block", [7, 4096])
def test_cosines_of_pairs_by_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(VE.block_pairs, "__defaults__", (block,))
    monkeypatch.setattr(VE, "TILE", 5)
    rows, df = pairs_table(spark)
    want = [(i, j, plain_cosine(x, y)) for i, k, x in rows for j, other, y in rows if i % 5 == 0 and k is not None and k == other and i != j]
    shown = lambda d: sorted(str((a, b, None if s is None else round(s, 9) + 0.0)) for a, b, s in d)
    assert shown(VE.pair_cosines(df.where("id % 5 = 0"), df).collect()) == shown(want)


@pytest.mark.parametrize("block", [7, 4096])
def test_foremost_by_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(VE.block_pairs, "__defaults__", (block,))
    monkeypatch.setattr(VE, "TILE", 5)
    rows, df = pairs_table(spark)
    want = {}
    for i, k, x in rows:
        for j, other, y in rows:
            if i % 5 == 0 and j % 5 and k is not None and k == other:
                s = plain_cosine(x, y)
                s = None if s is None else round(s, 2)
                want[i] = min(want.get(i, (9, 0)), (-s, j) if s is not None and s >= 0.3 and (i + j) % 3 else (9, 0))
    parts = L.foremost(df.where("id % 5 = 0"), df.where("id % 5 <> 0"), lambda s, q, i: (s >= 0.3) & ((q + i) % 3 != 0), places=2)
    got = {}
    for r in parts.collect():
        got[r.q] = min(got.get(r.q, (9, 0)), (9, 0) if r.score is None else (round(-r.score, 2), r.id))
    assert got == want


def test_top_k_ties_by_rounded_score(spark, monkeypatch):
    """Rounded scores decide, then ids; small tiles; fewer rows than k."""
    monkeypatch.setattr(VE, "QUERIES", 2)
    monkeypatch.setattr(VE, "ROWS", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, v array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = df.where("id < 7").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = {}
    for r in VE.top_k(q, df, 4, query_rows=3, places=1).collect():
        got[r.q, r["rank"]] = r.id
    for k in range(7):
        assert [got[k, n] for n in range(1, 5)] == np.lexsort((np.arange(80), -np.round(u @ u[k], 1)))[:4].tolist()
    assert VE.top_k(q, df.where("id < 2"), 4, places=1).count() == 14


def line_table(spark, folder, rows):
    kinds = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_discount double, l_quantity double, l_tax double"
    spark.createDataFrame([(*r, "NAR"[k % 3], 0.01 * (k % 9), 10.0, 0.02) for k, r in enumerate(rows)], kinds).write.parquet(f"{folder}/lineitem.parquet")


@pytest.mark.parametrize("many", [3, 32])
def test_shared_parts_by_brute_force(spark, tmp_path, many):
    """Orders larger than ``many`` parts meet small and large ones through single parts."""
    from lacewing.plans import ranking_queries as R
    from lacewing.registry import Tables

    rng = np.random.default_rng(3)
    sets = {k: set(rng.choice(14, size=int(rng.integers(1, 8)), replace=False).tolist()) for k in range(40)}
    line_table(spark, tmp_path, [(k, p, 0, n) for k, s in sets.items() for n, p in enumerate([*s, min(s)])])
    got = sorted(tuple(r) for r in R.shared_parts(Tables(spark, str(tmp_path)), many).select("a", "b", "c", "na", "nb").collect())
    assert got == sorted((a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > 1)


@pytest.mark.parametrize("lines", [5, 1 << 20])
def test_pairs_of_parts_of_one_order_are_not_joined(spark, tmp_path, monkeypatch, lines):
    """More lines are dealt into more parts; without a large order no single parts are met."""
    from lacewing.plans import ranking_queries as R
    from lacewing.registry import Tables

    monkeypatch.setattr(R, "LINES", lines)
    sets = {k: {k % 7, 10 + k % 5, 20 + k, 90 + k} for k in range(40)} | {50: {0, 10}, 51: {3}}
    line_table(spark, tmp_path, [(k, p, 0, n) for k, s in sets.items() for n, p in enumerate(s)] + [(None, 1, 0, 9), (50, None, 0, 9)])
    t = Tables(spark, str(tmp_path))
    met = R.shared_parts(t)
    assert sorted(tuple(r) for r in met.select("a", "b", "c").collect()) == sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > 1)
    assert "Generate" not in plan_of(met)
    assert R.dealt(t.lineitem, 165, "l_orderkey").rdd.getNumPartitions() == (33 if lines == 5 else 4)


def test_sets_of_parts_are_read_by_as_many_tasks_as_wrote_them(spark, tmp_path, monkeypatch):
    """Pairs are made from few orders a task, however small the files of kept orders are."""
    from lacewing.plans import ranking_queries as R
    from lacewing.registry import Tables

    tasks, dealt = [], R.dealt
    monkeypatch.setattr(R, "LINES", 20)
    monkeypatch.setattr(R, "dealt", lambda df, *a: tasks.append(df.rdd.getNumPartitions()) or dealt(df, *a))
    sets = {k: {k % 7, 10 + k % 5, 20 + k} for k in range(80)}
    line_table(spark, tmp_path, [(k, p, 0, n) for k, s in sets.items() for n, p in enumerate(s)])
    met = R.shared_parts(Tables(spark, str(tmp_path)))
    assert sorted(tuple(r) for r in met.select("a", "b", "c").collect()) == sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > 1)
    assert tasks[1] > 9


def test_relations_of_both_ways_from_one_pass(spark):
    """The pairs of the second way come from those of the first, not from a second search."""
    from lacewing.catalog import QUERIES

    df = QUERIES["clu_relations"](spark, "/root/testdata/sf0.001")
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in df.collect()]
    assert sorted(rows) == sorted((b, a, r) for a, b, r in rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 100])
def test_second_hop_without_the_whole_incidence(spark, tmp_path, monkeypatch, few):
    """Both ways of the gate, with ids sent whole and joined; a met gate plans no second hop."""
    from lacewing.plans import ranking_queries as R
    from lacewing.registry import Tables

    monkeypatch.setattr(R, "FEW", few)
    line_table(spark, tmp_path, [(1, 2, 7, 1), (1, 9, 7, 2), (1, 9, 7, 2), (2, 9, 8, 1), (3, 50, 8, 1), (4, 60, 5, 1)])
    spark.createDataFrame([(k, k) for k in range(1, 5)], "o_orderkey bigint, n bigint").write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    assert sorted(r.edge for r in R.second_hop(t, "n > 2").collect()) == [1, 2, 3]
    met = R.second_hop(t, "n = 2")
    assert sorted(r.edge for r in met.collect()) == [1, 2] and "l_suppkey" not in plan_of(met)


@pytest.mark.parametrize("few", [0, 100])
def test_second_hop_joins_only_rows_of_chunks_not_met(spark, tmp_path, monkeypatch, few):
    """Edge 2 leads to 5 by a chunk of which no row has an entity that was met."""
    from lacewing.plans import ranking_queries as R
    from lacewing.registry import Tables

    plans, held = [], R.held
    monkeypatch.setattr(R, "FEW", few)
    monkeypatch.setattr(R, "held", lambda ids: plans.append(plan_of(ids)) or held(ids))
    line_table(spark, tmp_path, [(1, 2, 7, 1), (1, 9, 7, 2), (2, 9, 8, 1), (2, 70, 6, 2), (3, 50, 8, 1), (4, 60, 4, 1), (5, 80, 6, 1), (6, 90, None, 1), (2, 91, None, 3)])
    spark.createDataFrame([(k, k) for k in range(1, 7)], "o_orderkey bigint, n bigint").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.edge for r in R.second_hop(Tables(spark, str(tmp_path)), "n > 2").collect()) == [1, 2, 3, 5]
    assert any("LeftAnti" in p for p in plans)


def test_first_lines_of_an_entity_are_cut_before_they_are_dealt(spark, tmp_path):
    from oracle import duckdb, oracle_rows, rows

    from lacewing.catalog import ORACLES, QUERIES

    line_table(spark, tmp_path, [(k // 3, k % 4, k % 3, k % 2) for k in range(400)])
    spark.createDataFrame([(k, f"Brand#{k % 3}") for k in range(4)], "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES["jn_triples_by_entity"](spark, str(tmp_path))
    assert rows(df) == oracle_rows(con, ORACLES["jn_triples_by_entity"])
    assert plan_of(df).count("WindowGroupLimit") > 2


def test_risk_gate_deals_lines_once(spark):
    from lacewing.catalog import QUERIES

    plan = QUERIES["rt_risk_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
