"""Windows, sorts, set operations, vectors, clustering and graph expansion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cluster as CL
from ..operators import vector as VE
from ..registry import query
from ..sources.binding import INCIDENCE, TRIPLES, incidence, triples
from .relational_queries import join_sorted
from .text_queries import LINES_SQL, lines

VECTORS = "v as (select vec_id, label, cast(embedding as double[]) as e from embeddings)"
COS = "round(list_cosine_similarity(q.e, c.e) * 1e6)"


def micro(c, name):
    return F.round(c * 1e6).cast("bigint").alias(name)


def vectors(t):
    return VE.doubles(t.embeddings)


def by_label(t):
    return t.embeddings.select(F.col("label").alias("k"), F.col("vec_id").alias("id"), F.col("embedding").alias("x"))


# ---- windows


@query("win_rank_annotate", f"with {VECTORS}, s as (select q.vec_id as q, c.vec_id as id, {COS} as s from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0), r as (select q, id, s, row_number() over (partition by q order by s desc, id) as n from s) select q, id, cast(n as integer) as rank from r where n <= 5")
def win_rank_annotate(t):
    d = vectors(t)
    q = d.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    hits = VE.top_k(q, d.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 6, places=6).where("q <> id")
    order = W.partitionBy("q").orderBy(F.desc(F.round(F.col("score") * 1e6)), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("q", "id", "rank")


@query("win_merge_dedupe", f"with {VECTORS}, s as (select q.vec_id as q, c.vec_id as id, {COS} as s from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0), r as (select *, row_number() over (partition by q order by s desc, id) as n from s) select id, cast(max(s) as bigint) as score, string_agg(cast(q as varchar), '|' order by q) as queries from r where n <= 5 group by id")
def win_merge_dedupe(t):
    d = vectors(t)
    q = d.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    hits = VE.top_k(q, d.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 6, places=6).where("q <> id")
    hits = hits.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc(F.round(F.col("score") * 1e6)), "id"))).where("n <= 5")
    return hits.groupBy("id").agg(micro(F.max("score"), "score"), join_sorted(F.collect_list("q"), "queries"))


@query("win_topk_per_group", "with r as (select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_linenumber) as n from lineitem) select l_orderkey, l_linenumber, l_partkey from r where n <= 3")
def win_topk_per_group(t):
    order = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    return t.lineitem.withColumn("n", F.row_number().over(order)).where("n <= 3").select("l_orderkey", "l_linenumber", "l_partkey")


@query("win_packet_triples", f"with {TRIPLES}, r as (select *, row_number() over (partition by article order by c desc, r desc, k desc, l_orderkey, l_linenumber, head) as n from triples) select article, l_orderkey, l_linenumber, head from r where n <= 60")
def win_packet_triples(t):
    order = W.partitionBy("article").orderBy(F.desc("c"), F.desc("r"), F.desc("k"), "l_orderkey", "l_linenumber", "head")
    return triples(t).withColumn("n", F.row_number().over(order)).where("n <= 60").select("article", "l_orderkey", "l_linenumber", "head")


@query("win_last_write", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def win_last_write(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("win_section_body", f"with {LINES_SQL}, s as (select doc_id, pos, line, sum(case when length(line) < 60 then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) as sec from lines) select doc_id, cast(sec as bigint) as sec, count(*) as n, cast(sum(length(line)) as bigint) as chars from s group by 1, 2")
def win_section_body(t):
    order = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    s = lines(t).select("doc_id", F.length("line").alias("n"), F.sum(F.when(F.length("line") < 60, 1).otherwise(0)).over(order).alias("sec"))
    return s.groupBy("doc_id", "sec").agg(F.count("*").alias("lines"), F.sum("n").alias("chars")).withColumnRenamed("lines", "n")


@query("win_dup_suffix", "select o_orderkey, case when n = 1 then 'P:' || o_custkey else 'P:' || o_custkey || ':dup' || (n - 1) end as packet from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)")
def win_dup_suffix(t):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    base = F.concat(F.lit("P:"), F.col("o_custkey").cast("string"))
    return t.orders.withColumn("n", n).select("o_orderkey", F.when(F.col("n") == 1, base).otherwise(F.concat(base, F.lit(":dup"), (F.col("n") - 1).cast("string"))).alias("packet"))


def global_number(df, order: str, name: str):
    """1, 2, ... over the whole order without one task for all rows: ranges are counted, then numbered apart."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.approxQuantile(order, [k / parts for k in range(1, parts)], 0.1 / parts)
    bucket = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    d = df.withColumn("_b", bucket)
    sizes = {r["_b"]: r["n"] for r in d.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # a row for each range
    ahead, n = [], 0
    for b in sorted(sizes):
        ahead += [F.lit(b), F.lit(n).cast("bigint")]
        n += sizes[b]
    start = F.try_element_at(F.create_map(*ahead), F.col("_b")) if ahead else F.lit(0)
    return d.withColumn(name, F.row_number().over(W.partitionBy("_b").orderBy(order)) + start).drop("_b")


@query("win_renumber", "select event_id, printf('REV:%06d', row_number() over (order by event_id)) as review from events where value > 10")
def win_renumber(t):
    return global_number(t.events.where("value > 10"), "event_id", "n").select("event_id", F.format_string("REV:%06d", "n").alias("review"))


@query("win_dup_table_page", "with a as (select page_id, unnest(range(len(k))) as i, unnest(k) as h from (select page_id, regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)<', 1) as k from pages)), b as (select page_id, unnest(range(len(k))) as i, unnest(k) as p from (select page_id, regexp_extract_all(html, '<p[^>]*>([^<]*)<', 1) as k from pages)) select a.page_id, cast(a.i as integer) as i, h, p from a join b on a.page_id = b.page_id and a.i = b.i")
def win_dup_table_page(t):
    a = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>([^<]*)<"), F.lit(1))).alias("i", "h"))
    b = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<p[^>]*>([^<]*)<"), F.lit(1))).alias("i", "p"))
    return a.join(b, ["page_id", "i"]).select("page_id", "i", "h", "p")


@query("win_median_body", f"with {LINES_SQL}, m as (select doc_id, median(length(line)) as mid from lines group by 1) select l.doc_id, cast(pos as integer) as pos from lines l join m on l.doc_id = m.doc_id where length(line) >= 112e-2 * mid")
def win_median_body(t):
    d = lines(t).select("doc_id", "pos", F.length("line").alias("n"))
    m = d.groupBy("doc_id").agg(F.percentile("n", F.lit(0.5)).alias("mid"))
    return d.join(m, "doc_id").where(F.col("n") >= F.lit(1.12) * F.col("mid")).select("doc_id", "pos")


@query("win_dominance", "select p_partkey from part a where not exists (select 1 from part b where b.p_size >= a.p_size and b.p_retailprice >= a.p_retailprice and (b.p_size > a.p_size or b.p_retailprice > a.p_retailprice))")
def win_dominance(t):
    """Skyline on (size, price): best price of each size, then a running best from larger sizes."""
    best = t.part.groupBy("p_size").agg(F.max("p_retailprice").alias("best"))
    above = best.withColumn("above", F.max("best").over(W.orderBy(F.desc("p_size")).rowsBetween(W.unboundedPreceding, -1)))  # a row for each size
    d = t.part.join(above, "p_size")
    return d.where((F.col("p_retailprice") == F.col("best")) & (F.col("above").isNull() | (F.col("p_retailprice") > F.col("above")))).select("p_partkey")


@query("win_budget_admit", "with s as (select o_orderkey, o_orderstatus, o_orderpriority, case when o_orderstatus <> 'F' and o_orderpriority <> '5-LOW' then 1 else 0 end as cand from orders), r as (select *, sum(cand) over (order by o_orderkey rows unbounded preceding) as run, count(*) over () as n from s) select o_orderkey, case when o_orderstatus = 'F' then 'done' when o_orderpriority = '5-LOW' then 'auto' when run <= least(greatest(1, n // 10), 1000) then 'online' else 'budget_exhausted' end as decision from r")
def win_budget_admit(t):
    """Admission in order of id: done and auto rows use no budget; the first candidates up to the cap go online."""
    s = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    cap = F.least(F.greatest(F.lit(1), F.floor(F.col("n") / 10)), F.lit(1000))
    limit = s.agg(F.count("*").alias("n")).select(cap.alias("cap"))
    cand = s.where("o_orderstatus <> 'F' and o_orderpriority <> '5-LOW'").select("o_orderkey")
    first = cand.orderBy("o_orderkey").limit(1000).withColumn("run", F.row_number().over(W.orderBy("o_orderkey")))  # at most 1000 rows
    first = first.crossJoin(F.broadcast(limit)).where("run <= cap").select("o_orderkey", F.lit(True).alias("admitted"))
    decision = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderpriority") == "5-LOW", "auto").when(F.col("admitted"), "online").otherwise("budget_exhausted")
    return s.join(F.broadcast(first), "o_orderkey", "left").select("o_orderkey", decision.alias("decision"))


# ---- sorts, limits, sets


@query("ord_confidence", f"with {TRIPLES} select l_orderkey, l_linenumber, head, c from triples order by c desc, head, relation, tail, l_orderkey, l_linenumber")
def ord_confidence(t):
    return triples(t).orderBy(F.desc("c"), "head", "relation", "tail", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "head", "c")


@query("ord_sorted_sets", "select l_suppkey, string_agg(cast(l_partkey as varchar), '|' order by l_partkey) as parts from (select distinct l_suppkey, l_partkey from lineitem) group by 1")
def ord_sorted_sets(t):
    return t.lineitem.groupBy("l_suppkey").agg(join_sorted(F.collect_set("l_partkey"), "parts"))


@query("lim_head_n", "select doc_id, lang from documents where lang = 'en' order by doc_id limit 25")
def lim_head_n(t):
    return t.documents.where("lang = 'en'").orderBy("doc_id").limit(25).select("doc_id", "lang")


@query("lim_batch", "select p_partkey, (row_number() over (order by p_partkey) - 1) // 40 as batch from part where p_size > 10")
def lim_batch(t):
    return global_number(t.part.where("p_size > 10"), "p_partkey", "n").select("p_partkey", F.floor((F.col("n") - 1) / 40).alias("batch"))


SENT_SQL = "s as (select doc_id, unnest(string_split(text, '. ')) as s from documents), k as (select doc_id, s, (case when contains(lower(s), 'tion') then 2 else 0 end + case when contains(lower(s), 'the') then 1 else 0 end + case when length(s) > 60 then 2 else 0 end) as score from s)"


def scored_sentences(t):
    s = t.documents.select("doc_id", F.explode(F.split("text", r"\. ")).alias("s"))
    low = F.lower("s")
    score = F.when(F.contains(low, F.lit("tion")), 2).otherwise(0) + F.when(F.contains(low, F.lit("the")), 1).otherwise(0) + F.when(F.length("s") > 60, 2).otherwise(0)
    return s.withColumn("score", score)


@query("topk_sentences", f"with {SENT_SQL}, d as (select distinct doc_id, s, score from k where score >= 3), r as (select *, row_number() over (partition by doc_id order by score desc, md5(s)) as n from d) select doc_id, score, md5(s) as h from r where n <= 12")
def topk_sentences(t):
    d = scored_sentences(t).where("score >= 3").distinct().withColumn("h", F.md5("s"))
    return d.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "h"))).where("n <= 12").select("doc_id", "score", "h")


HOP = f"{INCIDENCE}, seeds as (select distinct edge from incidence where entity < 5), one as (select distinct b.edge from incidence a join seeds on a.edge = seeds.edge join incidence b on a.entity = b.entity)"


FEW = 1 << 20


def held(ids):
    """Ids kept in the shared folder; sent whole to the executors if they are few."""
    ids = CL.checkpointed(ids)
    return F.broadcast(ids) if ids.count() <= FEW else ids


def entities_of(inc, seeds):
    return held(inc.join(seeds, "edge", "left_semi").select("entity").distinct())


def one_hop(inc, seeds):
    """Edges that share an entity with a seed edge."""
    return inc.join(entities_of(inc, seeds), "entity", "left_semi").select("edge").distinct()


@query("set_union_edges", f"with {HOP} select edge from seeds union select edge from one")
def set_union_edges(t):
    inc = incidence(t)
    seeds = inc.where("entity < 5").select("edge").distinct()
    return seeds.union(one_hop(inc, seeds)).distinct()


@query("set_difference", f"with {HOP} select edge from one except select edge from seeds")
def set_difference(t):
    inc = incidence(t)
    seeds = inc.where("entity < 5").select("edge").distinct()
    return one_hop(inc, seeds).subtract(seeds)


@query("set_intersect", "select distinct l_partkey from lineitem where l_returnflag = 'R' intersect select distinct l_partkey from lineitem where l_returnflag = 'A' and l_quantity > 45")
def set_intersect(t):
    return t.lineitem.where("l_returnflag = 'R'").select("l_partkey").intersect(t.lineitem.where("l_returnflag = 'A' and l_quantity > 45").select("l_partkey"))


SETS = "s as (select l_orderkey as k, l_partkey as x from lineitem group by 1, 2), n as (select k, count(*) as n from s group by 1), i as (select a.k as a, b.k as b, count(*) as c from s a join s b on a.x = b.x and a.k < b.k group by 1, 2)"


MANY = 32
LINES = 1 << 20


def dealt(df, rows, *keys):
    """Dealt by keys, into so many parts that one has about ``LINES`` of the ``rows`` at most."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // LINES)), *keys)


def shared_parts(t, many: int = MANY):
    """(a, b, c, na, nb): pairs of orders that share two parts or more.

    Orders of up to ``many`` parts meet through pairs of parts, which few orders share, not through
    single parts: c shared parts are c * (c - 1) / 2 shared pairs.  Pairs of parts are dealt once; those
    of one order go before any are joined.  A larger order would have too many pairs; each meets all
    others through its single parts.
    """
    lines = t.lineitem.where("l_partkey is not null and l_orderkey is not null").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("x"))
    s = dealt(lines, t.lineitem.count(), "k").groupBy("k").agg(F.array_sort(F.collect_set("x")).alias("x")).where("size(x) > 1").withColumn("n", F.size("x").cast("bigint"))
    s = CL.kept(s, apart=True)
    few = F.col("n") <= many
    pairs, most = s.agg(F.coalesce(F.sum(F.when(few, F.col("n") * (F.col("n") - 1) / 2)), F.lit(0)).cast("bigint"), F.max("n")).first()
    two = s.where(few).select("k", "n", F.posexplode("x").alias("at", "x1"), F.col("x").alias("all")).select("k", "n", "x1", F.explode(F.slice("all", F.col("at") + 2, many)).alias("x2"))
    two = dealt(two, pairs, "x1", "x2").withColumn("orders", F.count("*").over(W.partitionBy("x1", "x2"))).where("orders > 1").drop("orders")
    two = CL.checkpointed(two)
    met = two.toDF("a", "na", "x1", "x2").join(two.toDF("b", "nb", "x1", "x2"), ["x1", "x2"]).where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("m"))
    met = met.select("a", "b", ((1 + F.sqrt(1 + 8 * F.col("m"))) / 2).cast("bigint").alias("c"), "na", "nb")
    if most is None or most <= many:
        return met
    one = s.select("k", "n", F.explode("x").alias("x"))
    large = one.where(F.col("n") > many).toDF("a", "na", "x").join(one.toDF("b", "nb", "x"), "x").where((F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & (F.col("nb") <= many)))
    large = large.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where("c > 1")
    turned = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    return met.unionByName(large.select(pick("a", "b"), pick("b", "a"), "c", pick("na", "nb"), pick("nb", "na")))


@query("set_jaccard", f"with {SETS} select a, b, cast(round(c / cast(x.n + y.n - c as double) * 1e6) as bigint) as jaccard from i join n x on a = x.k join n y on b = y.k where c > 1")
def set_jaccard(t):
    return shared_parts(t).select("a", "b", micro(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), "jaccard"))


@query("set_jaccard_gate", f"with {SETS} select a, b from i join n x on a = x.k join n y on b = y.k where c > 1 and 10 * c >= 3 * (x.n + y.n - c)")
def set_jaccard_gate(t):
    return shared_parts(t).where("10 * c >= 3 * (na + nb - c)").select("a", "b")


@query("set_merge_pass2", "select distinct l_orderkey as edge, 'stage1' as origin from lineitem where l_returnflag = 'R' union all select distinct l_orderkey, 'stage2' from lineitem where l_returnflag = 'A' and l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT') and l_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def set_merge_pass2(t):
    one = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("edge")).distinct()
    two = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("edge")).distinct()
    two = two.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("edge") == F.col("o_orderkey"), "left_semi").join(one, "edge", "left_anti")
    return one.withColumn("origin", F.lit("stage1")).unionByName(two.withColumn("origin", F.lit("stage2")))


# ---- vectors


@query("vec_normalize", f"with {VECTORS}, n as (select vec_id, e, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) as n from v) select vec_id, cast(round(e[1] / n * 1e6) as bigint) as first, cast(round(e[64] / n * 1e6) as bigint) as last from n")
def vec_normalize(t):
    d = vectors(t).select("vec_id", VE.normalize(F.col("embedding")).alias("u"))
    return d.select("vec_id", micro(F.element_at("u", 1), "first"), micro(F.element_at("u", -1), "last"))


@query("vec_cosine", f"with {VECTORS} select q.vec_id as a, c.vec_id as b, cast({COS} as bigint) as score from v q join v c on q.label = c.label and q.vec_id <> c.vec_id where q.vec_id % 50 = 0")
def vec_cosine(t):
    d = by_label(t)
    return VE.pair_cosines(d.where("id % 50 = 0"), d).select("a", "b", micro(F.col("score"), "score"))


@query("vec_topk", f"with {VECTORS}, s as (select q.vec_id as q, c.vec_id as id, {COS} as s from v q cross join v c where q.vec_id % 25 = 0), r as (select *, row_number() over (partition by q order by s desc, id) as n from s) select q, id, cast(s as bigint) as score from r where n <= 5")
def vec_topk(t):
    d = vectors(t)
    q = d.where("vec_id % 25 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return VE.top_k(q, d.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 5, places=6).select("q", "id", micro(F.col("score"), "score"))


@query("vec_search_filtered", f"with {VECTORS}, s as (select q.vec_id as q, c.vec_id as id, {COS} as s from v q cross join v c where q.vec_id % 25 = 0 and c.label in (1, 4)), r as (select *, row_number() over (partition by q order by s desc, id) as n from s) select q, id, cast(s as bigint) as score from r where n <= 3")
def vec_search_filtered(t):
    d = vectors(t)
    q = d.where("vec_id % 25 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return VE.top_k(q, d.where("label in (1, 4)").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 3, places=6).select("q", "id", micro(F.col("score"), "score"))


@query("vec_upsert", "select vec_id, case when vec_id % 7 = 0 then label + 100 else label end as label from embeddings union all select vec_id + 1000000, 99 from embeddings where vec_id % 50 = 0")
def vec_upsert(t):
    old = t.embeddings.select("vec_id", "label").withColumn("seq", F.lit(0))
    new = t.embeddings.where("vec_id % 7 = 0").select("vec_id", (F.col("label") + 100).alias("label")).unionByName(t.embeddings.where("vec_id % 50 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.lit(99).alias("label")))
    return old.unionByName(new.withColumn("seq", F.lit(1))).groupBy("vec_id").agg(F.max_by("label", "seq").alias("label"))


@query("vec_hash_embed", "with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents), h as (select doc_id, cast('0x' || substring(md5(w), 1, 4) as bigint) % 64 as i, case when substring(md5(w), 5, 1) < '8' then 1 else -1 end as s from w) select doc_id, i, cast(sum(s) as bigint) as v from h group by 1, 2")
def vec_hash_embed(t):
    w = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n")).withColumn("m", F.md5("w"))
    i = F.conv(F.substring("m", 1, 4), 16, 10).cast("bigint") % 64
    return w.groupBy("doc_id", i.alias("i")).agg(F.sum(F.when(F.substring("m", 5, 1) < "8", F.col("n")).otherwise(-F.col("n"))).alias("v"))


@query("vec_sim_matrix", f"with {VECTORS} select q.label, count(*) as pairs, cast(max({COS}) as bigint) as top from v q join v c on q.label = c.label and q.vec_id < c.vec_id group by 1")
def vec_sim_matrix(t):
    d = by_label(t)
    return VE.pair_counts(d).join(VE.extremes(d), "k", "left").select(F.col("k").alias("label"), "pairs", micro(F.col("most"), "top"))


@query("vec_pairwise_sections", f"with {VECTORS} select q.vec_id as a, c.vec_id as b, cast(round(list_cosine_similarity(q.e, c.e) * 1e4) as bigint) as s from v q join v c on q.vec_id // 10 = c.vec_id // 10 and q.vec_id <> c.vec_id")
def vec_pairwise_sections(t):
    d = vectors(t).withColumn("article", F.floor(F.col("vec_id") / 10))
    one, two = d.select("article", F.col("vec_id").alias("a"), F.col("embedding").alias("x")), d.select("article", F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return one.join(two, "article").where("a <> b").select("a", "b", F.round(VE.cosine(F.col("x"), F.col("y")) * 1e4).cast("bigint").alias("s"))


@query("vec_nearest_support", f"with {VECTORS}, s as (select q.vec_id as q, c.vec_id % 4 as field, max({COS}) as s from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0 group by 1, 2) select q, cast(min(s) as bigint) as min_support from s group by q")
def vec_nearest_support(t):
    d = vectors(t)
    q = d.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    per = None
    for field in range(4):
        hits = VE.top_k(q, d.where(F.col("vec_id") % 4 == field).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 2).where("q <> id").groupBy("q").agg(F.max("score").alias("s"))
        per = hits if per is None else per.unionByName(hits)
    return per.groupBy("q").agg(micro(F.min("s"), "min_support"))


@query("agg_intra_cluster", f"with {VECTORS} select q.label, cast(min({COS}) as bigint) as least from v q join v c on q.label = c.label and q.vec_id < c.vec_id group by 1")
def agg_intra_cluster(t):
    d = by_label(t)
    return VE.pair_counts(d).join(VE.extremes(d), "k", "left").select(F.col("k").alias("label"), micro(F.col("least"), "least"))


@query("agg_min_margin", f"with {VECTORS}, s as (select q.vec_id as q, c.vec_id as id, {COS} as s from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0), r as (select q, s, row_number() over (partition by q order by s desc, id) as n from s), m as (select q, max(case when n = 1 then s end) - max(case when n = 2 then s end) as margin from r group by q) select cast(min(margin) as bigint) as margin from m")
def agg_min_margin(t):
    d = vectors(t)
    q = d.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    hits = VE.top_k(q, d.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 3).where("q <> id").select("q", F.round(F.col("score") * 1e6).cast("bigint").alias("s"), "id")
    hits = hits.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "id")))
    m = hits.groupBy("q").agg((F.max(F.when(F.col("n") == 1, F.col("s"))) - F.max(F.when(F.col("n") == 2, F.col("s")))).alias("margin"))
    return m.agg(F.min("margin").alias("margin"))


@query("agg_pooled_vec", "with e as (select label, unnest(range(len(embedding))) as pos, unnest(embedding) as x from embeddings) select label, cast(pos as integer) as pos, cast(round(sum(cast(round(cast(x as double) * 1e9) as bigint)) / cast(count(*) as double) / 1e3) as bigint) as mean from e group by 1, 2")
def agg_pooled_vec(t):
    return VE.centroid(vectors(t), "label").select("label", "pos", F.round(F.col("mean") * 1e6).cast("bigint").alias("mean"))


# ---- clustering


@query("clu_alias_unionfind")
def clu_alias_unionfind(t):
    """Customers and parts as aliases of each other through orders; components of the whole graph."""
    e = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), (-1 - F.col("l_partkey")).alias("b"))
    return CL.components(e)


@query("clu_complete_link")
def clu_complete_link(t):
    return CL.complete_linkage(t.embeddings, "label", 0.6)


@query("clu_greedy_claims")
def clu_greedy_claims(t):
    return CL.first_fit(t.embeddings, "label", 0.6, most=20)


@query("clu_greedy_canonical")
def clu_greedy_canonical(t):
    return CL.first_fit(t.embeddings, "label", 0.5)


@query("clu_block_merge", "with s as (select l_orderkey, string_agg(cast(l_partkey as varchar), '|' order by l_partkey) as core from (select distinct l_orderkey, l_partkey from lineitem) group by 1), j as (select o_orderpriority as kind, core, o_orderkey from orders join s on o_orderkey = l_orderkey) select 'CH:' || kind || ':' || substring(sha1(core), 1, 12) as id, count(*) as support, min(o_orderkey) as first from j group by kind, core")
def clu_block_merge(t):
    s = t.lineitem.groupBy("l_orderkey").agg(join_sorted(F.collect_set("l_partkey"), "core"))
    j = t.orders.join(s, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority", "core").agg(F.count("*").alias("support"), F.min("o_orderkey").alias("first"))
    return j.select(F.concat(F.lit("CH:"), "o_orderpriority", F.lit(":"), F.substring(F.sha1("core"), 1, 12)).alias("id"), "support", "first")


@query("clu_relations", f"with {SETS} select a, b, case when x.o_orderstatus <> y.o_orderstatus then 'DIFFERENT_SCOPE_FROM' else 'SUPPORTS' end as relation from i join orders x on a = x.o_orderkey join orders y on b = y.o_orderkey where c > 1 and x.o_orderpriority = y.o_orderpriority union all select b, a, case when x.o_orderstatus <> y.o_orderstatus then 'DIFFERENT_SCOPE_FROM' else 'SUPPORTS' end from i join orders x on a = x.o_orderkey join orders y on b = y.o_orderkey where c > 1 and x.o_orderpriority = y.o_orderpriority")
def clu_relations(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    x = o.select(F.col("o_orderkey").alias("a"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    y = o.select(F.col("o_orderkey").alias("b"), F.col("o_orderpriority").alias("p2"), F.col("o_orderstatus").alias("s2"))
    kind = F.when(F.col("s") != F.col("s2"), "DIFFERENT_SCOPE_FROM").otherwise("SUPPORTS")
    r = shared_parts(t).join(x, "a").join(y, "b").where("p = p2").select("a", "b", kind.alias("relation"))
    return r.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))), "relation")


# ---- graph


@query("gr_incidence_v1", "select 'E:' || l_partkey as entity, 'EH:' || l_orderkey as edge, case l_returnflag when 'R' then 'TREATMENT' when 'A' then 'OUTCOME' else 'PATIENT' end as role from lineitem")
def gr_incidence_v1(t):
    role = F.when(F.col("l_returnflag") == "R", "TREATMENT").when(F.col("l_returnflag") == "A", "OUTCOME").otherwise("PATIENT")
    return t.lineitem.select(F.concat(F.lit("E:"), F.col("l_partkey").cast("string")).alias("entity"), F.concat(F.lit("EH:"), F.col("l_orderkey").cast("string")).alias("edge"), role.alias("role"))


@query("gr_incidence_v2", "select 'PARTICIPATES_IN' as kind, l_partkey as source, l_orderkey as target from lineitem union all select 'SUPPORTED_BY', l_orderkey, l_suppkey from lineitem union all select 'FROM_ARTICLE', l_suppkey, l_orderkey % 40 from lineitem union all select 'MEMBER_OF', o_orderkey, o_custkey from orders")
def gr_incidence_v2(t):
    d = lambda df, kind, a, b: df.selectExpr(f"'{kind}' as kind", f"{a} as source", f"{b} as target")
    return d(t.lineitem, "PARTICIPATES_IN", "l_partkey", "l_orderkey").unionByName(d(t.lineitem, "SUPPORTED_BY", "l_orderkey", "l_suppkey")).unionByName(d(t.lineitem, "FROM_ARTICLE", "l_suppkey", "l_orderkey % 40")).unionByName(d(t.orders, "MEMBER_OF", "o_orderkey", "o_custkey"))


@query("gr_incidence_f", "select l_partkey as entity, l_returnflag as role, l_orderkey as edge, count(*) as n from lineitem group by 1, 2, 3")
def gr_incidence_f(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("role"), F.col("l_orderkey").alias("edge")).agg(F.count("*").alias("n"))


@query("gr_projection", f"with {TRIPLES} select 'TP:' || substring(sha1('[\"' || l_orderkey || '\",\"' || head || '\",\"' || relation || '\",\"' || tail || '\"]'), 1, 12) as id, l_orderkey, head, relation, tail from triples")
def gr_projection(t):
    parts = F.to_json(F.array(F.col("l_orderkey").cast("string"), F.col("head").cast("string"), "relation", "tail"))
    return triples(t).select(F.concat(F.lit("TP:"), F.substring(F.sha1(parts), 1, 12)).alias("id"), "l_orderkey", "head", "relation", "tail")


@query("gr_summary_links", "select o_orderkey as edge, 'S:' || o_custkey as summary, o_orderkey % 40 as article from orders")
def gr_summary_links(t):
    return t.orders.select(F.col("o_orderkey").alias("edge"), F.concat(F.lit("S:"), F.col("o_custkey").cast("string")).alias("summary"), (F.col("o_orderkey") % 40).alias("article"))


@query("gr_one_hop", f"with {HOP} select i.edge, count(distinct i.entity) as entities, count(distinct i.chunk) as chunks, case when i.edge in (select edge from seeds) then 'seed' else 'one_hop' end as origin from incidence i join one on i.edge = one.edge group by i.edge")
def gr_one_hop(t):
    inc = incidence(t)
    seeds = inc.where("entity < 5").select("edge").distinct()
    d = inc.join(one_hop(inc, seeds), "edge", "left_semi").groupBy("edge").agg(F.count_distinct("entity").alias("entities"), F.count_distinct("chunk").alias("chunks"))
    return d.join(seeds.withColumn("s", F.lit(True)), "edge", "left").select("edge", "entities", "chunks", F.when(F.col("s"), "seed").otherwise("one_hop").alias("origin"))


def _second_hop_sql(gate: str) -> str:
    return f"with {HOP}, gate as (select count(*) as n from one join orders on edge = o_orderkey where {gate}), two as (select distinct b.edge from incidence a join one on a.edge = one.edge join incidence b on a.chunk = b.chunk), u as (select edge from one union select edge from two where (select n from gate) = 0) select edge from u"


def second_hop(t, gate):
    """A second expansion (through chunks) only if no edge of the first meets ``gate``.

    Rows of the incidence may repeat, as only distinct edges are kept; whether the gate is met is known before the second hop is planned.
    Chunks of rows with an entity that was met are taken as they stand; only rows of other chunks are joined with the edges.
    """
    inc = t.lineitem.selectExpr("l_orderkey as edge", "l_partkey as entity", "l_suppkey as chunk")
    entities = entities_of(inc, held(inc.where("entity < 5").select("edge").distinct()))
    one = held(inc.join(entities, "entity", "left_semi").select("edge").distinct())
    if t.orders.where(gate).select(F.col("o_orderkey").alias("edge")).join(one, "edge", "left_semi").limit(1).count():
        return one.select("edge")
    met = held(inc.join(entities, "entity", "left_semi").select("chunk").distinct())
    rest = inc.join(met, "chunk", "left_anti").join(one, "edge", "left_semi").select("chunk").distinct()
    chunks = held(met.unionByName(rest))
    return one.unionByName(inc.join(chunks, "chunk", "left_semi").select("edge")).distinct()


@query("gr_cond_second_hop", _second_hop_sql("o_orderpriority = '1-URGENT' and o_orderkey % 97 = 0"))
def gr_cond_second_hop(t):
    return second_hop(t, "o_orderpriority = '1-URGENT' and o_orderkey % 97 = 0")


@query("gr_cond_second_hop_held", _second_hop_sql("o_orderpriority = '1-URGENT'"))
def gr_cond_second_hop_held(t):
    return second_hop(t, "o_orderpriority = '1-URGENT'")


@query("gr_nodes_texts", "select 'patient' as role, c_custkey as id, c_name as text from customer union all select 'treatment', p_partkey, p_name from part union all select 'outcome', s_suppkey, s_name from supplier")
def gr_nodes_texts(t):
    d = lambda df, role, k, n: df.select(F.lit(role).alias("role"), F.col(k).alias("id"), F.col(n).alias("text"))
    return d(t.customer, "patient", "c_custkey", "c_name").unionByName(d(t.part, "treatment", "p_partkey", "p_name")).unionByName(d(t.supplier, "outcome", "s_suppkey", "s_name"))


