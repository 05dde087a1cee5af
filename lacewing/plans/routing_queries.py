"""Scoring, routing, gates, buckets, answers, sinks' views and batch forms of streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..operators import merge as M
from ..registry import query, sql_case
from ..sources.binding import TRIPLES, incidence, triples
from .ranking_queries import HOP, global_number, one_hop
from .relational_queries import MERGED, join_sorted, micro
from .text_queries import PRIORITY_TYPES

CLAIM_SQL = sql_case(PRIORITY_TYPES, "o_orderpriority", "'OTHER'")


def claim_type():
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PRIORITY_TYPES.items() for x in kv)), F.col("o_orderpriority")), F.lit("OTHER"))


def reasons(*rules):
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules)))


def reasons_sql(*rules):
    return "array_to_string(list_filter([" + ", ".join(f"case when {cond} then '{name}' end" for name, cond in rules) + "], lambda v: v is not null), '|')"


# ---- scores

HEAD = "case l_suppkey % 3 when 0 then 'protein' when 1 then 'breast cancer' else 'some drug' end"
REL = "case l_returnflag when 'A' then 'treats' when 'R' then 'associated_with' else 'regulates' end"


@query("sc_clarity_relevance", f"with e as (select l_orderkey, l_linenumber, {HEAD} as h, {REL} as r, p_name as t from lineitem join part on l_partkey = p_partkey) select l_orderkey, l_linenumber, least(10, greatest(1, 5 + case when r in ('treats', 'inhibits', 'activates', 'causes', 'regulates') then 2 else 0 end + case when h not in ('protein', 'gene', 'drug', 'disease', 'chemical') then 1 else 0 end + case when t not in ('protein', 'gene', 'drug', 'disease', 'chemical') then 1 else 0 end - case when r in ('associated_with', 'interacts_with') then 1 else 0 end)) as clarity, least(10, greatest(1, 5 + case when r in ('treats', 'prevents', 'causes', 'inhibits', 'activates') then 2 else 0 end + case when regexp_matches(h || ' ' || t, 'cancer|disease|disorder|syndrome|infection') then 1 else 0 end + case when regexp_matches(h || ' ' || t, 'drug|medication|inhibitor|agonist|antagonist|therapy') then 1 else 0 end)) as relevance from e")
def sc_clarity_relevance(t):
    e = t.lineitem.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.expr(HEAD).alias("h"), F.expr(REL).alias("r"), F.col("p_name").alias("t"))
    generic = ["protein", "gene", "drug", "disease", "chemical"]
    add = lambda c, n: F.when(c, n).otherwise(0)
    both = F.concat_ws(" ", "h", "t")
    clarity = 5 + add(F.col("r").isin("treats", "inhibits", "activates", "causes", "regulates"), 2) + add(~F.col("h").isin(generic), 1) + add(~F.col("t").isin(generic), 1) - add(F.col("r").isin("associated_with", "interacts_with"), 1)
    relevance = 5 + add(F.col("r").isin("treats", "prevents", "causes", "inhibits", "activates"), 2) + add(both.rlike("cancer|disease|disorder|syndrome|infection"), 1) + add(both.rlike("drug|medication|inhibitor|agonist|antagonist|therapy"), 1)
    clip = lambda x: F.least(F.lit(10), F.greatest(F.lit(1), x))
    return e.select("l_orderkey", "l_linenumber", clip(clarity).alias("clarity"), clip(relevance).alias("relevance"))


@query("sc_triple_for_summary", f"with {TRIPLES} select l_orderkey, l_linenumber, 1200 * (case when head < 50 and tail < 'Brand#2' then 4 when head < 50 or tail < 'Brand#2' then 2 else 0 end) + case when relation = 'reduces' then 300 else 0 end + (c + r + k) as score from triples")
def sc_triple_for_summary(t):
    a, b = F.col("head") < 50, F.col("tail") < "Brand#2"
    return triples(t).select("l_orderkey", "l_linenumber", (1200 * F.when(a & b, 4).when(a | b, 2).otherwise(0) + F.when(F.col("relation") == "reduces", 300).otherwise(0) + F.col("c") + F.col("r") + F.col("k")).alias("score"))


@query("sc_entity_candidate", "with m as (select l_orderkey, l_partkey, count(*) as n from lineitem group by 1, 2), u as (select l_partkey, count(*) as mentions from lineitem group by 1), s as (select m.l_orderkey, m.l_partkey, 5700 + 2000 * n // 10 + 2000 * least(50, mentions) // 50 as score from m join u on m.l_partkey = u.l_partkey), r as (select *, row_number() over (partition by l_orderkey order by score desc, l_partkey) as i from s) select l_orderkey, l_partkey, score from r where i <= 5")
def sc_entity_candidate(t):
    m = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    u = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("mentions"))
    s = m.join(u, "l_partkey").withColumn("score", 5700 + F.floor(2000 * F.col("n") / 10) + F.floor(2000 * F.least(F.lit(50), F.col("mentions")) / 50))
    return s.withColumn("i", F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("score"), "l_partkey"))).where("i <= 5").select("l_orderkey", "l_partkey", "score")


@query("sc_triple_candidate", f"with {TRIPLES}, s as (select article, l_orderkey, l_linenumber, head, 50 * c + 20 * k + 15 * r + case when relation = 'reduces' then 1500 else 0 end as score from triples), r as (select *, row_number() over (partition by article order by score desc, l_orderkey, l_linenumber, head) as i from s) select article, l_orderkey, l_linenumber, score from r where i <= 12")
def sc_triple_candidate(t):
    s = triples(t).withColumn("score", 50 * F.col("c") + 20 * F.col("k") + 15 * F.col("r") + F.when(F.col("relation") == "reduces", 1500).otherwise(0))
    return s.withColumn("i", F.row_number().over(W.partitionBy("article").orderBy(F.desc("score"), "l_orderkey", "l_linenumber", "head"))).where("i <= 12").select("article", "l_orderkey", "l_linenumber", "score")


@query("sc_snippet", "with s as (select a.doc_id as claim, b.doc_id as snippet, case when a.doc_id = b.doc_id then 1000 else cast(least(a.n_chars, b.n_chars) * 1000 // greatest(a.n_chars, b.n_chars) as bigint) * case when a.source = b.source then 10 else 7 end // 10 end as score from documents a join documents b on a.lang = b.lang and a.doc_id // 50 = b.doc_id // 50), r as (select *, row_number() over (partition by claim order by score desc, snippet) as i from s) select claim, snippet, score from r where i <= 5")
def sc_snippet(t):
    d = t.documents.select("doc_id", "lang", "source", "n_chars", F.floor(F.col("doc_id") / 50).alias("g"))
    a = d.select(F.col("doc_id").alias("claim"), "lang", "g", F.col("source").alias("s1"), F.col("n_chars").alias("n1"))
    b = d.select(F.col("doc_id").alias("snippet"), "lang", "g", F.col("source").alias("s2"), F.col("n_chars").alias("n2"))
    like = F.expr("(least(n1, n2) * 1000) div greatest(n1, n2)")
    score = F.when(F.col("claim") == F.col("snippet"), F.lit(1000).cast("bigint")).otherwise(F.floor(like * F.when(F.col("s1") == F.col("s2"), 10).otherwise(7) / 10))
    s = a.join(b, ["lang", "g"]).withColumn("score", score)
    return s.withColumn("i", F.row_number().over(W.partitionBy("claim").orderBy(F.desc("score"), "snippet"))).where("i <= 5").select("claim", "snippet", "score")


@query("sc_critic", f"with {TRIPLES}, s as (select l_orderkey, l_linenumber, 30 * c + 20 * k + 20 * least(100, r) + 15 * 50 + 15 * c as score from triples) select l_orderkey, l_linenumber, score, case when score >= 7500 then 'ACCEPT' when score >= 5500 then 'REVIEW' else 'REJECT' end as decision from s")
def sc_critic(t):
    w = [round(100 * x) for x in V.CRITIC_WEIGHTS]
    score = w[0] * F.col("c") + w[1] * F.col("k") + w[2] * F.least(F.lit(100), F.col("r")) + w[3] * 50 + w[4] * F.col("c")
    return triples(t).select("l_orderkey", "l_linenumber", score.alias("score")).withColumn("decision", F.when(F.col("score") >= 7500, "ACCEPT").when(F.col("score") >= 5500, "REVIEW").otherwise("REJECT"))


EDGE_RULES = [("too_few_entities", "entities < 2"), ("missing_source", "sources = 0"), ("partial", "o_orderstatus = 'P'"), ("unknown_entity", "small > 0")]


@query("sc_validate_edge", f"with n as (select l_orderkey, count(distinct l_partkey) as entities, count(distinct l_suppkey) as sources, count(case when l_partkey % 50 = 0 then 1 end) as small from lineitem group by 1) select o_orderkey, {reasons_sql(*EDGE_RULES)} as warnings from orders join n on o_orderkey = l_orderkey")
def sc_validate_edge(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("entities"), F.count_distinct("l_suppkey").alias("sources"), F.count_if(F.col("l_partkey") % 50 == 0).alias("small"))
    d = t.orders.join(n, F.col("o_orderkey") == F.col("l_orderkey"))
    return d.select("o_orderkey", F.array_join(reasons(*((k, F.expr(c)) for k, c in EDGE_RULES)), "|").alias("warnings"))


# ---- routing

ROUTE_RULES = [
    ("entity_linking_ambiguous", "n = 0 or best < 90"), ("triple_anchor_ambiguous", "n > 0 and top_k < 85"), ("no_stable_kg_anchor", "n = 0 or entities < 2"),
    ("complex_scope", "kind in ('RISK_FACTOR', 'INTERVENTION_OUTCOME') and o_orderstatus <> 'F'"), ("negation_or_hedging", "o_orderkey % 7 = 0"),
    ("conflict_unresolved", "flags > 2"), ("high_impact_claim", "kind = 'ADVERSE_EFFECT'"), ("cluster_canonicalization_uncertain", "n > 6"),
]
ROUTES_SQL = f"""p as (select l_orderkey, count(*) as n, count(distinct l_partkey) as entities, max({'cast(round(100 - l_discount * 300) as bigint)'}) as best, max(cast(round(100 - l_tax * 500) as bigint)) as top_k, count(distinct l_returnflag) as flags from lineitem group by 1),
j as (select o_orderkey, o_orderstatus, {CLAIM_SQL} as kind, coalesce(n, 0) as n, coalesce(entities, 0) as entities, coalesce(best, 0) as best, coalesce(top_k, 0) as top_k, coalesce(flags, 0) as flags from orders left join p on o_orderkey = l_orderkey),
q as (select o_orderkey, {reasons_sql(*ROUTE_RULES)} as r from j)"""


def routes(t):
    p = t.lineitem.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_distinct("l_partkey").alias("entities"), F.max(F.expr("cast(round(100 - l_discount * 300) as bigint)")).alias("best"),
        F.max(F.expr("cast(round(100 - l_tax * 500) as bigint)")).alias("top_k"), F.count_distinct("l_returnflag").alias("flags"),
    )
    j = t.orders.withColumn("kind", claim_type()).join(p, F.col("o_orderkey") == F.col("l_orderkey"), "left").na.fill(0, ["n", "entities", "best", "top_k", "flags"])
    return j.select("o_orderkey", reasons(*((k, F.expr(c)) for k, c in ROUTE_RULES)).alias("r"))


@query("rt_routing_reasons", f"with {ROUTES_SQL} select o_orderkey, case when r = '' then 'auto' else 'online' end as route, case when r = '' then 'auto_high_confidence_anchor' else r end as reasons from q")
def rt_routing_reasons(t):
    r = F.array_join("r", "|")
    return routes(t).select("o_orderkey", F.when(F.size("r") == 0, "auto").otherwise("online").alias("route"), F.when(F.size("r") == 0, "auto_high_confidence_anchor").otherwise(r).alias("reasons"))


@query("agg_routing_report", f"with {ROUTES_SQL}, e as (select unnest(string_split(case when r = '' then 'auto_high_confidence_anchor' else r end, '|')) as reason from q) select reason, count(*) as packs from e group by reason")
def agg_routing_report(t):
    r = F.when(F.size("r") == 0, F.array(F.lit("auto_high_confidence_anchor"))).otherwise(F.col("r"))
    return routes(t).select(F.explode(r).alias("reason")).groupBy("reason").agg(F.count("*").alias("packs"))


TYPE_ROUTES = {"en": "patient|treatment|outcome", "fr": "treatment", "de": "outcome", "es": "patient|study_design"}


@query("rt_sections", f"with a as (select doc_id, unnest(string_split({sql_case(TYPE_ROUTES, 'lang', 'lang')}, '|')) as role from documents), b as (select doc_id, 'comparator' as role from documents where regexp_matches(lower(case doc_id % 9 when 0 then 'versus ' else '' end || text), 'control group|comparison|versus| vs |placebo|waitlist')), c as (select doc_id, 'outcome' as role from (select doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as n from documents) where n <= 6) select doc_id, role from a union select doc_id, role from b union select doc_id, role from c")
def rt_sections(t):
    roles = F.create_map(*(F.lit(x) for kv in TYPE_ROUTES.items() for x in kv))
    a = t.documents.select("doc_id", F.explode(F.split(F.try_element_at(roles, F.col("lang")), r"\|")).alias("role"))
    b = t.documents.where(F.lower(F.expr("case doc_id % 9 when 0 then 'versus ' else '' end || text")).rlike("control group|comparison|versus| vs |placebo|waitlist")).select("doc_id", F.lit("comparator").alias("role"))
    c = t.documents.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("n <= 6").select("doc_id", F.lit("outcome").alias("role"))
    return a.unionByName(b).unionByName(c).distinct()


@query("rt_agent1_input", "select source, cast(count(case when lang = 'en' then 1 end) > 0 as integer) as patient, cast(count(case when lang = 'fr' then 1 end) > 5 as integer) as treatment, cast(count(case when lang = 'de' then 1 end) > 5 as integer) as outcome from documents group by source")
def rt_agent1_input(t):
    p = t.documents.groupBy("source").pivot("lang", ["en", "fr", "de"]).count().na.fill(0)
    return p.select("source", (F.col("en") > 0).cast("int").alias("patient"), (F.col("fr") > 5).cast("int").alias("treatment"), (F.col("de") > 5).cast("int").alias("outcome"))


RISK_RULES = [
    ("schema_validation_failed", "n = 0"), ("low_hyperedge_confidence", "best < 80"), ("low_support_score", "least_c < 73"), ("no_treatment_entity", "rs = 0"), ("no_outcome_entity", "os = 0"),
    ("risky_outcome_direction:mixed", "flags > 2"), ("comparator_present", "o_orderkey % 5 = 0"), ("multiple_treatment_nodes", "rs > 1"), ("dispersed_evidence_sections", "chunks > 4"),
]


@query("rt_risk_gate", f"with p as (select l_orderkey, count(*) as n, max(cast(round(100 - l_discount * 300) as bigint)) as best, min(cast(round(100 - l_discount * 300) as bigint)) as least_c, count(case when l_returnflag = 'R' then 1 end) as rs, count(case when l_returnflag = 'A' then 1 end) as os, count(distinct l_returnflag) as flags, count(distinct l_suppkey) as chunks from lineitem group by 1), q as (select o_orderkey, {reasons_sql(*RISK_RULES)} as reasons from orders join p on o_orderkey = l_orderkey) select o_orderkey, reasons, cast(least(1000, 200 * case when reasons = '' then 0 else len(string_split(reasons, '|')) end) as integer) as risk, reasons <> '' as verify from q")
def rt_risk_gate(t):
    # few columns are dealt once by order; all counts are then made in place
    lines = t.lineitem.selectExpr("l_orderkey", "cast(round(100 - l_discount * 300) as bigint) as c", "l_returnflag", "l_suppkey").repartition("l_orderkey")
    distinct = lambda c: F.size(F.collect_set(c)).cast("bigint")
    p = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("c").alias("best"), F.min("c").alias("least_c"), F.count_if(F.col("l_returnflag") == "R").alias("rs"), F.count_if(F.col("l_returnflag") == "A").alias("os"), distinct("l_returnflag").alias("flags"), distinct("l_suppkey").alias("chunks"))
    d = t.orders.join(p, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("r", reasons(*((k, F.expr(c)) for k, c in RISK_RULES)))
    return d.select("o_orderkey", F.array_join("r", "|").alias("reasons"), F.least(F.lit(1000), 200 * F.size("r")).cast("int").alias("risk"), (F.size("r") > 0).alias("verify"))


@query("val_article", "select 'unknown_part' as error, l_orderkey as id from lineitem where l_partkey not in (select p_partkey from part where p_size > 1) union all select 'no_lines', o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem) union all select 'unknown_customer', o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 24)")
def val_article(t):
    a = t.lineitem.join(t.part.where("p_size > 1"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.lit("unknown_part").alias("error"), F.col("l_orderkey").alias("id"))
    b = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("no_lines").alias("error"), F.col("o_orderkey").alias("id"))
    c = t.orders.join(t.customer.where("c_nationkey < 24"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("unknown_customer").alias("error"), F.col("o_orderkey").alias("id"))
    return a.unionByName(b).unionByName(c)


@query("val_pydantic", "with l as (select l_orderkey, l_linenumber, lag(l_linenumber) over (partition by l_orderkey order by l_shipdate, l_partkey, l_suppkey, l_linenumber) as before from lineitem) select l_orderkey, count(*) as n, count(case when before > l_linenumber then 1 end) as out_of_order, count(*) - count(distinct l_linenumber) as repeated from l group by 1")
def val_pydantic(t):
    order = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")
    d = t.lineitem.withColumn("before", F.lag("l_linenumber").over(order))
    return d.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("before") > F.col("l_linenumber")).alias("out_of_order"), (F.count("*") - F.count_distinct("l_linenumber")).alias("repeated"))


@query("val_llm_payload", "select event_id, json_extract_string(props, '$.k') is not null and try_cast(json_extract_string(props, '$.k') as bigint) is not null and event_type in ('view', 'click') as valid from events")
def val_llm_payload(t):
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", (k.isNotNull() & k.try_cast("bigint").isNotNull() & F.col("event_type").isin("view", "click")).alias("valid"))


BUCKET_ROWS = [(b, c) for b, types in V.BUCKETS.items() for c in types]
BUCKET_SQL = "b(bucket, claim_type) as (values " + ", ".join(f"('{b}', '{c}')" for b, c in BUCKET_ROWS) + ")"


def bucketed(t):
    dim = F.broadcast(t.spark.createDataFrame(BUCKET_ROWS, "bucket string, claim_type string"))
    return t.orders.withColumn("claim_type", claim_type()).join(dim, "claim_type")


@query("bk_evidence", f"with {BUCKET_SQL} select o_orderkey, bucket from orders join b on b.claim_type = {CLAIM_SQL}")
def bk_evidence(t):
    return bucketed(t).select("o_orderkey", "bucket")


RERANK_SQL = f"""{BUCKET_SQL}, n as (select l_orderkey, count(distinct l_partkey) as entities from lineitem group by 1 having count(distinct l_partkey) >= 2),
s as (select o_orderkey, bucket, b.claim_type in ('INTERVENTION_OUTCOME', 'COMPARATIVE_OUTCOME', 'BEHAVIORAL_INTERVENTION') as core, entities, o_totalprice as sim from orders join b on b.claim_type = {CLAIM_SQL} join n on l_orderkey = o_orderkey),
i as (select *, row_number() over (partition by bucket order by sim desc, o_orderkey) as a from s),
r as (select *, row_number() over (partition by bucket order by core desc, entities desc, sim desc, o_orderkey) as k from i where a <= 30)"""


@query("rr_rerank", f"with {RERANK_SQL} select o_orderkey, string_agg(bucket, '|' order by bucket) as buckets, min(k) as best from r where k <= 8 group by 1")
def rr_rerank(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("entities")).where("entities >= 2")
    core = F.col("claim_type").isin("INTERVENTION_OUTCOME", "COMPARATIVE_OUTCOME", "BEHAVIORAL_INTERVENTION")
    s = bucketed(t).join(n, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("core", core)
    i = s.withColumn("a", F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("a <= 30")
    r = i.withColumn("k", F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("core"), F.desc("entities"), F.desc("o_totalprice"), "o_orderkey"))).where("k <= 8")
    return r.groupBy("o_orderkey").agg(join_sorted(F.collect_list("bucket"), "buckets"), F.min("k").cast("bigint").alias("best"))


@query("rr_validate", "with s as (select event_id, user_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where json_extract_string(props, '$.k') is not null), g as (select user_id, bool_and(k between 0 and 99) as ok from s group by 1) select s.event_id, 10 * (k % 4) + k % 5 + k % 3 as score from s join g on s.user_id = g.user_id where ok and k % 4 <> 0 and k % 5 + k % 3 >= 3")
def rr_validate(t):
    s = t.events.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k is not null")
    g = s.groupBy("user_id").agg(F.bool_and(F.col("k").between(0, 99)).alias("ok")).where("ok")
    return s.join(g, "user_id").where("k % 4 <> 0 and k % 5 + k % 3 >= 3").select("event_id", F.expr("10 * (k % 4) + k % 5 + k % 3").alias("score"))


@query("qp_plan", "with c as (select conv_id, min(case when role = 'user' then turn end) as u from conversations group by 1) select c.conv_id, trim(regexp_replace('assessment ' || x.text, '\\s+', ' ', 'g')) as assessment_query, trim(regexp_replace('intervention for ' || x.text, '\\s+', ' ', 'g')) as intervention_query, case when contains(lower(x.text), 'en') then trim(regexp_replace('side effects of ' || x.text, '\\s+', ' ', 'g')) end as side_effect_query from c join conversations x on x.conv_id = c.conv_id and x.turn = c.u")
def qp_plan(t):
    u = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    q = lambda lead: F.trim(F.regexp_replace(F.concat(F.lit(lead), F.col("text")), r"\s+", " "))
    return u.select("conv_id", q("assessment ").alias("assessment_query"), q("intervention for ").alias("intervention_query"), F.when(F.contains(F.lower("text"), F.lit("en")), q("side effects of ")).alias("side_effect_query"))


@query("qp_side_effect", "with m as (select conv_id, lower(split_part(trim(text), ' ', 1)) as mention, min(turn) as first from conversations where role in ('user', 'assistant') and trim(text) <> '' group by 1, 2) select conv_id, string_agg(mention, ', ' order by first, mention) as side_effect_query from m group by 1")
def qp_side_effect(t):
    m = t.conversations.where("role in ('user', 'assistant') and trim(text) <> ''").groupBy("conv_id", F.lower(F.split_part(F.trim("text"), F.lit(" "), F.lit(1))).alias("mention")).agg(F.min("turn").alias("first"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "mention"))).alias("x"))
    return g.select("conv_id", F.array_join("x.mention", ", ").alias("side_effect_query"))


@query("an_verdict", "with e as (select l_orderkey % 97 as c, l_returnflag as f, l_quantity as q, p_name as n from lineitem join part on l_partkey = p_partkey where contains(lower(p_name), 'red')), g as (select c, bool_or(f = 'R' and q > 25) as good, bool_or(f = 'R') as any_i, bool_or(f = 'A') as bad from e group by 1) select s.range as c, case when g.c is null then 'insufficient_evidence' when good then 'supported' when any_i then 'partially_supported' when bad then 'not_supported_as_primary' else 'insufficient_evidence' end as verdict from range(97) s left join g on g.c = s.range")
def an_verdict(t):
    e = t.lineitem.join(t.part.where(F.contains(F.lower("p_name"), F.lit("red"))), F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") % 97).alias("c"), F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"))
    g = e.groupBy("c").agg(F.bool_or((F.col("f") == "R") & (F.col("q") > 25)).alias("good"), F.bool_or(F.col("f") == "R").alias("any_i"), F.bool_or(F.col("f") == "A").alias("bad"))
    verdict = F.when(F.col("good"), "supported").when(F.col("any_i"), "partially_supported").when(F.col("bad"), "not_supported_as_primary").otherwise("insufficient_evidence")
    return t.spark.range(97).withColumnRenamed("id", "c").join(g, "c", "left").select("c", verdict.alias("verdict"))


@query("an_verify", "select a.o_custkey as case_id, count(*) as cited, count(case when b.l_orderkey is not null then 1 end) as contained, case when count(*) > count(case when b.l_orderkey is not null then 1 end) then 'repaired' else 'ok' end as status from orders a left join (select distinct l_orderkey from lineitem where l_returnflag = 'R') b on a.o_orderkey = b.l_orderkey group by 1")
def an_verify(t):
    b = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(1))
    g = t.orders.join(b, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("cited"), F.count("hit").alias("contained"))
    return g.withColumn("status", F.when(F.col("cited") > F.col("contained"), "repaired").otherwise("ok"))


@query("an_stub", "with k as (select l_orderkey, string_agg(distinct p_name, ', ' order by p_name) as names, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1) select l_orderkey, 'Evidence on ' || names || ' (' || n || ' items).' as answer from k")
def an_stub(t):
    k = t.lineitem.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ", ").alias("names"), F.count("*").alias("n"))
    return k.select("l_orderkey", F.concat(F.lit("Evidence on "), "names", F.lit(" ("), F.col("n").cast("string"), F.lit(" items).")).alias("answer"))


@query("sel_top1_claim", "with r as (select conv_id, turn, row_number() over (partition by conv_id order by case when role = 'system' then 1 else 0 end, turn) as n from conversations) select conv_id, turn from r where n = 1")
def sel_top1_claim(t):
    return t.conversations.groupBy("conv_id").agg(F.min_by("turn", F.struct(F.when(F.col("role") == "system", 1).otherwise(0).alias("low"), "turn")).alias("turn"))


FACTS = {"dose": "[0-9]+ ?mg", "age": "[0-9]{1,2}-year-old", "phone": r"\+1 \(", "mail": "@", "card": "[0-9]{16}", "token": "token =", "shout": "!!", "junk": "&&&", "table": r" \| "}


@query("mini_facts", "with f as (select doc_id, [" + ", ".join(f"regexp_matches(text, '{p}')" for p in FACTS.values()) + "] as f from documents) select doc_id, cast(len(list_filter(f, lambda x: x)) as integer) as groups from f")
def mini_facts(t):
    return t.documents.select("doc_id", F.size(F.filter(F.array(*(F.col("text").rlike(p) for p in FACTS.values())), lambda x: x)).alias("groups"))


@query("cf_resolution_default", f"with {MERGED} select a.head, a.tail, case when a.evidence > b.evidence or (a.evidence = b.evidence and a.confidence > b.confidence) then 'KEEP_A' when b.evidence > a.evidence or (a.evidence = b.evidence and b.confidence > a.confidence) then 'KEEP_B' else 'KEEP_BOTH' end as decision from kept a join kept b on a.head = b.head and a.tail = b.tail where a.relation = 'increases' and b.relation = 'reduces'")
def cf_resolution_default(t):
    return M.resolve(M.contradictions(M.merge_triples(triples(t)), M.contradiction_pairs(t.spark))).select("head", "tail", "decision")


@query("cf_resolution")
def cf_resolution(t):
    """The order-dependent fold: pairs in order of their ends, skipped once a side was rejected, each head apart."""
    p = M.resolve(M.contradictions(M.merge_triples(triples(t)), M.contradiction_pairs(t.spark)))
    ident = lambda r: F.concat_ws("|", F.col("head").cast("string"), F.col(r), F.col("tail"))
    p = p.select(F.col("head").alias("component"), F.row_number().over(W.partitionBy("head").orderBy("tail", "relation")).cast("bigint").alias("seq"), ident("relation").alias("a"), ident("opposite").alias("b"), "decision")
    return M.resolve_in_order(p)


# ---- sinks: what they write


@query("snk_unified_kg", f"with {MERGED}, e as (select 'S' || head as name from kept union select tail from kept), m as (select 'S' || s_suppkey as name, cast(s_nationkey as varchar) as kind from supplier where s_suppkey % 2 = 0) select e.name, coalesce(m.kind, 'Other') as kind from e left join m on e.name = m.name")
def snk_unified_kg(t):
    k = M.merge_triples(triples(t))
    e = k.select(F.concat(F.lit("S"), F.col("head").cast("string")).alias("name")).union(k.select("tail")).distinct()
    m = t.supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_nationkey").cast("string").alias("kind"))
    return e.join(m, "name", "left").select("name", F.coalesce("kind", F.lit("Other")).alias("kind"))


@query("snk_jsonl", "select o_orderkey, '{\"cust\":' || o_custkey || ',\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' as line from orders")
def snk_jsonl(t):
    return t.orders.select("o_orderkey", F.to_json(F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("line"))


@query("snk_writer_v1", "select o_orderstatus as decision, count(*) as n from orders group by 1")
def snk_writer_v1(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("decision")).agg(F.count("*").alias("n"))


@query("snk_writer_v2", "select 'edges' as artefact, count(distinct l_orderkey) as n from lineitem union all select 'incidence', count(*) from (select distinct l_orderkey, l_partkey from lineitem) union all select 'review', count(*) from orders where o_orderstatus = 'P'")
def snk_writer_v2(t):
    a = t.lineitem.agg(F.count_distinct("l_orderkey").alias("n")).select(F.lit("edges").alias("artefact"), "n")
    b = t.lineitem.agg(F.count_distinct("l_orderkey", "l_partkey").alias("n")).select(F.lit("incidence").alias("artefact"), "n")
    c = t.orders.where("o_orderstatus = 'P'").agg(F.count("*").alias("n")).select(F.lit("review").alias("artefact"), "n")
    return a.unionByName(b).unionByName(c)


@query("snk_store_f", "select o_orderkey % 40 as article_id, count(*) as n, min(o_orderkey) as first from orders group by 1")
def snk_store_f(t):
    return t.orders.groupBy((F.col("o_orderkey") % 40).alias("article_id")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("snk_vec", "select label as namespace, vec_id, cast(len(embedding) as integer) as dim, cast(round(cast(embedding[1] as double) * 1e6) as bigint) as first from embeddings")
def snk_vec(t):
    return t.embeddings.select(F.col("label").alias("namespace"), "vec_id", F.size("embedding").alias("dim"), micro(F.element_at("embedding", 1).cast("double"), "first"))


@query("snk_csv_split", "select doc_id, case when quality = 1 and toxic = 0 then 'relevant' else 'rejected' end as part from labels union all select doc_id, 'full' from labels")
def snk_csv_split(t):
    d = t.labels.select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "relevant").otherwise("rejected").alias("part"))
    return d.unionByName(t.labels.select("doc_id", F.lit("full").alias("part")))


@query("snk_rel_csv", f"with {TRIPLES}, u as (select lower(head || '_' || relation || '_' || tail) as key, 1 as stage, c from triples union all select lower(head || '_' || relation || '_' || tail), 2, c from triples where c >= 80 union all select lower(head || '_' || relation || '_' || tail), 3, c from triples where c >= 90 and k >= 90) select key, max(stage) as stage, case when max(stage) = 3 then 'YES' else 'NO' end as final from u group by key")
def snk_rel_csv(t):
    stage = F.when((F.col("c") >= 90) & (F.col("k") >= 90), 3).when(F.col("c") >= 80, 2).otherwise(1)
    key = F.lower(F.concat_ws("_", F.col("head").cast("string"), "relation", "tail"))
    return triples(t).groupBy(key.alias("key")).agg(F.max(stage).alias("stage")).withColumn("final", F.when(F.col("stage") == 3, "YES").otherwise("NO"))


@query("snk_flat_csv", "select r_regionkey, 'name' as field, r_name as value from region union all select r_regionkey, 'key', cast(r_regionkey as varchar) from region")
def snk_flat_csv(t):
    return t.region.select("r_regionkey", F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("key")).unpivot("r_regionkey", ["name", "key"], "field", "value")


@query("snk_html", f"with {TRIPLES}, u as (select 'S' || head as node from triples union all select tail from triples) select node, count(*) as degree, case when node like 'S%' then 'supplier' else 'brand' end as kind from u group by node")
def snk_html(t):
    d = triples(t)
    u = d.select(F.concat(F.lit("S"), F.col("head").cast("string")).alias("node")).unionByName(d.select(F.col("tail").alias("node")))
    return u.groupBy("node").agg(F.count("*").alias("degree")).withColumn("kind", F.when(F.col("node").startswith("S"), "supplier").otherwise("brand"))


# ---- batch forms of streams


@query("st_last_wins", "select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1")
def st_last_wins(t):
    return t.events.groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("st_rate_limit", "select event_id, count(*) over (partition by user_id % 10 order by ts range between interval 60 seconds preceding and current row) as calls from events")
def st_rate_limit(t):
    t.events.withColumn("g", F.col("user_id") % 10).createOrReplaceTempView("_calls")
    return t.spark.sql("select event_id, count(*) over (partition by g order by ts range between interval 60 seconds preceding and current row) as calls from _calls")


@query("st_cross_doc_state", f"with {TRIPLES}, f as (select head, tail, relation, min(article) as first from triples group by 1, 2, 3) select a.head, a.tail, a.relation, count(*) as earlier from f a join f b on a.head = b.head and a.tail = b.tail and a.relation <> b.relation and b.first < a.first group by 1, 2, 3")
def st_cross_doc_state(t):
    f = triples(t).groupBy("head", "tail", "relation").agg(F.min("article").alias("first"))
    g = f.groupBy("head", "tail").agg(F.collect_list(F.struct("relation", "first")).alias("rs"))  # as many as there are relations
    e = g.select("head", "tail", F.explode("rs").alias("x"), "rs").select("head", "tail", "x.relation", F.size(F.filter("rs", lambda y: (y["first"] < F.col("x.first")) & (y["relation"] != F.col("x.relation")))).cast("bigint").alias("earlier"))
    return e.where("earlier > 0")


@query("st_ordered_completion", "select event_id, row_number() over (order by event_id) as place from events where event_type = 'purchase'")
def st_ordered_completion(t):
    return global_number(t.events.where("event_type = 'purchase'"), "event_id", "place").select("event_id", F.col("place").cast("bigint").alias("place"))


@query("st_micro_budget", "select event_id, case when row_number() over (partition by event_id // 500 order by event_id) <= 25 then 'admitted' else 'deferred' end as decision from events where event_type <> 'view'")
def st_micro_budget(t):
    n = F.row_number().over(W.partitionBy(F.floor(F.col("event_id") / 500)).orderBy("event_id"))
    return t.events.where("event_type <> 'view'").select("event_id", F.when(n <= 25, "admitted").otherwise("deferred").alias("decision"))


# ---- whole plans


@query("plan_aggregation", f"with {MERGED}, bad as (select a.head, a.tail, case when a.evidence > b.evidence or (a.evidence = b.evidence and a.confidence > b.confidence) then 'reduces' when b.evidence > a.evidence or (a.evidence = b.evidence and b.confidence > a.confidence) then 'increases' end as gone from kept a join kept b on a.head = b.head and a.tail = b.tail where a.relation = 'increases' and b.relation = 'reduces') select relation, count(*) as n from kept where not exists (select 1 from bad where bad.head = kept.head and bad.tail = kept.tail and bad.gone = kept.relation) group by relation")
def plan_aggregation(t):
    """Merge, find contradictions, resolve them, drop what lost, and count what stays."""
    m = M.merge_triples(triples(t))
    p = M.resolve(M.contradictions(m, M.contradiction_pairs(t.spark)))
    gone = p.select("head", "tail", F.when(F.col("decision") == "KEEP_A", F.col("opposite")).when(F.col("decision") == "KEEP_B", F.col("relation")).alias("relation")).where("relation is not null")
    return m.join(gone, ["head", "tail", "relation"], "left_anti").groupBy("relation").agg(F.count("*").alias("n"))


@query("plan_retrieval", f"with {HOP}, x as (select edge from seeds union select edge from one), {BUCKET_SQL} select bucket, count(*) as edges, count(case when x.edge in (select edge from seeds) then 1 end) as seeds from x join orders on x.edge = o_orderkey join b on b.claim_type = {CLAIM_SQL} group by bucket")
def plan_retrieval(t):
    """Seeds, one hop, buckets."""
    inc = incidence(t)
    seeds = inc.where("entity < 5").select("edge").distinct()
    x = seeds.union(one_hop(inc, seeds)).distinct().join(seeds.withColumn("s", F.lit(1)), "edge", "left")
    d = bucketed(t).join(x, F.col("o_orderkey") == F.col("edge"))
    return d.groupBy("bucket").agg(F.count("*").alias("edges"), F.count("s").alias("seeds"))


# ---- scorer interfaces with their deterministic defaults


@query("udf_auto_edge", "with r as (select l_orderkey, l_partkey, cast(round(100 - l_discount * 300) as bigint) as c, row_number() over (partition by l_orderkey order by l_discount, l_partkey, l_linenumber) as n from lineitem) select l_orderkey, string_agg(cast(l_partkey as varchar), '|' order by n) as participants, cast(round(sum(c) / cast(count(*) as double) * 100) as bigint) as confidence from r where n <= 5 group by 1")
def udf_auto_edge(t):
    d = t.lineitem.select("l_orderkey", "l_partkey", F.expr("cast(round(100 - l_discount * 300) as bigint)").alias("c"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_discount", "l_partkey", "l_linenumber")).alias("n")).where("n <= 5")
    g = d.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "l_partkey"))).alias("x"), F.round(F.sum("c") / F.count("*") * 100).cast("bigint").alias("confidence"))
    return g.select("l_orderkey", F.array_join(F.transform("x", lambda v: v["l_partkey"].cast("string")), "|").alias("participants"), "confidence")


@query("udf_review_queue", f"with {ROUTES_SQL}, u as (select o_orderkey, 'routing' as kind, r as detail from q where r <> '' union all select o_orderkey, 'partial', o_orderstatus from orders where o_orderstatus = 'P') select o_orderkey, kind, detail from u")
def udf_review_queue(t):
    r = routes(t).where(F.size("r") > 0).select("o_orderkey", F.lit("routing").alias("kind"), F.array_join("r", "|").alias("detail"))
    return r.unionByName(t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("partial").alias("kind"), F.col("o_orderstatus").alias("detail")))


