"""Sources, screens, joins and aggregations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as T
from ..operators import merge as M
from ..registry import query
from ..sources.binding import TRIPLES, triples
from .text_queries import LABEL_SQL, LINES_SQL, lines, words_sql

MERGED = f"""{TRIPLES}, g as (
  select head, relation, tail, count(*) as members, count(distinct article) as evidence, sum(c) / cast(count(*) as double) / 1e2 as mc, sum(r) / cast(count(*) as double) / 1e2 as mr, sum(k) / cast(count(*) as double) / 1e2 as mk,
    string_agg(distinct cast(article as varchar), '|') as arts from triples group by head, relation, tail
), merged as (
  select *, least(mc + least((evidence - 1) * 3e-2, 1e-1), 1e0) as confidence from g
), kept as (select * from merged where 5e-1 * confidence + 25e-2 * mk + 25e-2 * mr >= 6e-1)"""  # fmt: skip


def micro(c, name):
    return F.round(c * 1e6).cast("bigint").alias(name)


def join_sorted(c, name):
    return F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), "|").alias(name)


def containing(texts, text: str, words, word: str):
    """Pairs of a row of ``texts`` and a distinct word (3 characters or more) that its text contains.

    Words are looked up by their first three characters among those that start anywhere in
    the text, so no text meets a word that it can't contain but by those three.
    """
    starts = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))
    keyed = words.where(F.length(word) >= 3).withColumn("_k", F.substring(word, 1, 3))
    return texts.withColumn("_k", F.explode(starts)).join(keyed, "_k").where(F.contains(F.col(text), F.col(word))).drop("_k")


# ---- sources


@query("src_text_dir", f"select doc_id, cast(length(text) as bigint) as chars, cast({words_sql('text')} as bigint) as words from documents")
def src_text_dir(t):
    return t.documents.select("doc_id", F.length("text").cast("bigint").alias("chars"), T.word_count(F.col("text")).cast("bigint").alias("words"))


@query("src_kg_json", f"with {TRIPLES} select 'article_' || article as article_id, head, relation, tail, coalesce(nullif(c, 100), 0) as c from triples where article not in (7, 13)")
def src_kg_json(t):
    d = triples(t).where("article not in (7, 13)")
    return d.select(F.concat(F.lit("article_"), F.col("article").cast("string")).alias("article_id"), "head", "relation", "tail", F.coalesce(F.nullif("c", F.lit(100)), F.lit(0)).alias("c"))


@query("src_summaries", "select p.page_id, coalesce(d.n, 0) as n from pages p left join (select doc_id, cast(length(text) as bigint) as n from documents where doc_id % 2 = 0) d on p.page_id = d.doc_id")
def src_summaries(t):
    d = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("page_id"), F.length("text").cast("bigint").alias("n"))
    return t.pages.select("page_id").join(d, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("src_article_output", f"with {LINES_SQL}, u as (select doc_id // 2 as base, 0 as rank, doc_id, pos from lines where doc_id % 3 <> 0 union all select doc_id // 2, 1, doc_id, pos from lines where doc_id % 3 <> 1), f as (select base, min(rank * 1000000000000 + doc_id) as k from u group by base) select u.base, u.doc_id, printf('seg%04d', u.pos + 1) as segment from u join f on u.base = f.base and u.rank * 1000000000000 + u.doc_id = f.k")
def src_article_output(t):
    d = lines(t).select("doc_id", "pos")
    u = d.where("doc_id % 3 <> 0").withColumn("rank", F.lit(0)).unionByName(d.where("doc_id % 3 <> 1").withColumn("rank", F.lit(1))).withColumn("base", F.floor(F.col("doc_id") / 2))
    u = u.withColumn("k", F.struct("rank", "doc_id"))
    first = u.groupBy("base").agg(F.min("k").alias("k"))
    return u.join(first, ["base", "k"]).select("base", "doc_id", F.format_string("seg%04d", F.col("pos") + 1).alias("segment"))


@query("src_claims_jsonl", "with c as (select conv_id, turn, trim(text) as text, row_number() over (partition by conv_id order by case when turn = conv_id % 4 then 0 else 1 end, turn) as n from conversations where role <> 'system' and trim(text) <> '') select conv_id, turn, text from c where n = 1")
def src_claims_jsonl(t):
    c = t.conversations.where("role <> 'system' and trim(text) <> ''")
    best = c.groupBy("conv_id").agg(F.min(F.struct(F.when(F.col("turn") == F.col("conv_id") % 4, 0).otherwise(1).alias("p"), "turn", F.trim("text").alias("text"))).alias("m"))
    return best.select("conv_id", "m.turn", "m.text")


@query("src_claims_json_part", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where json_extract_string(props, '$.k') is not null")
def src_claims_json_part(t):
    return t.events.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k")).where("k is not null")


@query("src_summ_index", "with s as (select doc_id as id, case when doc_id % 3 = 0 then '' else text end as x from documents where doc_id % 2 = 0), c as (select doc_id as id, 'claim: ' || text as y from documents where doc_id % 5 <> 0) select coalesce(s.id, c.id) as id, coalesce(nullif(x, ''), y, '') as body from s full join c on s.id = c.id")
def src_summ_index(t):
    s = t.documents.where("doc_id % 2 = 0").selectExpr("doc_id as id", "case when doc_id % 3 = 0 then '' else text end as x")
    c = t.documents.where("doc_id % 5 <> 0").selectExpr("doc_id as id", "'claim: ' || text as y")
    return s.join(c, "id", "full").select("id", F.coalesce(F.nullif("x", F.lit("")), "y", F.lit("")).alias("body"))


@query("src_unified_kg", "with n as (select p_partkey as id, lower(unnest(list_concat([p_name], string_split(p_name, ' ')))) as name from part) select name, count(distinct id) as ids, min(id) as first_id from n group by name")
def src_unified_kg(t):
    n = t.part.select(F.col("p_partkey").alias("id"), F.explode(F.array_union(F.array("p_name"), F.split("p_name", " "))).alias("name"))
    n = n.select("id", F.lower("name").alias("name")).distinct()
    return n.groupBy("name").agg(F.count("*").alias("ids"), F.min("id").alias("first_id"))


@query("src_catalog", "select p_partkey, p_name, p_type, len(regexp_split_to_array(replace(p_name, ' ', ';'), '[;|]')) as synonyms from part where p_type in ('STANDARD', 'PROMO') or p_partkey % 10 = 0")
def src_catalog(t):
    d = t.part.where(F.col("p_type").isin("STANDARD", "PROMO") | (F.col("p_partkey") % 10 == 0))
    return d.select("p_partkey", "p_name", "p_type", F.size(F.split(F.replace("p_name", F.lit(" "), F.lit(";")), "[;|]")).cast("bigint").alias("synonyms"))


@query("src_csv", "select doc_id, source from documents order by doc_id limit 50")
def src_csv(t):
    return t.documents.select("doc_id", "source").orderBy("doc_id").limit(50)


URL_STEM = "lower(trim(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '_'))"


@query("src_csv_index", "with k as (select page_id, unnest([lower(trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_')), regexp_extract(url, '//([^/]+)', 1)]) as key from pages) select key, max(page_id) as page_id from k group by key")
def src_csv_index(t):
    k = t.pages.select("page_id", F.explode(F.array(T.filename_norm(F.col("url")), F.regexp_extract("url", "//([^/]+)", 1))).alias("key"))
    return k.groupBy("key").agg(F.max("page_id").alias("page_id"))


@query("src_vec_ns", "select label, count(*) as n, cast(min(len(embedding)) as integer) as dim_min, cast(max(len(embedding)) as integer) as dim_max from embeddings group by label")
def src_vec_ns(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim_min"), F.max(F.size("embedding")).alias("dim_max"))


@query("src_edge_store", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def src_edge_store(t):
    m = t.events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("m"))
    return m.select("user_id", "m.event_id", "m.event_type")


@query("src_incidence", "select distinct l_orderkey as edge, l_partkey as entity, 'part' as kind from lineitem where l_returnflag <> 'N' union select distinct o_orderkey, o_custkey, 'customer' from orders where o_orderstatus = 'F'")
def src_incidence(t):
    a = t.lineitem.where("l_returnflag <> 'N'").selectExpr("l_orderkey as edge", "l_partkey as entity", "'part' as kind")
    return a.unionByName(t.orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey as edge", "o_custkey as entity", "'customer' as kind")).distinct()


@query("src_pdf_layout", "with h as (select page_id, regexp_extract_all(html, '<(h[1-6]|p|li|td|th)[^>]*>', 1) as tags from pages) select page_id, cast(len(list_filter(tags, lambda x: x like 'h%')) as bigint) as headings, cast(len(list_filter(tags, lambda x: x = 'p')) as bigint) as blocks, cast(len(list_filter(tags, lambda x: x in ('td', 'th'))) as bigint) as cells from h")
def src_pdf_layout(t):
    h = t.pages.select("page_id", F.regexp_extract_all("html", F.lit("<(h[1-6]|p|li|td|th)[^>]*>"), F.lit(1)).alias("tags"))
    n = lambda f: F.size(F.filter("tags", f)).cast("bigint")
    return h.select("page_id", n(lambda x: x.like("h%") ).alias("headings"), n(lambda x: x == "p").alias("blocks"), n(lambda x: x.isin("td", "th")).alias("cells"))


# ---- screens

SECTION_LINE = "case (doc_id + pos) % 7 when 0 then 'Abstract' when 2 then 'Methods' when 3 then 'Results' when 5 then 'Discussion' else line end"
SCREEN_SQL = "case " + " ".join(f"when regexp_matches(x, '^({p})$') then '{k}'" for k, p in V.SCREEN_SECTIONS.items()) + " end"
SECTIONS_SQL = f"""{LINES_SQL}, h as (select doc_id, pos, line, lower(trim({SECTION_LINE})) as x, {SECTION_LINE} as shown from lines), m as (
  select doc_id, pos, shown, {SCREEN_SQL} as head from h), s as (
  select *, sum(case when head is null then 0 else 1 end) over (partition by doc_id order by pos rows unbounded preceding) as sec from m), b as (
  select doc_id, sec, max(head) as section, sum(case when head is null then {words_sql('shown')} else 0 end) as words from s where sec > 0 group by doc_id, sec)"""  # fmt: skip


def section_bodies(t):
    """(doc_id, sec, section, words): a section is a header line and what follows to the next."""
    d = lines(t).withColumn("shown", F.expr(SECTION_LINE))
    x, head = F.lower(F.trim("shown")), None
    for k, p in V.SCREEN_SECTIONS.items():
        head = F.when(x.rlike(f"^({p})$"), k) if head is None else head.when(x.rlike(f"^({p})$"), k)
    d = d.withColumn("head", head)
    d = d.withColumn("sec", F.sum(F.when(F.col("head").isNull(), 0).otherwise(1)).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    words = F.when(F.col("head").isNull(), T.word_count(F.col("shown"))).otherwise(0)
    return d.where("sec > 0").groupBy("doc_id", "sec").agg(F.max("head").alias("section"), F.sum(words).alias("words"))


@query("flt_sections", f"with {SECTIONS_SQL} select doc_id, section, cast(sum(words) as bigint) as words from b group by doc_id, section")
def flt_sections(t):
    return section_bodies(t).groupBy("doc_id", "section").agg(F.sum("words").alias("words"))


@query("flt_doc_quality", f"""with {SECTIONS_SQL}, c as (select doc_id, section, sum(words) as words from b group by doc_id, section), k as (
  select doc_id, count(*) as kinds, max(case when section = 'abstract' then words end) as abstract, count(case when section <> 'abstract' and words >= 200 then 1 end) as long from c group by doc_id)
select d.doc_id, case when {words_sql('d.text')} < 80 then 'too short' when coalesce(kinds, 0) < 3 then 'too few sections' when abstract < 100 then 'short abstract' when coalesce(long, 0) < 2 then 'thin body' else 'pass' end as reason from documents d left join k on d.doc_id = k.doc_id""")  # fmt: skip
def flt_doc_quality(t):
    c = section_bodies(t).groupBy("doc_id", "section").agg(F.sum("words").alias("words"))
    k = c.groupBy("doc_id").agg(F.count("*").alias("kinds"), F.max(F.when(F.col("section") == "abstract", F.col("words"))).alias("abstract"), F.count(F.when((F.col("section") != "abstract") & (F.col("words") >= 200), 1)).alias("long"))
    reason = F.when(F.col("total") < 80, "too short").when(F.coalesce("kinds", F.lit(0)) < 3, "too few sections").when(F.col("abstract") < 100, "short abstract").when(F.coalesce("long", F.lit(0)) < 2, "thin body").otherwise("pass")
    return t.documents.select("doc_id", T.word_count(F.col("text")).alias("total")).join(k, "doc_id", "left").select("doc_id", reason.alias("reason"))


SCORE_SQL = "case label " + " ".join(f"when '{k}' then {round(s * 100)}" for k, s in V.SECTION_SCORES.items()) + " else 50 end"
SCORED_SQL = f"{LINES_SQL}, l as (select doc_id, pos, line as x from lines), s as (select doc_id, pos, {LABEL_SQL} as label, {words_sql('x')} as n from l), q as (select doc_id, cast(pos as integer) as pos, label, cast(least(1000, {SCORE_SQL} * case when n < 10 then 5 when n > 100 then 11 else 10 end) as integer) as score from s)"


def scored_segments(t):
    return lines(t).select("doc_id", "pos", T.section_label(F.col("line")).alias("label"), T.word_count(F.col("line")).alias("n")).select("doc_id", "pos", "label", T.default_score(F.col("label"), F.col("n")).cast("int").alias("score"))


@query("flt_default_score", f"with {SCORED_SQL} select * from q")
def flt_default_score(t):
    return scored_segments(t)


@query("flt_relevance", f"with {SCORED_SQL} select * from q where score >= 200")
def flt_relevance(t):
    return scored_segments(t).where("score >= 200")


@query("flt_integration", f"with {TRIPLES} select l_orderkey, l_linenumber, 2 * case when c <= 0 then 50 else c end + case when k <= 0 then 50 else k end + case when r <= 0 then 50 else r end as score from triples where 2 * case when c <= 0 then 50 else c end + case when k <= 0 then 50 else k end + case when r <= 0 then 50 else r end >= 240")
def flt_integration(t):
    fix = lambda x: F.when(F.col(x) <= 0, 50).otherwise(F.col(x))
    return triples(t).select("l_orderkey", "l_linenumber", (2 * fix("c") + fix("k") + fix("r")).alias("score")).where("score >= 240")


@query("flt_quality_c", f"with {MERGED} select head, relation, tail, members from kept")
def flt_quality_c(t):
    return M.merge_triples(triples(t)).select("head", "relation", "tail", "members")


VERDICT = "case doc_id % 4 when 0 then 'In' when 1 then 'out' when 2 then 'Inconclusive' else null end"


@query("flt_in_out", f"select doc_id, coalesce({VERDICT}, 'missing') as verdict, regexp_matches(lower(coalesce({VERDICT}, '')), '^in([^a-z]|$)') as relevant from labels")
def flt_in_out(t):
    d = t.labels.select("doc_id", F.expr(VERDICT).alias("v"))
    return d.select("doc_id", F.coalesce("v", F.lit("missing")).alias("verdict"), F.lower(F.coalesce("v", F.lit(""))).rlike("^in([^a-z]|$)").alias("relevant"))


@query("flt_prefilter_edges", "with n as (select l_orderkey, count(distinct l_partkey) as entities, sum(length(p_name)) as chars from lineitem join part on l_partkey = p_partkey group by l_orderkey) select o_orderkey, entities, cast(chars as bigint) as chars from orders join n on o_orderkey = l_orderkey where entities >= 2 and chars >= 60")
def flt_prefilter_edges(t):
    names = t.part.select(F.col("p_partkey").alias("l_partkey"), F.length("p_name").alias("len"))
    n = t.lineitem.join(names, "l_partkey").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("entities"), F.sum("len").alias("chars"))
    return t.orders.join(n.where("entities >= 2 and chars >= 60"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "entities", "chars")


@query("flt_entity_exists", "with w as (select distinct lower(split_part(p_name, ' ', 2)) as w from part where p_size < 3) select p_partkey, p_name from part where exists (select 1 from w where length(w) >= 3 and (contains(lower(p_name), w) or contains(w, lower(p_name))))")
def flt_entity_exists(t):
    w = t.part.where("p_size < 3").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("w")).distinct().where("length(w) >= 3")
    names = t.part.select(F.lower("p_name").alias("low")).distinct()
    known = containing(names, "low", w, "w").select("low").unionByName(containing(w, "w", names, "low").select("low")).distinct()
    return t.part.join(known, F.lower("p_name") == F.col("low"), "left_semi").select("p_partkey", "p_name")


@query("flt_selfloop", "select l_orderkey, l_linenumber from lineitem join part on l_partkey = p_partkey where lower(trim('Brand#' || (l_suppkey % 25 + 1))) <> lower(trim(p_brand))")
def flt_selfloop(t):
    d = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return d.where(F.lower(F.trim(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")))) != F.lower(F.trim("p_brand"))).select("l_orderkey", "l_linenumber")


@query("flt_hedging", f"with d as (select doc_id, case doc_id % 3 when 0 then 'This may help. ' else '' end || text as x from documents) select doc_id, regexp_matches(lower(x), '(^|[^a-z0-9_])({V.HEDGES})([^a-z0-9_]|$)') as hedged from d")
def flt_hedging(t):
    x = F.expr("case doc_id % 3 when 0 then 'This may help. ' else '' end || text")
    return t.documents.select("doc_id", F.lower(x).rlike(f"(^|[^a-z0-9_])({V.HEDGES})([^a-z0-9_]|$)").alias("hedged"))


MEDICATION = "medication|medicine|drug|risperidone|antipsychotic"


@query("flt_medication_re", f"select conv_id, turn from conversations where regexp_matches(lower(case turn when 1 then 'use risperidone ' else '' end || text), '(^|[^a-z])({MEDICATION})([^a-z]|$)')")
def flt_medication_re(t):
    return t.conversations.where(F.lower(F.expr("case turn when 1 then 'use risperidone ' else '' end || text")).rlike(f"(^|[^a-z])({MEDICATION})([^a-z]|$)")).select("conv_id", "turn")


@query("flt_noise", "with d as (select doc_id, case doc_id % 4 when 0 then 'Keywords: x ' when 1 then 'A 9-year-old boy; ' else '' end || text as x from documents) select doc_id, (contains(lower(x), 'keywords:') or contains(lower(x), 'et al') or length(x) - length(replace(x, ';', '')) >= 4) as noise, regexp_matches(lower(x), '(^|[^0-9a-z])[0-9]{1,2}-year-old([^a-z]|$)') as patient from d")
def flt_noise(t):
    d = t.documents.select("doc_id", F.expr("case doc_id % 4 when 0 then 'Keywords: x ' when 1 then 'A 9-year-old boy; ' else '' end || text").alias("x"))
    low = F.lower("x")
    return d.select("doc_id", (F.contains(low, F.lit("keywords:")) | F.contains(low, F.lit("et al")) | (F.regexp_count("x", F.lit(";")) >= 4)).alias("noise"), low.rlike("(^|[^0-9a-z])[0-9]{1,2}-year-old([^a-z]|$)").alias("patient"))


@query("flt_catalog_type", "select p_partkey from part where p_type in ('ECONOMY', 'PROMO')")
def flt_catalog_type(t):
    return t.part.where(F.col("p_type").isin("ECONOMY", "PROMO")).select("p_partkey")


@query("flt_selected_csv", "select page_id from pages where page_id in (select doc_id from labels where quality = 1)")
def flt_selected_csv(t):
    return t.pages.join(t.labels.where("quality = 1"), F.col("page_id") == F.col("doc_id"), "left_semi").select("page_id")


@query("flt_resume_anti", "select event_id from events where event_id not in (select doc_id from labels)")
def flt_resume_anti(t):
    return t.events.select("event_id").join(t.labels, F.col("event_id") == F.col("doc_id"), "left_anti")


@query("flt_metadata_eq", "select vec_id from embeddings where label = 3")
def flt_metadata_eq(t):
    return t.embeddings.where("label = 3").select("vec_id")


@query("flt_evidence_ids", "select l_orderkey, l_linenumber from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'P')")
def flt_evidence_ids(t):
    return t.lineitem.select("l_orderkey", "l_linenumber").join(t.orders.where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


# ---- joins


@query("jn_canonical_map", "select l_orderkey, l_linenumber, coalesce(cast(s.s_nationkey as varchar), cast(l_suppkey as varchar)) as head, coalesce(p_brand, cast(l_partkey as varchar)) as tail from lineitem left join (select * from supplier where s_suppkey % 3 <> 0) s on l_suppkey = s_suppkey left join (select * from part where p_partkey % 4 <> 0) on l_partkey = p_partkey")
def jn_canonical_map(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("head"), F.col("l_partkey").cast("string").alias("tail"))
    heads = t.supplier.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").cast("string").alias("name"), F.col("s_nationkey").cast("string").alias("canonical"))
    tails = t.part.where("p_partkey % 4 <> 0").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("canonical"))
    return M.canonical_names(M.canonical_names(d, heads, "head"), tails, "tail").select("l_orderkey", "l_linenumber", "head", "tail")


@query("jn_contradiction", f"with {MERGED} select a.head, a.tail, a.relation as relation_a, b.relation as relation_b from kept a join kept b on a.head = b.head and a.tail = b.tail where a.relation = 'increases' and b.relation = 'reduces'")
def jn_contradiction(t):
    pairs = M.contradictions(M.merge_triples(triples(t)), M.contradiction_pairs(t.spark))
    return pairs.select("head", "tail", F.col("relation").alias("relation_a"), F.col("opposite").alias("relation_b"))


@query("jn_contradiction_b", f"with {TRIPLES}, x as (select head, tail, case relation when 'reduces' then 'increases' else 'reduces' end as relation, max(c) as other from triples where article % 2 = 1 and relation in ('reduces', 'increases') group by 1, 2, 3) select l_orderkey, l_linenumber from triples n left join x on n.head = x.head and n.tail = x.tail and n.relation = x.relation where n.article % 2 = 0 and (other is null or c > other)")
def jn_contradiction_b(t):
    d = triples(t)
    pairs = F.broadcast(M.contradiction_pairs(t.spark, [("reduces", "increases")]))
    old = d.where("article % 2 = 1").groupBy("head", "tail", F.col("relation").alias("opposite")).agg(F.max("c").alias("other"))
    new = d.where("article % 2 = 0").join(pairs, "relation", "left")
    return new.join(old, ["head", "tail", "opposite"], "left").where("other is null or c > other").select("l_orderkey", "l_linenumber")


@query("jn_local_kg", "select o_orderkey, coalesce(a.n, b.n, c.n, 0) as n from orders left join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) a on o_orderkey = a.l_orderkey left join (select l_orderkey, count(*) * 10 as n from lineitem group by 1) b on o_orderkey = b.l_orderkey left join (select o_custkey as k, count(*) * 100 as n from orders group by 1) c on o_custkey = c.k")
def jn_local_kg(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("all"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    c = t.orders.groupBy("o_custkey").agg((F.count("*") * 100).alias("cn"))
    d = t.orders.select("o_orderkey", "o_custkey").join(a, "o_orderkey", "left").join(c, "o_custkey", "left")
    return d.select("o_orderkey", F.coalesce(F.when(F.col("r") > 0, F.col("r")), F.col("all") * 10, "cn", F.lit(0)).alias("n"))


@query("jn_entity_link_exact", "with k as (select p_partkey as id, 0 as pr, lower(p_name) as key from part where p_partkey % 2 = 0 union all select p_partkey, 1, lower(split_part(p_name, ' ', 1)) from part where p_partkey % 2 = 0), f as (select key, min(pr * 1000000000000 + id) as b from k group by key), q as (select p_partkey as q, 0 as pr, lower(p_name) as key from part where p_partkey % 2 = 1 union all select p_partkey, 1, lower(split_part(p_name, ' ', 1)) from part where p_partkey % 2 = 1), j as (select q, min(q.pr * 10000000000000 + b) as b from q join f on q.key = f.key group by q) select q, b % 1000000000000 as entity from j")
def jn_entity_link_exact(t):
    def keys(d, id_name):
        return d.select(F.col("p_partkey").alias(id_name), F.posexplode(F.array(F.lower("p_name"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))))).alias("pr", "key"))

    first = keys(t.part.where("p_partkey % 2 = 0"), "id").groupBy("key").agg(F.min(F.struct("pr", "id")).alias("b"))
    q = keys(t.part.where("p_partkey % 2 = 1"), "q").join(first, "key").groupBy("q").agg(F.min(F.struct("pr", "b")).alias("m"))
    return q.select("q", F.col("m.b.id").alias("entity"))


@query("jn_mention_contain", "with w as (select distinct lower(split_part(p_name, ' ', 1)) as w from part), d as (select doc_id, lower(case doc_id % 5 when 0 then 'a red hot thing ' when 1 then 'small blue ' else '' end || text) as x from documents) select doc_id, w, 300 + least(length(w), 80) as score from d join w on contains(x, w) where length(w) >= 3")
def jn_mention_contain(t):
    w = t.part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("w")).distinct().where("length(w) >= 3")
    d = t.documents.select("doc_id", F.lower(F.expr("case doc_id % 5 when 0 then 'a red hot thing ' when 1 then 'small blue ' else '' end || text")).alias("x"))
    return containing(d, "x", w, "w").select("doc_id", "w", (F.lit(300) + F.least(F.length("w"), F.lit(80))).cast("bigint").alias("score"))


@query("jn_claim_span", "with r as (select trim(text) as k, min(conv_id * 1000 + turn) as first from conversations where role = 'assistant' group by 1) select c.conv_id, c.turn, r.first from conversations c left join r on trim(c.text) = r.k")
def jn_claim_span(t):
    r = t.conversations.where("role = 'assistant'").groupBy(F.trim("text").alias("k")).agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first"))
    return t.conversations.withColumn("k", F.trim("text")).join(r, "k", "left").select("conv_id", "turn", "first")


@query("jn_name_lookup", "with j as (select a.p_partkey as q, b.p_partkey as hit, row_number() over (partition by a.p_partkey order by b.p_partkey) as n from part a join part b on lower(trim(a.p_name)) = lower(trim(b.p_name))) select q, hit from j where n <= 3")
def jn_name_lookup(t):
    key = F.lower(F.trim("p_name"))
    best = t.part.select(key.alias("k"), F.col("p_partkey").alias("hit")).withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("hit"))).where("n <= 3")
    return t.part.select(key.alias("k"), F.col("p_partkey").alias("q")).join(best, "k").select("q", "hit")


@query("jn_triples_by_entity", f"with {TRIPLES}, u as (select head as e, l_orderkey, l_linenumber, 0 as side from triples union all select cast(regexp_extract(tail, '[0-9]+') as bigint), l_orderkey, l_linenumber, 1 from triples), d as (select e, l_orderkey, l_linenumber, min(side) as side from u group by 1, 2, 3), r as (select *, row_number() over (partition by e order by side, l_orderkey, l_linenumber) as n from d) select e, l_orderkey, l_linenumber from r where n <= 20")
def jn_triples_by_entity(t):
    d = triples(t)
    u = d.selectExpr("head as e", "l_orderkey", "l_linenumber", "0 as side").unionByName(d.selectExpr("cast(regexp_extract(tail, '[0-9]+', 0) as bigint) as e", "l_orderkey", "l_linenumber", "1 as side"))
    # a line has two sides at most, so the first 20 lines are among the first 40 of (side, line); each task leaves out the rest before rows are dealt
    u = u.withColumn("n", F.dense_rank().over(W.partitionBy("e").orderBy("side", "l_orderkey", "l_linenumber"))).where("n <= 40")
    d = u.groupBy("e", "l_orderkey", "l_linenumber").agg(F.min("side").alias("side"))
    return d.withColumn("n", F.row_number().over(W.partitionBy("e").orderBy("side", "l_orderkey", "l_linenumber"))).where("n <= 20").drop("n", "side")


@query("jn_summaries_left", "select l_orderkey, l_linenumber, coalesce(md5(text), '') as body from lineitem left join documents on l_partkey = doc_id")
def jn_summaries_left(t):
    d = t.documents.select(F.col("doc_id").alias("l_partkey"), F.md5("text").alias("b"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(d, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("b", F.lit("")).alias("body"))


@query("jn_edge_entity_name", "select l_orderkey, l_linenumber, coalesce('E:' || p_partkey, 'E:' || coalesce(nullif(trim(regexp_replace(lower(trim(l_linestatus || ' ' || l_partkey)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')) as entity from lineitem left join part on l_partkey = p_partkey and p_size <= 25")
def jn_edge_entity_name(t):
    p = t.part.where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("E:"), F.col("p_partkey").cast("string")).alias("known"))
    made = F.concat(F.lit("E:"), T.slugify(F.concat("l_linestatus", F.lit(" "), F.col("l_partkey").cast("string"))))
    return t.lineitem.join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("known", made).alias("entity"))


@query("jn_source_packet", "with f as (select o_custkey, min(o_orderkey) as packet from orders group by 1) select o.o_orderkey, f.packet from orders o join f on o.o_custkey = f.o_custkey")
def jn_source_packet(t):
    f = t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("packet"))
    return t.orders.select("o_orderkey", "o_custkey").join(f, "o_custkey").select("o_orderkey", "packet")


@query("jn_table_section_asof", "with h as (select user_id, ts, event_id from events where event_type = 'signup'), e as (select user_id, ts, event_id from events where event_type = 'purchase') select e.event_id, coalesce(max_by(h.event_id, (h.ts, h.event_id)), -1) as section from e left join h on e.user_id = h.user_id and h.ts <= e.ts group by e.event_id")
def jn_table_section_asof(t):
    """Backward as-of join as one sort: the last head at or before each row of its key."""
    d = t.events.where("event_type in ('signup', 'purchase')").select("user_id", "ts", "event_id", (F.col("event_type") == "signup").alias("is_head"))
    order = W.partitionBy("user_id").orderBy("ts", F.desc("is_head"), "event_id").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("section", F.last(F.when(F.col("is_head"), F.col("event_id")), ignorenulls=True).over(order)).where("not is_head").select("event_id", F.coalesce("section", F.lit(-1)).alias("section"))


@query("jn_event_nodes", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 3)")
def jn_event_nodes(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(t.part.where("p_size > 3"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@query("jn_hits_store", "select l_orderkey, l_linenumber, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'")
def jn_hits_store(t):
    return t.lineitem.select("l_orderkey", "l_linenumber").join(t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("jn_strategy_substring", "with s as (select distinct lower(split_part(p_name, ' ', 3)) as s from part where p_size < 5) select distinct l_orderkey, s from lineitem join part on l_partkey = p_partkey join s on length(s) >= 3 and contains(lower(p_name), s)")
def jn_strategy_substring(t):
    s = t.part.where("p_size < 5").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(3))).alias("s")).distinct()
    hit = containing(t.part.select("p_partkey", F.lower("p_name").alias("low")), "low", s, "s").select("p_partkey", "s")
    return t.lineitem.join(hit, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "s").distinct()


# ---- aggregations


@query("agg_entity_sources", "select l_partkey as entity, string_agg(cast(l_suppkey as varchar), '|' order by l_suppkey) as sources, count(*) as n from lineitem group by l_partkey")
def agg_entity_sources(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("entity")).agg(join_sorted(F.collect_list("l_suppkey"), "sources"), F.count("*").alias("n"))


@query("agg_merge_triples", f"with {MERGED}, s as (select head, relation, tail, string_agg(cast(article as varchar), '|' order by article) as articles from (select distinct head, relation, tail, article from triples) group by 1, 2, 3) select kept.head, kept.relation, kept.tail, members, evidence, articles, cast(round(confidence * 1e6) as bigint) as confidence from kept join s on kept.head = s.head and kept.relation = s.relation and kept.tail = s.tail")
def agg_merge_triples(t):
    """Flagship: merged triples with provenance."""
    m = M.merge_triples(triples(t))
    return m.select("head", "relation", "tail", "members", "evidence", join_sorted(F.col("articles"), "articles"), micro(F.col("confidence"), "confidence"))


@query("agg_dedup_entities", "select lower(trim(p_name)) as key, min_by(p_type, p_partkey) filter (where p_type <> 'SMALL') as kind, string_agg(distinct p_brand, '|' order by p_brand) as aliases, count(*) as n from part group by 1")
def agg_dedup_entities(t):
    return t.part.groupBy(F.lower(F.trim("p_name")).alias("key")).agg(F.min_by("p_type", F.when(F.col("p_type") != "SMALL", F.col("p_partkey"))).alias("kind"), join_sorted(F.collect_set("p_brand"), "aliases"), F.count("*").alias("n"))


@query("agg_dedup_rels", f"with {TRIPLES}, r as (select *, row_number() over (partition by head, relation, tail order by c desc, l_orderkey, l_linenumber) as n from triples) select head, relation, tail, c, l_orderkey, l_linenumber from r where n = 1")
def agg_dedup_rels(t):
    best = triples(t).groupBy("head", "relation", "tail").agg(F.min(F.struct((-F.col("c")).alias("nc"), "l_orderkey", "l_linenumber")).alias("m"))
    return best.select("head", "relation", "tail", (-F.col("m.nc")).alias("c"), "m.l_orderkey", "m.l_linenumber")


@query("agg_kg_stats", f"with {TRIPLES} select relation, count(*) as n, count(distinct head) as heads, cast(round(coalesce(sum(c) / cast(count(*) as double), 0) * 1e4) as bigint) as mean_c from triples group by relation")
def agg_kg_stats(t):
    return triples(t).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("head").alias("heads"), F.round(F.sum("c") / F.count("*") * 1e4).cast("bigint").alias("mean_c"))


@query("agg_export_stats", f"with {MERGED} select count(*) as triples, count(case when evidence > 1 then 1 end) as multi_source, count(case when evidence = 1 then 1 end) as single_source, cast(round(sum(cast(round(confidence * 1e6) as bigint)) / cast(count(*) as double)) as bigint) as mean_confidence from kept")
def agg_export_stats(t):
    m = M.merge_triples(triples(t))
    return m.agg(F.count("*").alias("triples"), F.count_if(F.col("evidence") > 1).alias("multi_source"), F.count_if(F.col("evidence") == 1).alias("single_source"), F.round(F.sum(F.round(F.col("confidence") * 1e6).cast("bigint")) / F.count("*")).cast("bigint").alias("mean_confidence"))


@query("agg_relation_dist", f"with {TRIPLES} select relation, tail, count(*) as n from triples group by 1, 2 order by n desc, relation, tail limit 10")
def agg_relation_dist(t):
    return triples(t).groupBy("relation", "tail").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation", "tail").limit(10)


@query("agg_group_type", "with m as (select p_brand, p_name, p_type, count(*) as n from part join lineitem on l_partkey = p_partkey group by 1, 2, 3), k as (select p_brand, p_type, sum(n) as n from m where p_type <> 'SMALL' group by 1, 2), r as (select p_brand, p_name, sum(n) as n from m group by 1, 2), a as (select p_brand, p_type, row_number() over (partition by p_brand order by n desc, p_type) as i from k), b as (select p_brand, p_name, row_number() over (partition by p_brand order by n desc, p_name) as i from r) select a.p_brand as brand, b.p_name as representative, a.p_type as kind from a join b on a.p_brand = b.p_brand where a.i = 1 and b.i = 1")
def agg_group_type(t):
    uses = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    m = t.part.join(uses, F.col("p_partkey") == F.col("l_partkey"))
    kinds = m.where("p_type <> 'SMALL'").groupBy("p_brand", "p_type").agg(F.sum("n").alias("n")).groupBy(F.col("p_brand").alias("brand")).agg(F.min_by("p_type", F.struct((-F.col("n")).alias("k"), "p_type")).alias("kind"))
    names = m.groupBy("p_brand", "p_name").agg(F.sum("n").alias("n")).groupBy(F.col("p_brand").alias("brand")).agg(F.min_by("p_name", F.struct((-F.col("n")).alias("k"), "p_name")).alias("representative"))
    return kinds.join(names, "brand")


@query("agg_canonical_entity", "with m as (select p_brand, p_name, count(*) as n, count(distinct l_suppkey) as s from part join lineitem on l_partkey = p_partkey group by 1, 2), r as (select *, row_number() over (partition by p_brand order by n desc, p_name) as i from m), c as (select p_brand, p_name as canonical from r where i = 1) select c.p_brand as cluster, c.canonical, string_agg(m.p_name, '|' order by m.p_name) filter (where m.p_name <> c.canonical) as aliases, cast(sum(m.n) as bigint) as mentions from m join c on m.p_brand = c.p_brand group by 1, 2")
def agg_canonical_entity(t):
    uses = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    m = t.part.join(uses, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_name").agg(F.sum("n").alias("n"))
    g = m.groupBy(F.col("p_brand").alias("cluster")).agg(F.min_by("p_name", F.struct((-F.col("n")).alias("k"), "p_name")).alias("canonical"), F.collect_list("p_name").alias("names"), F.sum("n").alias("mentions"))
    return g.select("cluster", "canonical", F.array_join(F.array_sort(F.filter("names", lambda x: x != F.col("canonical"))), "|").alias("aliases"), "mentions")


CANONICAL = f"""with {TRIPLES}, n as (select head, tail, count(*) as n from triples group by 1, 2), t as (
  select head, count(*) as n, cast(round(sum(c) / cast(count(*) as double) * 1e4) as bigint) as mean_c, cast(round(sum(r) / cast(count(*) as double) * 1e4) as bigint) as mean_r, cast(round(sum(k) / cast(count(*) as double) * 1e4) as bigint) as mean_k from triples group by 1), l as (
  select head, relation, count(*) as n from triples group by 1, 2), w as (
  select head, relation, row_number() over (partition by head order by n desc, relation) as i from l), d as (
  select head, string_agg(relation || ':' || n, '|' order by relation) as relations from l group by 1), a as (
  select head, string_agg(cast(article as varchar), '|' order by article) as articles from (select distinct head, article from triples) group by 1), x as (
  select head, claim, row_number() over (partition by head order by length(claim) desc, claim) as i from (select distinct head, head || ' ' || relation || ' ' || tail as claim from triples where tail is not null)), r as (
  select *, row_number() over (partition by head order by n desc, tail) as i from n where tail is not null), m as (
  select r.head, string_agg(tail, '|' order by tail) filter (where r.n >= greatest(1, t.n // 20)) as core, string_agg(tail, '|' order by tail) filter (where i <= 2) as two from r join t on r.head = t.head group by 1)
select t.head, t.n, t.mean_c, t.mean_r, t.mean_k, w.relation as main_relation, d.relations, a.articles, x.claim, coalesce(m.core, m.two) as core
from t join w on t.head = w.head and w.i = 1 join d on t.head = d.head join a on t.head = a.head left join x on t.head = x.head and x.i = 1 left join m on t.head = m.head"""  # fmt: skip


@query("agg_canonical_v2", CANONICAL)
def agg_canonical_v2(t):
    """A canonical edge for each head: longest claim, means, counts of relations, most common relation, articles and core tails.

    Core are the tails of a 20th of the rows or more; where there is none, the two most common ones.
    """
    d = triples(t)
    mean = lambda c: F.round(F.sum(f"s{c}") / F.sum("k") * 1e4).cast("bigint").alias(f"mean_{c}")
    pre = d.groupBy("head", "relation", "tail").agg(F.count("*").alias("k"), *(F.sum(c).alias(f"s{c}") for c in "crk"))
    claim = F.concat_ws(" ", F.col("head").cast("string"), "relation", "tail")
    longest = F.min(F.when(F.col("tail").isNotNull(), F.struct((-F.length(claim)).alias("size"), claim.alias("claim"))))
    total = pre.groupBy("head").agg(F.sum("k").alias("n"), *(mean(c) for c in "crk"), longest.getField("claim").alias("claim"))
    counts = F.collect_list(F.struct("relation", "k"))
    relation = pre.groupBy("head", "relation").agg(F.sum("k").alias("k")).groupBy("head").agg(F.min_by("relation", F.struct((-F.col("k")).alias("nk"), "relation")).alias("main_relation"), F.array_sort(counts).alias("counts"))
    relation = relation.select("head", "main_relation", F.array_join(F.transform("counts", lambda x: F.concat(x["relation"], F.lit(":"), x["k"].cast("string"))), "|").alias("relations"))
    articles = d.groupBy("head").agg(join_sorted(F.collect_set("article"), "articles"))
    ranked = F.array_sort(F.collect_list(F.when(F.col("tail").isNotNull(), F.struct((-F.col("k")).alias("nk"), "tail"))))
    tails = pre.groupBy("head", "tail").agg(F.sum("k").alias("k")).groupBy("head").agg(ranked.alias("tails"))
    core = F.filter("tails", lambda x: -x["nk"] >= F.greatest(F.lit(1), F.floor(F.col("n") / 20)))
    core = F.when(F.size(core) > 0, core).otherwise(F.slice("tails", 1, 2))
    core = F.when(F.size("tails") > 0, F.array_join(F.array_sort(F.transform(core, lambda x: x["tail"])), "|"))
    return total.join(relation, "head").join(articles, "head").join(tails, "head").select("head", "n", "mean_c", "mean_r", "mean_k", "main_relation", "relations", "articles", "claim", core.alias("core"))


@query("agg_qualifiers", "select user_id, event_type, string_agg(distinct json_extract_string(props, '$.k'), '|' order by json_extract_string(props, '$.k')) as qualifier_values from events group by 1, 2")
def agg_qualifiers(t):
    return t.events.groupBy("user_id", "event_type").agg(join_sorted(F.collect_set(F.get_json_object("props", "$.k")), "qualifier_values"))


@query("agg_confidence", f"with {TRIPLES} select article, min(c) as lo, max(c) as hi, cast(round(sum(c) / cast(count(*) as double) * 1e2) as bigint) as mean from triples group by article")
def agg_confidence(t):
    return triples(t).groupBy("article").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.round(F.sum("c") / F.count("*") * 1e2).cast("bigint").alias("mean"))


@query("agg_scope", f"with {TRIPLES} select head, count(distinct article) as articles, string_agg(distinct relation, '|' order by relation) as relations from triples group by head")
def agg_scope(t):
    return triples(t).groupBy("head").agg(F.count_distinct("article").alias("articles"), join_sorted(F.collect_set("relation"), "relations"))


@query("agg_writer_counts", "select count(*) as n, count(case when o_orderstatus = 'F' then 1 end) as accepted, count(case when o_orderstatus = 'O' then 1 end) as review, count(case when o_orderstatus = 'P' then 1 end) as rejected from orders")
def agg_writer_counts(t):
    s = F.col("o_orderstatus")
    return t.orders.agg(F.count("*").alias("n"), F.count_if(s == "F").alias("accepted"), F.count_if(s == "O").alias("review"), F.count_if(s == "P").alias("rejected"))


@query("agg_usage_totals", "select event_type, count(*) as calls, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as tokens, count(case when value > 10 then 1 end) as slow from events where user_id > 0 group by 1")
def agg_usage_totals(t):
    return t.events.where("user_id > 0").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("tokens"), F.count_if(F.col("value") > 10).alias("slow"))


@query("agg_candidate_strategies", "select l_partkey as entity, count(distinct l_orderkey) as edges, count(distinct case when l_returnflag = 'R' then l_orderkey end) as supported from lineitem join part on l_partkey = p_partkey where p_type in ('ECONOMY', 'PROMO', 'SMALL') group by 1")
def agg_candidate_strategies(t):
    p = t.part.where(F.col("p_type").isin("ECONOMY", "PROMO", "SMALL")).select(F.col("p_partkey").alias("l_partkey"))
    e = t.lineitem.join(p, "l_partkey").groupBy(F.col("l_partkey").alias("entity"), "l_orderkey").agg(F.max(F.col("l_returnflag") == "R").alias("s"))
    return e.groupBy("entity").agg(F.count("*").alias("edges"), F.count_if("s").alias("supported"))


@query("agg_degree", f"with {TRIPLES}, u as (select 'S' || head as node from triples union all select tail from triples) select node, count(*) as degree from u group by node")
def agg_degree(t):
    d = triples(t)
    u = d.select(F.concat(F.lit("S"), F.col("head").cast("string")).alias("node")).unionByName(d.select(F.col("tail").alias("node")))
    return u.groupBy("node").agg(F.count("*").alias("degree"))


@query("agg_pipeline_stats", "select 'lineitem' as stage, count(*) as rows_out from lineitem union all select 'orders', count(*) from orders union all select 'events', count(*) from events")
def agg_pipeline_stats(t):
    one = lambda n: getattr(t, n).agg(F.count("*").alias("rows_out")).select(F.lit(n).alias("stage"), "rows_out")
    return one("lineitem").unionByName(one("orders")).unionByName(one("events"))

