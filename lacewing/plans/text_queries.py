"""Text scalars applied to the driver's tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import text as T
from ..registry import query, sql_case

WORDS_SQL = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


def words_sql(x: str) -> str:
    return WORDS_SQL.format(x)


def nested_replace(x: str, mapping: dict[str, str]) -> str:
    for a, b in mapping.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def first_label(kinds: dict[str, str], x: str, rest: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, '{p}') then '{k}'" for k, p in kinds.items()) + f" {rest} end"


# lines of documents: (doc_id, pos, line)
LINES_SQL = "lines as (select doc_id, unnest(range(len(a))) as pos, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents where text is not null))"


def lines(t):
    return t.documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("txt_normalize", "select doc_id, sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as norm from documents")
def txt_normalize(t):
    return t.documents.select("doc_id", F.sha1(T.normalize(F.col("text"))).alias("norm"))


@query("txt_slugify", "select p_partkey, coalesce(nullif(substring(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80), ''), 'unknown') as slug from part")
def txt_slugify(t):
    return t.part.select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


@query("txt_stable_hash", """select o_orderkey, substring(sha1('{"cust":' || o_custkey || ',"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}'), 1, 12) as h from orders""")
def txt_stable_hash(t):
    return t.orders.select("o_orderkey", T.stable_hash({"order": F.col("o_orderkey"), "cust": F.col("o_custkey"), "status": F.col("o_orderstatus")}).alias("h"))


@query("txt_filename_norm", "select page_id, lower(trim(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '_')) as stem from pages")
def txt_filename_norm(t):
    return t.pages.select("page_id", T.filename_norm(F.col("url")).alias("stem"))


RAW_RELATIONS = ["causes", "Linked to", "decreases", "worsens", " Treats ", "novel relation", "presents_with", "side effect"]
RAW_RELATION_SQL = "[" + ", ".join(f"'{r}'" for r in RAW_RELATIONS) + f"][cast(event_id % {len(RAW_RELATIONS)} as int) + 1]"


@query("txt_norm_relation", f"with r as (select event_id, replace(lower(trim({RAW_RELATION_SQL})), ' ', '_') as k from events) select event_id, {sql_case(V.RELATION_OF, 'k', 'k')} as relation from r")
def txt_norm_relation(t):
    raw = F.element_at(F.array(*map(F.lit, RAW_RELATIONS)), (F.col("event_id") % len(RAW_RELATIONS)).cast("int") + 1)
    return t.events.select("event_id", T.norm_relation(raw).alias("relation"))


SHORT_RAW = ["Inhibit", "treated", "associated with", "regulates"]


@query("txt_norm_relation_b", "with r as (select event_id, lower([" + ", ".join(f"'{r}'" for r in SHORT_RAW) + f"][cast(event_id % 4 as int) + 1]) as k from events) select event_id, {sql_case(V.SHORT_RELATIONS, 'k', 'k')} as relation from r")
def txt_norm_relation_b(t):
    raw = F.element_at(F.array(*map(F.lit, SHORT_RAW)), (F.col("event_id") % 4).cast("int") + 1)
    return t.events.select("event_id", T.norm_relation_short(raw).alias("relation"))


PRIORITY_TYPES = {"1-URGENT": "ADVERSE_EFFECT", "2-HIGH": "INTERVENTION_OUTCOME", "3-MEDIUM": "SYMPTOM_EXHIBITION", "4-NOT SPECIFIED": "COMPARATIVE", "5-LOW": "RISK_FACTOR"}


@query("txt_canon_claim_type", f"select o_orderkey, case when coalesce(trim(o_orderpriority), '') = '' then 'OTHER' else {sql_case(PRIORITY_TYPES, 'o_orderpriority', 'o_orderpriority')} end as claim_type from orders")
def txt_canon_claim_type(t):
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", F.when(F.coalesce(F.trim(p), F.lit("")) == "", "OTHER").otherwise(T.lookup(PRIORITY_TYPES, p)).alias("claim_type"))


OCR_SQL = nested_replace(
    "regexp_replace(replace(replace(regexp_replace(regexp_replace(x, '\\n\\s*\\n', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '([a-z])1([a-z])', '\\1l\\2', 'g')", V.UNICODE_NAMES
)
NOISY = "concat(text, ' a1b  ﬁx', chr(10), '  ', chr(10), '5 °C ± α → β')"


@query("txt_ocr_fix", f"with d as (select doc_id, {NOISY} as x from documents) select doc_id, sha1(regexp_replace(regexp_replace(regexp_replace({OCR_SQL}, '[ \\t\\r\\f]+', ' ', 'g'), '\\n\\s*\\n', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as h from d")
def txt_ocr_fix(t):
    return t.documents.select("doc_id", F.sha1(T.ocr_fix(F.expr(NOISY))).alias("h"))


@query("txt_pdf_post", "with d as (select doc_id, concat(text, chr(10), chr(10), chr(10), 'exam-', chr(10), 'ple  x') as x from documents) select doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(x, '\\n\\s*\\n+', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '-\\n([a-z])', '\\1', 'g')) as h from d")
def txt_pdf_post(t):
    x = F.expr("concat(text, chr(10), chr(10), chr(10), 'exam-', chr(10), 'ple  x')")
    return t.documents.select("doc_id", F.sha1(T.pdf_post(x)).alias("h"))


@query("txt_mini_norm", "with d as (select doc_id, concat(text, chr(13), chr(10), chr(10), 'exam- ', chr(10), ' ple  x') as x from documents) select doc_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(replace(x, chr(13), chr(10)), '([A-Za-z0-9_])-[ \\t]*\\n[ \\t]*([A-Za-z0-9_])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) as h from d")
def txt_mini_norm(t):
    x = F.expr("concat(text, chr(13), chr(10), chr(10), 'exam- ', chr(10), ' ple  x')")
    return t.documents.select("doc_id", F.sha1(T.mini_norm(x)).alias("h"))


@query("txt_clean", "select doc_id, sha1(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0e-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g'))) as h from documents")
def txt_clean(t):
    return t.documents.select("doc_id", F.sha1(T.clean(F.col("text"))).alias("h"))


@query("txt_greek", f"select doc_id, sha1({nested_replace(nested_replace('concat(text, chr(10), $$α-β ≥ 5 °C ± λ ↑$$)'.replace('$$', chr(39)), V.GREEK), V.UNITS)}) as h from documents")
def txt_greek(t):
    return t.documents.select("doc_id", F.sha1(T.biomedical(F.expr("concat(text, chr(10), 'α-β ≥ 5 °C ± λ ↑')"))).alias("h"))


@query("txt_citations", "with d as (select doc_id, concat(text, ' (Smith, 2020) [1, 2] (Doe et al.) end', chr(10), 'References', chr(10), 'x') as x from documents) select doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?is)\\n\\s*(references|bibliography)\\s*\\n.*$', '', 'g'), '\\([^)]*[0-9]{4}[^)]*\\)', '', 'g'), '\\[[0-9]+(,\\s*[0-9]+)*\\]', '', 'g'), '\\([^)]*et al\\.?[^)]*\\)', '', 'g')) as h from d")
def txt_citations(t):
    x = F.expr("concat(text, ' (Smith, 2020) [1, 2] (Doe et al.) end', chr(10), 'References', chr(10), 'x')")
    return t.documents.select("doc_id", F.sha1(T.strip_citations(x)).alias("h"))


@query("txt_keywords", "with d as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9-]+')) as w from documents) select doc_id, string_agg(distinct w, '|' order by w) as keywords from d where length(w) >= 3 and regexp_matches(w, '^([a-z]+-?[0-9]+[a-z]*|[a-z]+(ase|in|ism|osis|itis|oma)|(anti|pro|pre|post|sub|super|hyper|hypo)-[a-z]+)$') group by doc_id")
def txt_keywords(t):
    return t.documents.select("doc_id", F.array_join(T.keywords(F.col("text")), "|").alias("keywords")).where("keywords <> ''")


@query("txt_sentences_split", "with s as (select doc_id, unnest(regexp_split_to_array(regexp_replace(text, '\\s+', ' ', 'g'), '[.!?]+ ')) as s from documents) select doc_id, count(*) as n, sum(length(trim(s)))::bigint as chars from s where length(trim(s)) > 10 group by doc_id")
def txt_sentences_split(t):
    s = t.documents.select("doc_id", F.explode(F.split(F.regexp_replace("text", r"\s+", " "), "[.!?]+ ")).alias("s")).where("length(trim(s)) > 10")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length(F.trim("s"))).alias("chars"))


META = "concat('By Ann Lee, Bob Ray', chr(10), text, chr(10), 'doi 10.1234/abc.5 PMID: 12345678')"


@query("txt_meta_fallback", f"with d as (select doc_id, {META} as x from documents) select doc_id, list_filter(list_transform(string_split(x, chr(10)), lambda v: trim(v)), lambda v: length(v) > 10 and length(v) < 200)[1] as title, regexp_extract(x, '10\\.[0-9]{{4,}}(\\.[0-9]+)?/[^\\s]+') as doi, regexp_extract(x, '(?i)PMID:?\\s*([0-9]{{8,}})', 1) as pmid, trim(regexp_extract(substring(x, 1, 1000), 'By\\s+([A-Za-z ,.-]+)', 1)) as authors from d")
def txt_meta_fallback(t):
    d = t.documents.select("doc_id", F.expr(META).alias("x"))
    return d.select(
        "doc_id", T.title(F.col("x")).alias("title"), F.regexp_extract("x", r"10\.[0-9]{4,}(\.[0-9]+)?/[^\s]+", 0).alias("doi"),
        F.regexp_extract("x", r"(?i)PMID:?\s*([0-9]{8,})", 1).alias("pmid"), F.trim(F.regexp_extract(F.substring("x", 1, 1000), r"By\s+([A-Za-z ,.-]+)", 1)).alias("authors"),
    )


@query("txt_strip_refs", "with d as (select doc_id, case when doc_id % 2 = 0 then concat(text, ' References: a bibliography') else text end as x from documents), c as (select doc_id, x, least(nullif(instr(lower(x), 'references'), 0), nullif(instr(lower(x), 'bibliography'), 0), nullif(instr(lower(x), 'works cited'), 0), nullif(instr(lower(x), 'literature cited'), 0)) as k from d) select doc_id, length(case when k is null then x else trim(substring(x, 1, k - 1)) end) as n from c")
def txt_strip_refs(t):
    x = F.expr("case when doc_id % 2 = 0 then concat(text, ' References: a bibliography') else text end")
    return t.documents.select("doc_id", F.length(T.strip_refs(x)).cast("bigint").alias("n"))


@query("txt_sentences", "with s as (select doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) as s from documents) select doc_id, s as sentence from s where length(s) between 20 and 700 and not regexp_matches(lower(s), 'keywords:|doi|et al|author information|funding:|conflict of interest|journal of') and length(s) - length(replace(s, ';', '')) < 4")
def txt_sentences(t):
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    marked = F.regexp_replace(flat, "([.!?]) ([A-Z0-9])", "$1\x01$2")
    s = t.documents.select("doc_id", F.explode(F.split(marked, "\x01")).alias("sentence"))
    noise = F.lower("sentence").rlike("keywords:|doi|et al|author information|funding:|conflict of interest|journal of")
    return s.where(F.length("sentence").between(20, 700) & ~noise & (F.regexp_count("sentence", F.lit(";")) < 4))


SCORE_SQL = " + ".join(f"(case when contains(l, '{w}') then 10 else 0 end)" for w in V.HIGH_VALUE_TERMS)


@query("txt_key_sentence_score", f"""with s as (select doc_id, unnest(range(len(a))) as pos, unnest(a) as s from (select doc_id, string_split(text, '. ') as a from documents)), p as (
  select doc_id, pos, s, lower(s) as l, {words_sql('s')} as n from s), q as (
  select doc_id, pos, n, {SCORE_SQL} + case when regexp_matches(s, '[0-9]+\\.?[0-9]*\\s*(%|mg|μg|ng|mM|μM|nM|p\\s*[<>=])') then 30 else 0 end
    + 5 * len(list_filter(regexp_split_to_array(s, '[^A-Za-z0-9-]+'), lambda w: regexp_matches(w, '^[A-Z][A-Za-z0-9-]+$'))) as k from p)
select doc_id, cast(pos as integer) as pos, cast(least(1000, k * case when n < 5 then 5 when n > 50 then 8 else 10 end) as integer) as score from q""")  # fmt: skip
def txt_key_sentence_score(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "s")).select("doc_id", "pos", T.sentence_score(F.col("s")).cast("int").alias("score"))


@query("txt_key_sentences")
def txt_key_sentences(t):
    return t.documents.select("doc_id", T.key_sentences(F.col("text")).alias("summary"))


@query("txt_truncate_100w", f"""with s as (select doc_id, text, unnest(range(len(a))) as pos, unnest(a) as s from (select doc_id, text, string_split(text, '. ') as a from documents)), c as (
  select *, sum({words_sql('s')}) over (partition by doc_id order by pos) as run from s), k as (
  select doc_id, string_agg(s || '. ', '' order by pos) filter (where run <= 100) as kept from c group by doc_id)
select d.doc_id, sha1(case when {words_sql('text')} > 120 and kept is not null then trim(kept) else text end) as h from documents d left join k on d.doc_id = k.doc_id""")  # fmt: skip
def txt_truncate_100w(t):
    return t.documents.select("doc_id", F.sha1(T.truncate_words(F.col("text"))).alias("h"))


@query("txt_mentions", """with w as (select p_partkey, p_name, list_filter(regexp_split_to_array(trim(p_name), '[^A-Za-z0-9''-]+'), lambda w: length(w) > 2) as k from part), g as (
  select p_partkey, 1 as n, i, lower(k[i]) as m from (select p_partkey, k, unnest(range(1, len(k) + 1)) as i from w)
  union all select p_partkey, 2, i, lower(k[i] || ' ' || k[i + 1]) from (select p_partkey, k, unnest(range(1, len(k))) as i from w)
  union all select p_partkey, 9, 1, lower(trim(p_name)) from w)
select p_partkey, string_agg(distinct m, '|' order by m) as mentions from g group by p_partkey""")  # fmt: skip
def txt_mentions(t):
    return t.part.select("p_partkey", F.array_join(F.array_sort(T.mentions(F.col("p_name"))), "|").alias("mentions"))


@query("txt_split_embed", f"""with w as (select doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as k from documents), p as (
  select doc_id, unnest(range(0, greatest(1, len(k)), 100)) as i, k, text from w)
select doc_id, cast(i // 100 as integer) as piece, sha1(case when len(k) > 0 then array_to_string(k[i + 1:i + 100], ' ') else text end) as h from p""")  # fmt: skip
def txt_split_embed(t):
    return t.documents.select("doc_id", F.posexplode(T.windows(F.col("text"), 100)).alias("piece", "x")).select("doc_id", "piece", F.sha1("x").alias("h"))


@query("txt_embed_templates", "select p_partkey, 'Entity: ' || p_name || ' | Type: ' || p_type || ' | Aliases: ' || array_to_string(list_sort(string_split(p_name, ' ')), ', ') as entity_text, p_brand || ' has_type ' || p_type || ' (' || p_size || ')' as triple_text from part")
def txt_embed_templates(t):
    aliases = F.array_join(F.array_sort(F.split("p_name", " ")), ", ")
    return t.part.select("p_partkey", F.concat(F.lit("Entity: "), "p_name", F.lit(" | Type: "), "p_type", F.lit(" | Aliases: "), aliases).alias("entity_text"), F.concat("p_brand", F.lit(" has_type "), "p_type", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")")).alias("triple_text"))


@query("txt_clip", "select l_orderkey, l_linenumber, cast(round(greatest(0, least(1, coalesce(l_discount * 20 - 0.2e0, 0))) * 1e6) as bigint) as v from lineitem")
def txt_clip(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(T.clip01(F.col("l_discount") * 20 - F.lit(0.2)) * 1e6).cast("bigint").alias("v"))


@query("txt_float_extract", "select event_id, cast(round(greatest(0, least(1, coalesce(try_cast(regexp_extract('0.' || regexp_extract(props, '[0-9]+'), '([0-9]+\\.?[0-9]*)', 1) as double), 0.5e0))) * 1e6) as bigint) as v from events")
def txt_float_extract(t):
    x = F.concat(F.lit("0."), F.regexp_extract("props", "[0-9]+", 0))
    return t.events.select("event_id", F.round(T.first_number(x) * 1e6).cast("bigint").alias("v"))


@query("txt_json_extract", "select event_id, json_extract_string(props, '$.k') as k from events")
def txt_json_extract(t):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("so "), "props", F.lit(" end")))
    return t.events.select("event_id", F.get_json_object(T.json_payload(wrapped), "$.k").alias("k"))


@query("txt_entity_type_rule", "with p as (select p_partkey, case p_partkey % 5 when 0 then p_name || ' kinase' when 1 then 'BDNF' || p_partkey when 2 then p_name || ' statin' when 3 then p_name || ' disorder' else p_name end as x from part) select p_partkey, case when regexp_matches(lower(x), 'mycin|cillin|statin|inhibitor') then 'Drug' when x = upper(x) and x <> lower(x) and length(x) <= 10 then 'Gene' when regexp_matches(lower(x), 'ase|receptor|protein') then 'Protein' when regexp_matches(lower(x), 'cancer|disease|syndrome|disorder') then 'Disease' else 'Chemical' end as entity_type from p")
def txt_entity_type_rule(t):
    x = F.expr("case p_partkey % 5 when 0 then p_name || ' kinase' when 1 then 'BDNF' || p_partkey when 2 then p_name || ' statin' when 3 then p_name || ' disorder' else p_name end")
    return t.part.select("p_partkey", T.entity_type(x).alias("entity_type"))


HEADED = "case (doc_id + pos) % 9 when 0 then 'Results of the ' || line when 1 then 'Methods ' || line when 2 then 'Figure 1 ' || line when 3 then '1. Abstract: ' || line when 4 then 'Funding: ' || line else line end"
LABEL_REST = "when " + words_sql("x") + " < 10 then 'header' when regexp_matches(x, '[0-9]+\\.\\s+[A-Za-z0-9_]+.*\\([0-9]{4}\\)') then 'references' when regexp_matches(x, '^(Figure|Table|Fig\\.)') then 'figure_caption' else 'content'"
LABEL_SQL = first_label(V.SECTION_LABELS, "lower(x)", LABEL_REST)


@query("txt_section_label", f"with {LINES_SQL}, h as (select doc_id, pos, {HEADED} as x from lines) select doc_id, cast(pos as integer) as pos, {LABEL_SQL} as label from h")
def txt_section_label(t):
    return lines(t).select("doc_id", "pos", T.section_label(F.expr(HEADED)).alias("label"))


HEADING_SQL = "trim(lower(regexp_replace(trim(regexp_replace(coalesce({0}, ''), '^\\s*[0-9]+(\\.[0-9]+)*[.)]?\\s+', '')), '\\s+', ' ', 'g')), ' :.-')"


@query("txt_heading_norm", f"with {LINES_SQL}, h as (select doc_id, pos, {HEADING_SQL.format('(' + HEADED + ')')} as heading from lines) select doc_id, cast(pos as integer) as pos, heading, {first_label(V.HEADING_TYPES, 'heading', chr(101) + 'lse ' + chr(39) + 'other' + chr(39))} as kind from h where length(heading) < 60")
def txt_heading_norm(t):
    h = lines(t).select("doc_id", "pos", T.heading_norm(F.expr(HEADED)).alias("heading")).where("length(heading) < 60")
    return h.withColumn("kind", T.heading_type(F.col("heading")))


@query("txt_slim", "select doc_id, substring(text, 1, 600) as body, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as claim from documents")
def txt_slim(t):
    return t.documents.select("doc_id", F.substring("text", 1, 600).alias("body"), F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("claim"))


CASES = ["My son, a 9-year-old with severe autism, is nonverbal. He has daily severe aggression when demands are placed. How about visual schedules for home?", "A 15 year old with ADHD, weekly mild tantrums at school; mother reports anxiety. Should we try risperidone?", "Adult with intellectual disability and occasional moderate elopement, lives in a group home.", ""]
CASE_SQL = "[" + ", ".join("'" + c + "'" for c in CASES) + "][cast((conv_id + turn) % 4 as int) + 1] || ' ' || text"
FEATURES = {
    "autism": "(^|[^a-z])(autism|autistic|asd)([^a-z]|$)", "id": "(^|[^a-z])intellectual disabilit", "adhd": "(^|[^a-z])(adhd|attention[- ]deficit)([^a-z]|$)",
    "nonverbal": "(^|[^a-z])(nonverbal|non[- ]verbal)([^a-z]|$)", "home": "(^|[^a-z])home([^a-z]|$)", "group_home": "(^|[^a-z])group home([^a-z]|$)",
    "mother": "(^|[^a-z])mother([^a-z]|$)", "anxiety": "(^|[^a-z])anxi(ous|ety)([^a-z]|$)", "risperidone": "(^|[^a-z])risperidone([^a-z]|$)",
    "aggression": "(^|[^a-z])aggressi(on|ve)([^a-z]|$)", "tantrum": "(^|[^a-z])(tantrum|meltdown)s?([^a-z]|$)", "elopement": "(^|[^a-z])(elopement|wandering|running away)([^a-z]|$)",
}
LEVELS = {
    "frequency": {"daily": "daily|every day|each day", "weekly": "weekly|every week", "monthly": "monthly|every month", "occasional": "occasional|occasionally|rarely|sometimes"},
    "intensity": {"severe": "severe|severely|extreme|major", "moderate": "moderate|moderately|significant", "mild": "mild|mildly|minor"},
}


def _levels_sql(kind: str) -> str:
    return "case " + " ".join(f"when regexp_matches(x, '(^|[^a-z])({p})([^a-z]|$)') then '{k}'" for k, p in LEVELS[kind].items()) + " else '' end"


@query("txt_case_regex", f"with c as (select conv_id, turn, lower({CASE_SQL}) as x from conversations), a as (select *, try_cast(regexp_extract(x, '(^|[^0-9a-z])([0-9]{{1,2}})[- ]?year[- ]?old', 2) as integer) as age from c) select conv_id, turn, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(x, '{p}') then '{k}' end" for k, p in FEATURES.items()) + f"], lambda v: v is not null), '|') as features, case when age is null then '' when age < 6 then 'early childhood' when age < 13 then 'school age' when age < 18 then 'adolescent' else 'adult' end as stage, {_levels_sql('frequency')} as frequency, {_levels_sql('intensity')} as intensity, trim(regexp_extract(x, '(how about|can we use|what about|should we try|should we use|use of) ([^?.!,]+?)([?.!,]| for | to |$)', 2)) as strategy from a")
def txt_case_regex(t):
    raw = F.concat(F.element_at(F.array(*map(F.lit, CASES)), ((F.col("conv_id") + F.col("turn")) % 4).cast("int") + 1), F.lit(" "), F.col("text"))
    c = t.conversations.select("conv_id", "turn", F.lower(raw).alias("x"))
    age = F.regexp_extract("x", "(^|[^0-9a-z])([0-9]{1,2})[- ]?year[- ]?old", 2).try_cast("int")
    stage = F.when(age.isNull(), "").when(age < 6, "early childhood").when(age < 13, "school age").when(age < 18, "adolescent").otherwise("adult")

    def level(kind):
        out = None
        for k, p in LEVELS[kind].items():
            hit = F.col("x").rlike(f"(^|[^a-z])({p})([^a-z]|$)")
            out = F.when(hit, k) if out is None else out.when(hit, k)
        return out.otherwise("")

    found = F.array_compact(F.array(*(F.when(F.col("x").rlike(p), k) for k, p in FEATURES.items())))
    strategy = F.trim(F.regexp_extract("x", "(how about|can we use|what about|should we try|should we use|use of) ([^?.!,]+?)([?.!,]| for | to |$)", 2))
    return c.select("conv_id", "turn", F.array_join(found, "|").alias("features"), stage.alias("stage"), level("frequency").alias("frequency"), level("intensity").alias("intensity"), strategy.alias("strategy"))
