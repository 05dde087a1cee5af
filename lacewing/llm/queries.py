"""The queries of this folder: each reads its whole table and applies one operator.

``QUERIES`` maps names to callables, ``ORACLES`` holds DuckDB SQL where SQL can
express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(read(spark, sf_dir, "documents"), path_col="source")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(read(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import overlaps

    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import findings

    return findings(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(read(spark, sf_dir, "documents"))


def op6_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, grade, score

    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels").select("doc_id", grade().alias("grade")).where("quality is not null and toxic is not null"))
    return score(docs, model, ["doc_id"])


def op7_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), n=2)


def op8_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import documents, write
    from .shared import Workspace

    work = Workspace(spark, "ids")
    write(read(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE), work.path("dataset"), work)
    return documents(spark, work.path("dataset"), digest=True)


def op9_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


TOP_K_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
  where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

NEAR_DUPLICATES_SQL = """
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from words
), items as (
  select doc_id, len(s) as n, unnest(s) as x from sets
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb
  from items a join items b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by 1, 2
), links as (
  select a, b from common where 100 * k >= 80 * (na + nb - k)
), both_ways as (
  select a, b from links union all select b, a from links
), reach(id, root) as (
  select doc_id, doc_id from documents
  union
  select r.id, e.b from reach r join both_ways e on r.root = e.a
), lowest as (
  select id, min(root) as root from reach group by id
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, l.root as component_id, s.doc_id = l.root as kept
from sets s join lowest l on s.doc_id = l.id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_forest_secret_scan": op1_forest_secret_scan,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_disclosure_pii": op4_disclosure_pii,
    "op5_language_id": op5_language_id,
    "op6_threshold_top_k": op6_threshold_top_k,
    "op7_bottom_k_near_duplicates": op7_bottom_k_near_duplicates,
    "op8_range_coded_ids": op8_range_coded_ids,
    "op9_hidden_markov_lm": op9_hidden_markov_lm,
    "op10_ordinal_quality": op10_ordinal_quality,
}
ORACLES: dict[str, str] = {
    "op6_threshold_top_k": TOP_K_SQL,
    "op7_bottom_k_near_duplicates": NEAR_DUPLICATES_SQL,
}
