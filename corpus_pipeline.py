"""From raw documents to token ids: five stages, each over all that the one before kept.

1. ``quality``: the ordinal classifier rejects poor and toxic documents.
2. ``near_duplicates``: of each group of near-duplicates (five-word shingles, similarity
   0.8 or more) the document of the smallest id stays.
3. ``decontamination``: documents that overlap with the benchmark go.
4. ``pii``: personal data and terms that disclose them are replaced in the texts.
5. ``tokens``: byte-level BPE ids of each text and a check that they decode to it.

All stages but the last return the columns of documents.  A document is its id: rows
of one id stay or go together in stage 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.llm import bpe, decontam, neardup, pii
from lacewing.llm import quality as grades
from lacewing.llm.queries import BYTE_BPE, tokenizer_file
from lacewing.llm.shared import Workspace, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ratings = read(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select("doc_id", grades.grade().alias("grade"))
    return grades.score(docs, grades.fit(docs, ratings), docs.columns, only_kept=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, lossless, ids of each text; lossless: the ids decode to it."""
    return bpe.encode_and_decode(docs, tokenizer_file(BYTE_BPE))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("tokens", tokens),
]

#: Fitted models and tokenization have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
