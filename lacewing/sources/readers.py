"""Sources: text folders, article graphs, claims, catalogues, vectors and stores.

Schemas are given, never inferred; bad records are kept apart, not fatal.
"""

from __future__ import annotations

import tomllib
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = "head string, relation string, tail string, confidence double, relevance double, clarity double, source string"
ENTITY = "entity_id string, entity_type string, name string, normalized_id string, aliases array<string>"
GRAPH = f"entities array<struct<{ENTITY.replace(' string', ':string').replace(' array', ':array')}>>, triples array<struct<{TRIPLE.replace(' string', ':string').replace(' double', ':double')}>>"
CLAIMS = (
    "selected_claim_id string, object_id string, index int, raw_llm_output string, claims array<struct<claim_id:string,claim_text:string,claim_type:string,"
    "candidate_entities:array<string>,metadata:map<string,string>,source_segment_id:string,source_summary_id:string>>"
)


def text_dir(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(name, text) of every text file."""
    d = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return d.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))


def article_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and triples of all ``*_kg.json`` but unified ones, with article ids; missing scores are 0."""
    d = spark.read.schema(GRAPH).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*_kg.json").option("recursiveFileLookup", True).json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    d = d.withColumn("article_id", F.regexp_replace(name, "_kg\\.json$", "")).where(~name.startswith("unified_"))
    scores = {f"{s}": F.coalesce(F.col(s), F.lit(0.0)) for s in ("confidence", "relevance", "clarity")}
    return d.select("article_id", F.inline("entities")), d.select("article_id", F.inline("triples")).withColumns(scores)


def claims(spark: SparkSession, path: str) -> DataFrame:
    """One claim a row of JSONL: the selected one, else the first; rows without id or text go."""
    d = spark.read.schema(CLAIMS).json(path)
    chosen = F.coalesce(F.try_element_at(F.filter("claims", lambda c: c["claim_id"] == F.col("selected_claim_id")), F.lit(1)), F.try_element_at("claims", F.lit(1)))
    return d.select("object_id", "index", chosen.alias("c")).select("object_id", "index", "c.*").where("coalesce(trim(claim_id), '') <> '' and coalesce(trim(claim_text), '') <> ''")


def catalog(spark: SparkSession, path: str, allowed: list[str] | None = None) -> DataFrame:
    """Ontology entities from JSONL or CSV; ``#`` starts a comment; synonyms split at ; and |."""
    fields = "entity_id string, name string, entity_type string, synonyms string"
    d = spark.read.schema(fields).json(path) if path.rstrip("/").endswith(("jsonl", "json")) else spark.read.schema(fields).option("header", True).option("comment", "#").csv(path)
    d = d.where("coalesce(entity_id, '') <> '' and coalesce(name, '') <> ''").withColumn("synonyms", F.filter(F.transform(F.split(F.coalesce("synonyms", F.lit("")), "[;|]"), lambda s: F.trim(s)), lambda s: s != ""))
    return d.where(F.col("entity_type").isin(allowed)) if allowed else d


def csv_rows(spark: SparkSession, path: str, fields: str, limit: int | None = None, order: str | None = None) -> DataFrame:
    d = spark.read.schema(fields).option("header", True).csv(path)
    return d.orderBy(order).limit(limit) if limit and order else d


def vector_namespace(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """Vectors of one namespace; the partition filter reads that folder alone."""
    return spark.read.parquet(path).where(F.col("namespace") == namespace)


def edge_store(spark: SparkSession, path: str) -> DataFrame:
    """Last payload of each id of an append-only JSONL log with ``seq``."""
    d = spark.read.schema("id string, seq bigint, edge string").json(path)
    return d.groupBy("id").agg(F.max_by("edge", "seq").alias("edge"))


def document(spark: SparkSession, source: str) -> DataFrame:
    """A path by its ending (.txt, .parquet, .pdf), anything else as the text itself."""
    if source.endswith(".txt"):
        return spark.read.text(source, wholetext=True).select(F.col("value").alias("text"))
    if source.endswith(".parquet"):
        return spark.read.parquet(source).select("text")
    if source.endswith(".pdf"):
        return pdf_text(spark, source)
    return spark.range(1).select(F.lit(source).alias("text"))


def pdf_text(spark: SparkSession, path: str, parse=None) -> DataFrame:
    """Text of PDF files through ``parse(bytes) -> str``; without one, an installed reader is needed."""
    if parse is None:
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise NotImplementedError("no PDF reader is installed; give parse=") from e
        import io

        def parse(raw):
            return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages)

    import pandas as pd

    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(parse)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", text("content").alias("text"))


@cache
def prompts(path: str, required: tuple[str, ...] = ()) -> dict[str, str]:
    """Templates of a TOML file, section.key; a missing or empty required one is an error."""
    out = {f"{s}.{k}" if isinstance(v, dict) else s: t for s, v in tomllib.loads(Path(path).read_text(encoding="utf-8")).items() for k, t in (v.items() if isinstance(v, dict) else [(s, v)])}
    missing = [k for k in required if not str(out.get(k, "")).strip()]
    if missing:
        raise KeyError(f"prompts missing: {missing}")
    return out
