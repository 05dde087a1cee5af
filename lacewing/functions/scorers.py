"""Remote models as pluggable scorers with deterministic defaults.

A scorer maps a batch of texts to texts (JSON or a label).  Rows whose key is in
the cache are not sent; failed calls are retried, then answered by the fallback.
Results carry how they came about, so usage and review tables follow from them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[list[str]], list[str]]
# Keys a payload must have.
PAYLOAD_KEYS = [
    "evidence_hyperedges", "canonical_hyperedge", "selected_canonical_entities", "primary_triples", "supporting_triples", "entity_roles",
    "qualifiers", "polarity", "negation", "speculative", "confidence", "warnings",
]


def render(template: str, **values) -> str:
    """{{name}} and {name}; values that are no text as JSON; unknown names stay."""

    def one(m):
        v = values.get(m[1] or m[2])
        return m[0] if (m[1] or m[2]) not in values else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    return re.sub(r"\{\{(\w+)\}\}|\{(\w+)\}", one, template)


def valid_payload(text: str) -> bool:
    try:
        x = json.loads(text)
    except ValueError:
        return False
    return isinstance(x, dict) and all(k in x for k in PAYLOAD_KEYS)


def score(df: DataFrame, key: str, prompt: str, scorer: Scorer | None, fallback: Scorer, cache: DataFrame | None = None, retries: int = 2, check: Callable[[str], bool] = bool, batch: int = 40) -> DataFrame:
    """``df`` keys with answer, status (cached, ok, retry_succeeded, fallback) and attempts."""
    todo = df.select(key, prompt)
    done = None
    if cache is not None:
        done = todo.join(cache.select(key, "answer"), key).select(key, "answer", F.lit("cached").alias("status"), F.lit(0).alias("attempts"))
        todo = todo.join(cache, key, "left_anti")

    def ask(texts: list[str]) -> list[tuple[str, str, int]]:
        out: list[tuple[str, str, int] | None] = [None] * len(texts)
        for attempt in range(1, retries + 2) if scorer else ():
            open_ = [k for k, v in enumerate(out) if v is None]
            if not open_:
                break
            try:
                got = scorer([texts[k] for k in open_])
            except Exception:  # noqa: BLE001  a remote failure counts as no answer
                continue
            for k, a in zip(open_, got, strict=True):
                if check(a):
                    out[k] = (a, "ok" if attempt == 1 else "retry_succeeded", attempt)
        left = [k for k, v in enumerate(out) if v is None]
        for k, a in zip(left, fallback([texts[k] for k in left]) if left else [], strict=True):
            out[k] = (a, "fallback", retries + 1 if scorer else 0)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                rows = ask(part[prompt].fillna("").tolist())
                yield pd.DataFrame({key: part[key].to_numpy(), "answer": [r[0] for r in rows], "status": [r[1] for r in rows], "attempts": [r[2] for r in rows]})

    kind = df.schema[key].dataType.simpleString()
    fresh = todo.mapInPandas(run, f"{key} {kind}, answer string, status string, attempts int")
    return fresh if done is None else fresh.unionByName(done)


def usage(scored: DataFrame) -> DataFrame:
    """Calls and their outcomes; cached rows and defaults made no call."""
    return scored.groupBy("status").agg(F.count("*").alias("rows"), F.sum("attempts").alias("calls"))


def score_many(df: DataFrame, key: str, prompt: str, scorer: Scorer | None, fallback: Scorer, fields: str, **options) -> DataFrame:
    """One row for each item that a scorer names for a row: key, status, pos and the fields of the item.

    Answers are JSON lists of objects; ``fields`` is their schema.  An answer that is no list
    counts as none and is asked for again.  A row without items gives no rows.
    """

    def is_list(text: str) -> bool:
        try:
            return isinstance(json.loads(text), list)
        except ValueError:
            return False

    scored = score(df, key, prompt, scorer, fallback, check=is_list, **options)
    items = scored.select(key, "status", F.posexplode(F.from_json("answer", f"array<struct<{fields}>>")).alias("pos", "item"))
    return items.select(key, "status", "pos", "item.*")


def embedded(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(key, embedding) by a model: ``encode`` maps a batch of texts to vectors; null texts are empty ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": [list(map(float, v)) for v in encode(part[text].fillna("").tolist())]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def within(lead: F.Column, blocks: list[F.Column], cap: int, empty: str = "[]") -> F.Column:
    """A prompt of a lead and blocks; beyond ``cap`` characters blocks are emptied from the first on, then it is cut."""
    text = lambda k: F.concat(lead, *(F.lit(empty) if j < k else b for j, b in enumerate(blocks)))
    out = F.substring(text(len(blocks)), 1, cap)
    for k in range(len(blocks), -1, -1):
        out = F.when(F.length(text(k)) <= cap, text(k)).otherwise(out)
    return out


def first_given(*names: str) -> F.Column:
    """The first of several keys that holds more than blanks, trimmed where it is not the last."""
    return F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names[:-1]), F.col(names[-1]).cast("string"))


def mapped(value: F.Column, words: dict[str, str], other: str) -> F.Column:
    """A word of a closed set, whatever its case and blanks; ``other`` for any other and for null."""
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), F.lit(other))


def listed(value: F.Column) -> F.Column:
    """A list from comma-separated text: trimmed, without empty items."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
