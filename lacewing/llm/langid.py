"""Language identification in two steps: the family, then the language within it.

Features are counts of hashed character trigrams of the whole text (A-Z lowered,
other ASCII signs as one blank), square-rooted and scaled to length 1.  A linear
support vector machine for every two families votes for the family, then one for
every two languages of that family votes for the language.  All machines are
fitted by gradient descent on the squared hinge loss.

Fitting takes at most ``per_language`` labelled rows of each language, chosen by a
hash of the id; that is the only sample, every row is predicted.  Texts are taken in
chunks of at most ROWS rows, so a chunk's features have a fixed size at most.

Null text, or text without a letter: ``und`` with score 0.  Without any labelled
row every row is ``und``.  Repeated rows and ids each get their own result; only
the named columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import chunks, strings
from .shared import ship

# Family of each language code; a code not listed is a family of its own.
FAMILIES = {
    "Germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "Romance": "ca es fr gl it la oc pt ro",
    "Slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "Uralic": "et fi hu",
    "Turkic": "az kk tr uz",
    "Semitic": "ar he mt",
    "Indo-Aryan": "bn gu hi mr ne pa ur",
}
BITS = 12
ROWS = 1024
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def family_of(lang: str) -> str:
    code = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), f"other:{lang}")


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of scaled trigram counts for each text of a chunk."""
    c = _CLASS[data].astype(np.uint32)
    rows, size = len(off) - 1, 1 << BITS
    n = len(c) - 2
    counts = np.zeros(rows * size)
    if n > 0:
        code = ((c[:-2] << 16) | (c[1:-1] << 8) | c[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        row = np.repeat(np.arange(rows), np.diff(off))[:n]
        inside = np.arange(n) + 2 < off[row + 1]
        inside &= ~((c[:-2] == 32) & (c[1:-1] == 32))
        counts = np.bincount((row * size + code)[inside], minlength=rows * size)
    x = np.sqrt(counts.reshape(rows, size).astype(np.float32))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the offset) that separate y = +1 from y = -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    speed = np.zeros_like(w)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ w)) * weight
        speed = 0.9 * speed + x.T @ (slack * y) * 2 - decay * w
        w = w + 0.5 * speed
    return w


class Hierarchy:
    """All machines, as columns of one matrix."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(v) for v in self.langs})
        own = np.array(langs)
        group = np.array([family_of(v) for v in langs])
        self.pairs: list[tuple[str, str]] = []
        columns = []
        for names, of in ((self.families, group), *(([v for v in self.langs if family_of(v) == f], own) for f in self.families)):
            for a, b in combinations(names, 2):
                pick = (of == a) | (of == b)
                columns.append(machine(x[pick], np.where(of[pick] == a, 1, -1).astype(np.float32)))
                self.pairs.append((a, b))
        self.w = np.stack(columns, 1) if columns else np.zeros((x.shape[1] + 1, 0), np.float32)

    def vote(self, margin: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The name with most votes (then the largest sum of margins, then the first), and how sure that is."""
        votes = np.zeros((len(margin), len(names)))
        sure = np.ones((len(margin), len(names)))
        for k, (a, b) in enumerate(self.pairs):
            if a in names and b in names:
                i, j = names.index(a), names.index(b)
                p = 1 / (1 + np.exp(-4 * margin[:, k]))
                votes[:, i] += (p >= 0.5) + 1e-3 * p
                votes[:, j] += (p < 0.5) + 1e-3 * (1 - p)
                sure[:, i] = np.minimum(sure[:, i], p)
                sure[:, j] = np.minimum(sure[:, j], 1 - p)
        best = votes.argmax(1)
        return best, sure[np.arange(len(best)), best]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin = x @ self.w[:-1] + self.w[-1]
        family, p = self.vote(margin, self.families)
        lang, score = np.empty(len(x), object), p.copy()
        for k, f in enumerate(self.families):
            at = np.flatnonzero(family == k)
            names = [v for v in self.langs if family_of(v) == f]
            best, q = self.vote(margin[at], names)
            lang[at] = np.array(names, object)[best]
            score[at] *= q
        return lang.tolist(), np.clip(score, 0, 1)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def fit(rows: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> Hierarchy | None:
    """Machines from labelled rows; per language at most about ``per_language`` of them."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    space = 1 << 30
    limit = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(space, int(space * per_language / n) + 1))))
    taken = rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(space)) < limit[F.col(lang_col)])

    def run(batches):
        for b in batches:
            data, off = strings(b.column(0))
            for first, end, piece, own in chunks(data, off, 1 << 20, ROWS):
                packed = [x.tobytes() for x in np.round(features(piece, own) * 65535).astype("<u2")]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), b.column(1).slice(first, end - first)], ["x", "lang"])

    got = taken.select(text_col, F.col(lang_col).alias("lang")).mapInArrow(run, "x binary, lang string").collect()
    got = sorted((r.lang, bytes(r.x)) for r in got)
    x = np.stack([np.frombuffer(v, "<u2") for _, v in got]).astype(np.float32) / 65535 if got else np.zeros((0, 1 << BITS), np.float32)
    return Hierarchy(x, [v for v, _ in got]) if got else None


def predict(docs: DataFrame, model: Hierarchy | None, keep: list, text_col: str = "text") -> DataFrame:
    """``keep`` columns of each row, then lang_pred and score."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    base = docs.select(*keep)
    names = [*base.columns, "lang_pred", "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", lang_pred string, score double"
    width = len(base.columns)

    def run(batches):
        m = held.value
        for b in batches:
            data, off = strings(b.column(width))
            langs, scores = [], []
            for _, _, piece, own in chunks(data, off, 1 << 20, ROWS):
                rows = len(own) - 1
                lang, score = m.predict(features(piece, own)) if m else (["und"] * rows, np.zeros(rows))
                plain = (_CLASS[piece] != 32) & (piece < 128)
                seen = np.concatenate([[0], np.cumsum(plain)])
                for k in np.flatnonzero(seen[own[1:]] == seen[own[:-1]]):
                    if not m or not has_letter(piece[own[k] : own[k + 1]].tobytes()):
                        lang[k], score[k] = "und", 0.0
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], names)

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500) -> DataFrame:
    """Per row: id, held_out, lang_pred, score; learned from rows that are not held out.

    A row is held out if crc32 of its id as text leaves remainder 0 by 5.  A null
    id is taken as the empty text.
    """
    ship(docs.sparkSession)
    out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0
    model = fit(docs.where(~out), id_col, text_col, lang_col, per_language)
    return predict(docs, model, [F.col(id_col), out.alias("held_out")], text_col)
