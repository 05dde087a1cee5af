"""Text scalars as column expressions; all stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V

WORD = "[A-Za-z0-9_]"


def normalize(x: Column) -> Column:
    """Strip, collapse white space, lower."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def slugify(x: Column, size: int = 80) -> Column:
    s = F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_")
    s = F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, size)
    return F.when(s == "", "unknown").otherwise(s)


def stable_hash(fields: dict[str, Column], size: int = 12) -> Column:
    """First signs of the SHA-1 of compact JSON with sorted keys."""
    return F.substring(F.sha1(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))), 1, size)


def filename_norm(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a constant map, the key itself if absent."""
    table = F.create_map(*(F.lit(v) for kv in mapping.items() for v in kv))
    return F.coalesce(F.try_element_at(table, key), key)


def norm_relation(x: Column) -> Column:
    return lookup(V.RELATION_OF, F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("_")))


def norm_relation_short(x: Column) -> Column:
    return lookup(V.SHORT_RELATIONS, F.lower(x))


def replace_all(x: Column, mapping: dict[str, str]) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), mapping.items(), x)


def ocr_fix(x: Column) -> Column:
    """Paragraph breaks and blanks collapsed, ligatures, l for 1 inside words, named symbols."""
    x = F.regexp_replace(x, r"\n\s*\n", "\n\n")
    x = F.regexp_replace(x, "[ \t]+", " ")
    x = F.replace(F.replace(x, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    x = F.regexp_replace(x, "([a-z])1([a-z])", "$1l$2")
    x = replace_all(x, V.UNICODE_NAMES)
    x = F.regexp_replace(x, "[ \t\r\f]+", " ")
    x = F.regexp_replace(x, r"\n\s*\n", "\n\n")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def pdf_post(x: Column, join_lines: bool = False) -> Column:
    """Blank lines and blanks collapsed, hyphens at line ends removed; joining lines is off unless asked for."""
    x = F.regexp_replace(x, r"\n\s*\n+", "\n\n")
    x = F.regexp_replace(x, "[ \t]+", " ")
    x = F.regexp_replace(x, "-\n([a-z])", "$1")
    return F.regexp_replace(x, "([a-z])\n([a-z])", "$1$2") if join_lines else x


def mini_norm(x: Column) -> Column:
    x = F.replace(x, F.lit("\r"), F.lit("\n"))
    x = F.regexp_replace(x, rf"({WORD})-[ \t]*\n[ \t]*({WORD})", "$1$2")
    x = F.regexp_replace(x, "[ \t]+", " ")
    return F.trim(F.regexp_replace(x, "\n{3,}", "\n\n"))


def clean(x: Column) -> Column:
    x = F.regexp_replace(x, r"[\x00-\x08\x0e-\x1f\x7f]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def biomedical(x: Column) -> Column:
    return replace_all(replace_all(x, V.GREEK), V.UNITS)


def strip_citations(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?is)\n\s*(references|bibliography)\s*\n.*$", "")
    x = F.regexp_replace(x, r"\([^)]*[0-9]{4}[^)]*\)", "")
    x = F.regexp_replace(x, r"\[[0-9]+(,\s*[0-9]+)*\]", "")
    return F.regexp_replace(x, r"\([^)]*et al\.?[^)]*\)", "")


def keywords(x: Column) -> Column:
    """Sorted distinct words with digits, medical endings or hyphened prefixes, of 3 letters or more."""
    words = F.split(F.lower(x), "[^a-z0-9-]+")
    kind = "^([a-z]+-?[0-9]+[a-z]*|[a-z]+(ase|in|ism|osis|itis|oma)|(anti|pro|pre|post|sub|super|hyper|hypo)-[a-z]+)$"
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike(kind) & (F.length(w) >= 3))))


def title(x: Column) -> Column:
    """First line of more than 10 and fewer than 200 signs."""
    lines = F.transform(F.split(x, "\n"), lambda v: F.trim(v))
    return F.try_element_at(F.filter(lines, lambda v: (F.length(v) > 10) & (F.length(v) < 200)), F.lit(1))


def strip_refs(x: Column, markers: tuple[str, ...] = ("references", "bibliography", "works cited", "literature cited")) -> Column:
    """The text before the earliest marker."""
    at = F.least(*(F.nullif(F.instr(F.lower(x), F.lit(m)), F.lit(0)) for m in markers))
    return F.when(at.isNull(), x).otherwise(F.trim(F.substring(x, F.lit(1), at - 1)))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def sentence_score(s: Column) -> Column:
    """Hundredths: 10 for a telling term, 30 for a figure with unit, 5 for a capitalised word; short half, long four fifths; at most 100."""
    low = F.lower(s)
    score = reduce(lambda a, b: a + b, (F.when(F.contains(low, F.lit(t)), 10).otherwise(0) for t in V.HIGH_VALUE_TERMS))
    score = score + F.when(s.rlike(r"[0-9]+\.?[0-9]*\s*(%|mg|μg|ng|mM|μM|nM|p\s*[<>=])"), 30).otherwise(0)
    score = score + 5 * F.size(F.filter(F.split(s, "[^A-Za-z0-9-]+"), lambda w: w.rlike("^[A-Z][A-Za-z0-9-]+$")))
    n = word_count(s)
    tenths = score * F.when(n < 5, 5).when(n > 50, 8).otherwise(10)
    return F.least(F.lit(1000), tenths)


def greedy_words(sentences: Column, limit: int, skip: bool) -> Column:
    """Sentences taken in order within a word budget; at the first that is too long stop, or with ``skip`` go on."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        n = a["n"] + word_count(s)
        fits = (n <= limit) & ~a["full"]
        return F.struct(F.when(fits, n).otherwise(a["n"]).alias("n"), (a["full"] | (~fits if not skip else F.lit(False))).alias("full"), F.when(fits, F.concat(a["out"], F.array(s))).otherwise(a["out"]).alias("out"))

    return F.aggregate(sentences, start, step)["out"]


def truncate_words(x: Column, most: int = 120, limit: int = 100) -> Column:
    kept = greedy_words(F.split(x, r"\. "), limit, skip=False)
    cut = F.trim(F.array_join(F.transform(kept, lambda s: F.concat(s, F.lit(". "))), ""))
    return F.when((word_count(x) > most) & (F.size(kept) > 0), cut).otherwise(x)


def key_sentences(x: Column, limit: int = 100) -> Column:
    """Best sentences (over 0.3) within a word budget, else the first words."""
    scored = F.transform(F.split(x, r"\. "), lambda s, i: F.struct((-sentence_score(s)).alias("k"), i.alias("i"), s.alias("s")))
    ranked = F.filter(F.array_sort(scored), lambda r: r["k"] < -300)
    kept = greedy_words(F.transform(ranked, lambda r: r["s"]), limit, skip=True)
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, ". "), F.lit("."))).otherwise(F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit("...")))


def mentions(x: Column, stop: tuple[str, ...] = ("the", "and", "for", "with", "of", "in", "on", "to", "a", "an", "or", "by"), window: int = 4, cap: int = 24) -> Column:
    """All 1- to 4-grams of content words, shorter first, and the text; distinct by lower case, at most ``cap``."""
    tokens = F.filter(F.split(F.trim(x), "[^A-Za-z0-9'-]+"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*stop))
    grams = [F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - n + 1)), lambda i, n=n: F.array_join(F.slice(tokens, i, n), " ")))
             .otherwise(F.array().cast("array<string>")) if n > 1 else tokens for n in range(1, window + 1)]
    every = F.array_distinct(F.transform(F.concat(*grams, F.array(F.trim(x))), lambda w: F.lower(w)))
    return F.slice(F.filter(every, lambda w: w != ""), 1, cap)


def windows(x: Column, size: int) -> Column:
    """Runs of ``size`` words; a text without words is one run."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words)), F.lit(size)), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) > 0, many).otherwise(F.array(x))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def first_number(x: Column, default: float = 0.5) -> Column:
    """First number of a text, clipped to [0, 1]."""
    found = F.regexp_extract(x, r"([0-9]+\.?[0-9]*)", 1).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(found, F.lit(default))))


def json_payload(x: Column) -> Column:
    """A text that is JSON, else a fenced block, else from the first brace to the last, else from the first bracket to the last."""
    options = [x, F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.regexp_extract(x, r"(?s)(\[.*\])", 1)]
    return F.coalesce(*(F.when(F.try_parse_json(o).isNotNull() & (F.trim(o) != ""), o) for o in options))


def entity_type(x: Column) -> Column:
    low = F.lower(x)
    return (F.when(low.rlike("mycin|cillin|statin|inhibitor"), "Drug").when((x == F.upper(x)) & (x != low) & (F.length(x) <= 10), "Gene")
            .when(low.rlike("ase|receptor|protein"), "Protein").when(low.rlike("cancer|disease|syndrome|disorder"), "Disease").otherwise("Chemical"))


def section_label(x: Column) -> Column:
    low = F.lower(x)
    labels = list(V.SECTION_LABELS.items())
    out = F.when(low.rlike(labels[0][1]), labels[0][0])
    for name, pattern in labels[1:]:
        out = out.when(low.rlike(pattern), name)
    return (out.when(word_count(x) < 10, "header").when(x.rlike(r"[0-9]+\.\s+[A-Za-z0-9_]+.*\([0-9]{4}\)"), "references")
            .when(x.rlike(r"^(Figure|Table|Fig\.)"), "figure_caption").otherwise("content"))


def heading_norm(x: Column) -> Column:
    x = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s*[0-9]+(\.[0-9]+)*[.)]?\s+", ""))
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"\s+", " ")), "^[ :.-]+|[ :.-]+$", "")


def heading_type(x: Column) -> Column:
    kinds = list(V.HEADING_TYPES.items())
    out = F.when(x.rlike(kinds[0][1]), kinds[0][0])
    for name, pattern in kinds[1:]:
        out = out.when(x.rlike(pattern), name)
    return out.otherwise("other")


def default_score(label: Column, words: Column) -> Column:
    """Base score of a section label, half if short, a tenth more if long; thousandths."""
    table = F.create_map(*(F.lit(v) for k, s in V.SECTION_SCORES.items() for v in (k, round(s * 100))))
    base = F.coalesce(F.try_element_at(table, label), F.lit(50))
    return F.least(F.lit(1000), F.greatest(F.lit(0), base * F.when(words < 10, 5).when(words > 100, 11).otherwise(10)))
