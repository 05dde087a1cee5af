"""Personal data: patterns, and terms that disclose them by co-occurrence.

DataFrame functions alone; no Python runs on the executors.

Base.  Leftmost non-overlapping matches of each kind (email, ip, card, phone);
matches that fail the kind's check are dropped.  Positions are code points.

Disclosure.  The values found are the protected entities c.  The corpus gives
p(c), p(t) and p(c, t) as shares of distinct texts (copies count once), t being a
word of LETTERS letters or more, A-Z lowered.  With IC(c) = -log2 p(c) and
PMI(c, t) = log2 p(c, t) / (p(c) p(t)), the ratio PMI / IC says how much of c's
information t gives away (near 1: t occurs with c only).  p(t) is smoothed: t is
taken to be in UNSEEN more texts, without c, so that a ratio that rests on few texts
is lowered by what one more text could change.  No value and no term is left out for
being in few texts.  In texts that hold c, terms with a ratio of REMOVE or more are
removed, of GENERALISE or more are replaced by a general sign.

Null and empty texts have no spans.  A text without base spans has no others.
Repeated rows and ids each get their own result.  Extra columns are passed through
by ``sanitise`` and otherwise ignored; working columns have names of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, ship

# Kinds in order, with patterns equal in effect to
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+ of 12 to 19 digits                phone \+[0-9][\x20().0-9-]+[0-9]
# A match starts where its first run of signs starts or the match before ended, so
# no run is tried from its middle; repeats that can't be shortened are possessive.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$"
LETTERS = 4
TERM = r"(?<!\p{L})\p{L}{4,}+"
REMOVE, GENERALISE, UNSEEN = 0.9, 0.75, 1
BROADCAST_ROWS = 200_000
CHUNK = 32
BUCKETS = 128
SPAN = "struct<start:bigint,kind_no:int,stop:bigint,kind:string,value:string>"


def let(value: Column, body) -> Column:
    """``body`` of the value, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_runs(items: Column) -> Column:
    """An array cut into runs of CHUNK items."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))


def located(text: Column, found: Column, pattern: str, kind_no: int, kind: str) -> Column:
    """Spans of ``found``, all matches of the pattern in order, with their places.

    Places add up over runs of CHUNK matches, and runs over the text, so the work
    grows with the number of matches and not with its square.
    """
    z = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    place = F.lit(0).cast("bigint")
    size = lambda x: (F.length(x["m"]) + F.length(x["p"])).cast("bigint")
    runs = let(z, in_runs)
    none = F.array().cast(f"array<{SPAN}>")

    def span(at, x):
        start = at + F.length(x["p"])
        return F.array(F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), (start + F.length(x["m"])).alias("stop"), F.lit(kind).alias("kind"), x["m"].alias("value")))

    inner = lambda run: F.aggregate(run, F.struct(place.alias("at"), none.alias("out")), lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.concat(a["out"], span(a["at"], x)).alias("out")))
    shift = lambda s, at: F.struct((s["start"] + at).alias("start"), s["kind_no"], (s["stop"] + at).alias("stop"), s["kind"], s["value"])
    rows = F.aggregate(F.transform(runs, inner), F.struct(place.alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")), lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(r["out"], lambda s: shift(s, a["at"])))).alias("out")))
    return F.when(F.size(found) > 0, F.flatten(rows["out"])).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str):
    """The check of a kind, as a function of a span."""
    digits = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    return {
        "email": lambda s: s["value"].isNotNull(),
        "ip": lambda s: s["value"].rlike(OCTETS),
        "card": lambda s: luhn(digits(s)),
        "phone": lambda s: F.length(digits(s)).between(9, 15),
    }[kind]


def base_spans(docs: DataFrame, text_col: str = "text", out: str = "_base") -> DataFrame:
    """``docs`` and an array of spans, sorted by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        every = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        docs = docs.withColumn(f"_{kind}", F.when(F.contains(text, F.lit(NEEDS[kind])), every).otherwise(none) if NEEDS[kind] else every)
    for k, kind in enumerate(KINDS):
        docs = docs.withColumn(f"_{kind}_at", F.filter(located(text, F.col(f"_{kind}"), PATTERNS[kind], k, kind), _valid(kind)))
    sorted_ = F.array_sort(F.concat(*(F.col(f"_{kind}_at") for kind in KINDS)))
    return docs.withColumn(out, sorted_).drop(*(f"_{kind}{x}" for kind in KINDS for x in ("", "_at")))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lower(text), F.lit(TERM), F.lit(0)))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], _lower(s["value"]))))


def disclosing(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(entity, term, ratio) of terms that give away an entity of the corpus.

    ``found`` has _key, _text, _base of the texts with base spans.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    n = texts.select(F.xxhash64("text").alias("h"), F.sha1("text").alias("s")).distinct().count()
    once = found.groupBy(F.xxhash64("_text").alias("h"), F.sha1("_text").alias("s")).agg(F.min("_key").alias("_key")).select("_key")
    units = found.join(once, "_key")
    per = units.select("_key", F.explode(_entities(F.col("_base"))).alias("entity"))
    counted = per.join(per.groupBy("entity").agg(F.count("*").alias("dc")), "entity")
    # values of the same single text have the same ratios, so one stands for all of them
    single = F.col("dc") == 1
    held = counted.groupBy("_key").agg(F.collect_list(F.when(~single, F.struct("entity", "dc"))).alias("e"), F.min(F.when(single, F.struct("entity", "dc"))).alias("one"))
    held = held.select("_key", F.concat("e", F.when(F.col("one").isNull(), F.array().cast("array<struct<entity:string,dc:bigint>>")).otherwise(F.array("one"))).alias("e"))
    pairs = units.join(held, "_key").select("e", F.explode(_terms(F.col("_text"))).alias("term")).select(F.explode("e").alias("e"), "term")
    pairs = pairs.groupBy(F.col("e.entity").alias("entity"), F.col("e.dc").alias("dc"), "term").agg(F.count("*").alias("dct"))
    # a term is at least as common as with the entity; only ratios that can reach the threshold go on
    ratio = lambda dt: (F.log2(F.col("dct") * float(n) / (F.col("dc") * (dt + UNSEEN)))) / F.log2(F.greatest(F.lit(1.0 + 1e-9), F.lit(float(n)) / F.col("dc")))
    work = Workspace(found.sparkSession, "terms")
    pairs = work.cut(pairs.where(ratio(F.col("dct")) >= GENERALISE), "pairs")
    terms = work.cut(pairs.groupBy("term").agg(F.lit(1).alias("one")).select("term"), "terms")
    known = terms.count()
    if not known:
        return pairs.select("entity", "term", F.lit(0.0).alias("ratio"))
    every = texts.distinct().select(F.explode(_terms(F.col("text"))).alias("term"))
    if known <= BROADCAST_ROWS:
        counts = every.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("dt"))
    else:
        counts = every.groupBy("term").agg(F.count("*").alias("dt")).join(terms, "term", "left_semi")
    return work.cut(pairs.join(counts, "term").withColumn("ratio", ratio(F.col("dt"))).where(F.col("ratio") >= GENERALISE).select("entity", "term", "ratio"), "ratios")


def detect(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows with ``carry`` columns, _text, _base (spans) and _all (base and disclosing terms)."""
    spark = docs.sparkSession
    ship(spark)
    carry = docs.columns if carry is None else carry
    work = Workspace(spark, "pii")
    own = F.struct(*carry).alias("_row") if carry else F.lit(None).alias("_row")
    rows = base_spans(docs.select(own, F.col(text_col).alias("_text")), "_text")
    rows = rows.withColumn("_has", F.size("_base") > 0)
    keep_text = text_col in carry
    table = work.cut(rows.select("_row", F.when(F.col("_has"), F.col("_text")).alias("_text"), "_base").withColumn("_key", F.monotonically_increasing_id()), "base")
    found = table.where(F.size("_base") > 0)
    terms = disclosing(found.select("_key", "_text", "_base"), docs, text_col)
    mine = found.select("_key", F.explode(_entities(F.col("_base"))).alias("entity")).join(terms, "entity")
    mine = mine.groupBy("_key", "term").agg(F.max("ratio").alias("ratio"))
    # a map is searched from its start, so a text's terms are in BUCKETS maps of a few terms each
    mine = mine.groupBy("_key", _bucket(F.col("term")).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("term", "ratio"))).alias("m"))
    mine = mine.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("_terms"))
    more = found.join(mine, "_key", "left").withColumn("_runs", F.when(F.col("_terms").isNotNull(), F.regexp_extract_all("_text", F.lit(TERM), F.lit(0))).otherwise(F.array().cast("array<string>")))
    more = more.withColumn("_at", located(F.col("_text"), F.col("_runs"), TERM, len(KINDS), "term"))
    ratio = lambda s: F.try_element_at(F.try_element_at("_terms", _bucket(_lower(s["value"]))), _lower(s["value"]))
    apart = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    hits = F.filter("_at", lambda s: F.coalesce(ratio(s), F.lit(0.0)) >= GENERALISE)
    more = more.withColumn("_hits", F.filter(hits, apart))
    named = F.transform("_hits", lambda s: F.struct(s["start"], (s["kind_no"] + F.when(ratio(s) >= REMOVE, 1).otherwise(0)).alias("kind_no"), s["stop"], F.when(ratio(s) >= REMOVE, "remove").otherwise("generalise").alias("kind"), s["value"]))
    more = more.withColumn("_all", F.array_sort(F.concat("_base", named))).select("_row", "_text", "_base", "_all")
    rest = table.where(F.size("_base") == 0).select("_row", F.col(f"_row.{text_col}").alias("_text") if keep_text else "_text", "_base", F.col("_base").alias("_all"))
    return more.unionByName(rest)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = detect(docs, text_col, [id_col])
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select(F.col(f"_row.{id_col}").alias(id_col), *map(count, KINDS), F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with base spans and generalised terms replaced by signs, and removed terms gone.

    Of overlapping spans the first stays and the others extend it.
    """
    rows = detect(docs, text_col)
    sign = lambda s: F.when(s["kind"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(F.when(s["kind"] == "generalise", "term").otherwise(s["kind"])), F.lit("]")))
    gap = "struct<since:bigint,start:bigint,sign:string>"

    def step(a, s):
        fresh = F.array(F.struct(a["at"].alias("since"), s["start"].alias("start"), sign(s).alias("sign")))
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], fresh)).otherwise(a["out"]).alias("out"))

    # gaps between spans, by runs: lists grow and texts are cut within a run only
    within = lambda at, run: F.aggregate(run, F.struct(at.alias("at"), F.array().cast(f"array<{gap}>").alias("out")), step)
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{gap}>>").alias("out"))
    walk = F.aggregate(in_runs(F.col("_all")), begin, lambda a, run: let(within(a["at"], run), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out"))))
    rows = rows.withColumn("_walk", F.when(F.size("_all") > 0, walk))

    def part(run):
        first, last = F.element_at(run, 1), F.element_at(run, -1)
        piece = F.substring(F.col("_text"), (first["since"] + 1).cast("int"), (last["start"] - first["since"]).cast("int"))
        cut = lambda of, x: F.concat(F.substring(of, (x["since"] - first["since"] + 1).cast("int"), (x["start"] - x["since"]).cast("int")), x["sign"])
        return let(piece, lambda of: F.array_join(F.transform(run, lambda x: cut(of, x)), ""))

    joined_parts = F.array_join(F.transform(F.filter("_walk.out", lambda run: F.size(run) > 0), part), "")
    tail = F.substring(F.col("_text"), (F.col("_walk.at") + 1).cast("int"), F.length("_text"))
    text = F.when(F.size("_all") > 0, F.concat(joined_parts, tail)).otherwise(F.col("_text"))
    return rows.withColumn("_new", text).select(*(F.col("_new").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
