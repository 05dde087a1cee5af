"""Secret scan with a random forest that removes false positives.

DataFrame functions and the JVM's random forest; no Python runs on the executors.

Candidates are, from the left and without overlap: the password in the user part of a
URL (4 signs or more), a value after ``=`` or ``:``, quoted or not, a quoted value
without blanks (8 signs or more each), a web token of parts joined by dots, and any run of
20 or more signs of [A-Za-z0-9_+/-].  The forest sees their length, character
transitions, share of letters covered by a dictionary (words of two distinct texts of
the corpus or more), the path they come from and where in it they stand, and the words
around them.  It is trained from labelled findings; every candidate of the corpus is
scored.

Labelled findings are given by the caller (``labels``: id, start, label), at most
``bound`` of them, chosen by a hash.  Worked examples (``examples``) are always added:
values of known kinds, drawn at random for each kind, in the surroundings in which such
kinds stand.  Their labels come from the kind that was drawn, not from the features.

Null and empty texts have no candidates.  Repeated rows and ids each give their own
findings; equal candidates at different places are different findings.  A null path
is a path without any sign.  Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import BROADCAST_ROWS, located
from .shared import Workspace, ship

SHORTEST = 8
LEAD = r"://[^\s/:@]{1,64}:|[=:]\s{0,2}[\"'`]?|[\"'`]"
CANDIDATE = "|".join((
    r"://[^\s/:@]{1,64}:[^\s/@:]{4,}+(?=@)",
    r"[=:](?!//)\s{0,2}[\"'`]?[^\s\"'`,;<>()\[\]{}|=:][^\s\"'`,;<>()\[\]{}|]{7,}+",
    r"[\"'`][^\s\"'`]{8,}+(?=[\"'`])",
    r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{6,}+(?:\.[A-Za-z0-9_-]{6,}+){1,2}",
    r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}",
))
NEAR = 48
# Words that stand near secrets, and near values that only look so.
TELLING = "token|secret|password|passwd|pwd|api|apikey|key|auth|bearer|credential|private|access"
HARMLESS = "example|sample|dummy|placeholder|test|sha|sha1|sha256|md5|checksum|digest|commit|revision|uuid|hash|integrity"
# Beginnings of keys by which their issuers can be told.
ISSUED = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^(ghp_|gho_|ghs_|github_pat_|glpat-|npm_|sk_live_|sk-|xox[abpr]-|AIza|eyJ)[A-Za-z0-9_.-]{16,}"
FEATURES = ["issued", "in_url", "length", "upper", "lower", "digit", "other", "changes", "letter_digit", "distinct", "hex", "repeats", "longest_word", "covered", "path_code", "path_test", "path_depth", "position", "assigned", "quoted", "telling", "harmless"]


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """id, start, stop, value, before, after, path, position of every candidate."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), path.alias("path")).withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)
    rows = rows.withColumn("span", F.explode(located(F.col("text"), F.col("found"), CANDIDATE, 0, "secret")))
    whole = F.regexp_replace("span.value", rf"^(?:{LEAD})", "")
    rows = rows.withColumn("start", F.col("span.stop") - F.length(whole)).withColumn("value", F.regexp_replace(whole, r"[.!?:]++$", ""))
    rows = rows.withColumn("stop", F.col("start") + F.length("value"))
    low = F.greatest(F.lit(0), F.col("start") - NEAR)
    before = F.lower(F.substring(F.col("text"), (low + 1).cast("int"), (F.col("start") - low).cast("int")))
    after = F.lower(F.substring(F.col("text"), (F.col("stop") + 1).cast("int"), F.lit(NEAR)))
    rows = rows.select("id", "start", "stop", "value", before.alias("before"), after.alias("after"), "path", (F.col("start") / F.length("text")).alias("position"))
    return rows.where(F.length("value") >= F.when(_in_url(), 4).otherwise(SHORTEST))


def _in_url() -> Column:
    return F.col("before").rlike(r"://[^\s/:@]{1,64}:$") & F.col("after").startswith("@")


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", pattern, "")) / F.length("value")


def _times(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def _pieces() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0)))


def dictionary(found: DataFrame, docs: DataFrame, text_col: str, work: Workspace) -> DataFrame:
    """Letter runs of the candidates that are words of two distinct texts or more."""
    pieces = work.cut(found.select(F.explode(_pieces()).alias("word")).groupBy("word").agg(F.lit(1).alias("one")).select("word"), "pieces")
    words = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("of"), F.explode(F.array_distinct(F.split(F.lower(text_col), r"[^\p{L}0-9]+"))).alias("word")).where("length(word) >= 3")
    several = [F.min("of").alias("low"), F.max("of").alias("high")]
    if pieces.count() <= BROADCAST_ROWS:
        counts = words.join(F.broadcast(pieces), "word").groupBy("word").agg(*several)
    else:
        counts = words.groupBy("word").agg(*several).join(pieces, "word", "left_semi")
    return work.cut(counts.where("low <> high").select("word"), "dictionary")


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """The candidates with all features; ``found`` has a unique ``key``."""
    piece = found.select("key", F.explode(_pieces()).alias("word"), F.length(F.regexp_replace(F.lower("value"), "[^a-z]", "")).alias("letters"))
    covered = piece.join(known, "word").groupBy("key").agg((F.sum(F.length("word")) / F.max("letters")).alias("covered"))
    number = lambda c: c.cast("double")
    near = F.concat_ws(" ", F.right("before", F.lit(24)), F.substring(F.col("after"), 1, 16))
    return found.join(covered, "key", "left").select(
        "*", number(F.length("value")).alias("length"), _share("[^A-Z]").alias("upper"), _share("[^a-z]").alias("lower"), _share("[^0-9]").alias("digit"), _share("[A-Za-z0-9]").alias("other"),
        _times(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]").alias("changes"), _times(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]").alias("letter_digit"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.length("value")).alias("distinct"), number(F.col("value").rlike("^[0-9a-fA-F]+$")).alias("hex"), _times(r"(.)(?=\1)").alias("repeats"),
        number(F.col("path").rlike(r"\.(py|js|ts|go|java|rb|sh|env|cfg|conf|ini|yml|yaml|json|toml|properties)$")).alias("path_code"), number(F.col("path").rlike("(?i)(test|example|fixture|mock|vendor|lock)")).alias("path_test"),
        number(F.size(F.split("path", "/")) - 1).alias("path_depth"), number(F.col("value").rlike(ISSUED)).alias("issued"), number(_in_url()).alias("in_url"),
        (F.coalesce(F.array_max(F.transform(F.regexp_extract_all("value", F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)) / F.length("value")).alias("longest_word"),
        number(F.col("before").rlike(r"[=:]\s*[\"'`]?$")).alias("assigned"), number(F.col("before").rlike("[\"'`]$")).alias("quoted"),
        number(near.rlike(rf"(^|[^a-z])({TELLING})([^a-z]|$)")).alias("telling"), number(near.rlike(rf"(^|[^a-z])({HARMLESS})([^a-z.]|$)")).alias("harmless"),
    ).withColumn("covered", F.least(F.lit(1.0), F.coalesce("covered", F.lit(0.0))))


# Names and phrases for the worked examples.
SECRET_NAMES = ["password", "passwd", "db_password", "pwd", "secret", "client_secret", "token", "auth_token", "access_token", "api_key", "apikey", "API key", "private key", "access key", "credential", "Bearer token"]
OTHER_NAMES = ["note", "title", "name", "id", "color", "style", "href", "class", "version", "subject", "see", "ratio", "time", "file", "user", "section", "size", "format", "source", "result"]
DIGEST_NAMES = ["sha1", "sha256 digest", "md5", "commit", "checksum", "revision", "uuid", "hash", "integrity", "example key", "test token", "sample password", "dummy secret", "placeholder key"]
PHRASES = ["and then ", "of the ", "he said ", "in the section on ", "as was found in ", "see also ", "to be read with ", ""]
WORDS = ["required", "something", "described", "information", "following", "translation", "government", "understanding", "university", "particular", "development", "yesterday"]
PLACEHOLDERS = ["changeme", "changeme123", "your_api_key_here", "your-token-here", "xxxxxxxxxxxx", "XXXXXXXXXXXXXXXXXXXX", "undefined", "password", "None_None", "1234567890", "${API_KEY}", "REPLACE_ME_NOW", "********", "abcdefghijklmnop"]
SEPARATORS = [" = \"", "=", ": ", ": \"", " = '", ":", "=\"", " := "]


def examples(spark: SparkSession, n: int = 300) -> DataFrame:
    """Worked examples of every kind, n each: candidates with their label; the same in every run."""
    i = F.col("id")
    draw = lambda salt: F.sha2(F.concat_ws("-", F.lit(salt), i.cast("string")), 256)
    at = lambda salt, k: F.pmod(F.xxhash64(F.lit(salt), i), F.lit(k)).cast("int")
    pick = lambda salt, of: F.element_at(F.array(*map(F.lit, of)), at(salt, len(of)) + 1)
    hexes = draw("h")
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(draw("m"), draw("n")))), "[^A-Za-z0-9]", "q")
    signs = F.concat_ws("", *(F.concat(F.substring(mixed, 3 * k + 1, 3), pick(f"s{k}", ["!", "#", "$", "%", "*", "-", "_", ".", "", ""])) for k in range(5)))
    cut = lambda value, low, high: F.substring(value, F.lit(1), at("l", high - low + 1) + low)
    number = F.conv(F.substring(draw("d"), 1, 12), 16, 10)
    letters = F.translate(F.substring(draw("w"), 1, 20), "0123456789", "ghiklmnors")
    word = pick("w1", WORDS)
    password = F.concat(F.substring(pick("w2", WORDS), F.lit(1), at("pl", 5) + 3), F.substring(mixed, F.lit(1), at("pm", 5) + 3), F.substring(number, 1, 2), pick("ps", ["!", "#", "", "$", "_", "x"]))
    dashed = F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    jwt = F.concat(F.lit("eyJ"), F.substring(mixed, 1, 20), F.lit("."), F.substring(mixed, 21, 30), F.lit("."), F.substring(mixed, 5, 22))
    issued = F.concat(pick("is", ["ghp_", "gho_", "glpat-", "npm_", "sk_live_", "xoxb-"]), F.substring(mixed, 1, 30))
    aws = F.concat(pick("aw", ["AKIA", "ASIA"]), F.substring(F.upper(F.translate(hexes, "01", "qz")), 1, 16))
    named = lambda names: F.concat(pick("ph", PHRASES), pick("nm", names), pick("sp", SEPARATORS))
    prose, url = pick("ph", PHRASES), F.concat(F.lit("https://"), pick("us", ["admin", "root", "app", "user1"]), F.lit(":"))
    secret, digest, other = named(SECRET_NAMES), named(DIGEST_NAMES), named(OTHER_NAMES)
    end = pick("en", ["\" ", "", "'", "\n", ". "])
    kinds = [
        (hexes, secret, end, 1), (cut(hexes, 16, 40), secret, end, 1), (cut(mixed, 10, 60), secret, end, 1), (cut(mixed, 8, 20), secret, end, 1), (cut(signs, 9, 18), secret, end, 1),
        (password, secret, end, 1), (dashed, secret, end, 1), (F.concat_ws(".", F.substring(mixed, 1, 5), F.substring(mixed, 9, 8), F.substring(hexes, 1, 8)), secret, end, 1), (F.concat(cut(mixed, 30, 50), F.lit("==")), secret, end, 1),
        (jwt, secret, end, 1), (jwt, prose, F.lit(" "), 1), (issued, secret, end, 1), (issued, prose, F.lit(" "), 1), (aws, secret, end, 1), (aws, prose, F.lit(" "), 1),
        (password, url, F.lit("@host"), 1), (cut(mixed, 6, 24), url, F.lit("@db.local"), 1),
        (hexes, digest, end, 0), (cut(hexes, 32, 40), digest, end, 0), (dashed, digest, end, 0), (cut(mixed, 20, 60), digest, end, 0), (F.substring(hexes, 1, 40), F.lit("commit "), F.lit(" "), 0),
        (dashed, other, end, 0), (pick("pc", PLACEHOLDERS), secret, end, 0), (pick("pc", PLACEHOLDERS), digest, end, 0), (F.concat(F.lit("AKIA"), F.repeat(F.lit("X"), 16)), prose, end, 0), (F.concat(pick("is", ["ghp_", "npm_", "sk-"]), F.repeat(F.lit("x"), 30)), prose, end, 0),
        (F.repeat(pick("is", ["eyJ", "ghp_", "key", "Ab1"]), 60), prose, end, 0), (F.repeat(F.substring(mixed, 1, 3), 20), secret, end, 0),
        (word, other, end, 0), (word, secret, end, 0), (F.concat(word, pick("w3", WORDS)), prose, end, 0), (F.concat_ws("-", word, pick("w3", WORDS), pick("w4", WORDS)), prose, F.lit(" "), 0), (F.concat_ws("_", word, pick("w3", WORDS)), secret, end, 0),
        (F.concat_ws("/", word, pick("w3", WORDS), pick("w4", WORDS)), other, end, 0), (letters, prose, F.lit(" "), 0), (letters, other, end, 0), (F.concat(F.initcap(word), F.initcap(pick("w3", WORDS)), pick("w4", WORDS)), other, end, 0),
        (number, other, end, 0), (F.substring(F.concat(number, number), 1, 12), prose, end, 0), (F.repeat(F.substring(number, 1, 1), 24), prose, F.lit(" "), 0), (F.concat_ws(":", F.lit("12"), F.substring(number, 1, 2), F.substring(number, 3, 5)), other, end, 0),
        (F.concat_ws(".", F.substring(number, 1, 2), F.substring(number, 3, 2), F.substring(number, 5, 4)), other, end, 0), (F.concat_ws("-", F.lit("2021"), F.substring(number, 1, 2), F.substring(number, 3, 4)), other, end, 0), (F.concat(word, F.lit("@"), letters, F.lit(".org")), other, end, 0), (F.concat(F.lit("www."), letters, F.lit(".com/"), word), other, end, 0),
    ]
    base = spark.range(0, n, 1, 1)
    path = pick("pa", ["", "", "src3", "web/notes.txt", "app/settings.py", "conf/prod.env", "docs/example.md", "test/data.json"])
    place = F.pmod(F.xxhash64(F.lit("place"), i), F.lit(1000)) / 1000.0

    def one(value: Column, before: Column, after: Column, label: int) -> DataFrame:
        return base.select(i, F.lit(0).cast("bigint").alias("start"), F.length(value).cast("bigint").alias("stop"), value.alias("value"), F.lower(F.right(before, F.lit(NEAR))).alias("before"), after.alias("after"), path.alias("path"), place.alias("position"), F.lit(float(label)).alias("label"))

    return reduce(DataFrame.unionByName, (one(*kind) for kind in kinds))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, labels: DataFrame | None = None, bound: int = 20_000, cut: float = 0.5) -> DataFrame:
    """Findings that the forest takes for secrets: id, start, stop, value_sha256, score."""
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "secrets")
    found = work.cut(candidates(docs, id_col, text_col, path_col).withColumn("key", F.monotonically_increasing_id()), "candidates")
    worked = work.cut(examples(spark).withColumn("key", F.monotonically_increasing_id()), "examples")
    known = dictionary(found.select("value").unionByName(worked.select("value")), docs, text_col, work)
    rows = work.cut(described(found, known), "features")
    train = described(worked, known).select("label", *FEATURES)
    if labels is not None:
        labelled = rows.join(labels.select(F.col(id_col).alias("id"), "start", F.col("label").cast("double").alias("label")), ["id", "start"]).where("label is not null")
        n, space = labelled.count(), 1 << 30
        taken = labelled.where(F.pmod(F.xxhash64("value", "start", "key"), F.lit(space)) < min(space, int(space * bound / max(n, 1)) + 1))
        train = train.unionByName(taken.select("label", *FEATURES))
    train = work.cut(train, "train")
    vector = VectorAssembler(inputCols=FEATURES, outputCol="_x", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y", numTrees=30, maxDepth=9, seed=11).fit(vector.transform(train.coalesce(4)))
    scored = forest.transform(vector.transform(rows)).withColumn("score", F.element_at(vector_to_array("_p"), 2))
    return scored.where(F.col("score") >= cut).select(F.col("id").alias(id_col), "start", "stop", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"))
