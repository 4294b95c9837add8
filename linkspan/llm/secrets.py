"""Secret scans (6): candidates by pattern, false positives removed by a random forest.

A pattern proposes candidates in every whole text; features of each (length, character transitions, dictionary coverage, the
path of its document and the words on both sides of it) are JVM-side expressions, and so are the forest's training and use (Spark
ML). Dictionary and transitions come from the corpus: words that are frequent in all of its texts, and how often a letter follows
another in them. The forest learns from labelled findings: of a table of them, or else of ``labelled_findings``, made by rules.
Values of secrets are never returned, only their places.
"""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, n_words, small, text_or_empty
from .spans import FOUND, matches

#: Labelled findings that are made, and that are learned from at most; trees and their depth; a candidate is a secret from this probability on.
FINDINGS, LEARN_FROM, TREES, DEPTH, SECRET_FROM = 6_000, 50_000, 32, 8, 0.5
#: A word of the corpus is frequent from this count and this share of all words on (so there are at most a million); made findings use the most frequent ones.
OFTEN, SHARE, NAMES = 5, 1e-6, 200

_NAME = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth"
_VALUE = "[A-Za-z0-9+/_-]"
_RUN = r"[A-Za-z0-9_+/-]"
#: Prefixes and forms that issuers of keys document, and the armour of private keys.
_KNOWN = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
    r"|[rs]k_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}"
)
_JWT = r"eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+"
_BLOCK = r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:[A-Za-z0-9+/=:,\\\x20\x09-\x0D]++|-(?!----))*+(?:-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----)?"
#: A name that tells, or a longer one that holds it, with an optional closing quote and the sign. Whether a sign follows the run is
#: asked first, so that a run with many telling names is not tried once for each.
_GIVEN = rf"(?={_RUN}++[\x22']?\x20{{0,2}}[:=]){_RUN}*?(?i:{_NAME}){_RUN}*+[\x22']?\x20{{0,2}}[:=]"
#: A key with a known form, a value given to a telling name, or a long run with a digit; none has an upper bound on its length.
PATTERN = (
    rf"(?:{_BLOCK}|(?:\G|(?<![A-Za-z0-9_+/-]))(?:{_KNOWN}|{_JWT}"
    rf"|{_GIVEN}\x20{{0,2}}[\x22']?[^\x20\x09-\x0D\x22']{{6,}}+[\x22']?"
    rf"|(?=[A-Za-z+/_-]*+[0-9]){_VALUE}{{24,}}+))"
)
#: Words that placeholders and names are made of.
DICTIONARY = "admin|auth|change|changeme|code|config|default|demo|dummy|example|file|fixme|foo|function|here|insert|key|long|name|none|null|pass|password|path|placeholder|root|sample|secret|some|string|test|the|this|token|user|value|with|xxx|your"
FEATURES = ["length", "distinct", "digits", "uppers", "turns", "signs", "vowels", "likely", "hex", "covered", "known_words", "named", "known_form", "quoted", "path_told", "words_for", "words_against"]
#: Letters, a digit, anything else; levels of the logarithm of a transition's share.
_SYMBOLS, _LEVELS = 28, 60


def corpus_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of the frequent words of all texts: lower case, 3 to 20 letters (anything outside ASCII counts as one)."""
    word = F.explode(F.split(F.lower(text_or_empty(text)), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")).alias("word")
    # The number of all words first, so that of the counts only those of frequent words are written down.
    total = docs.agg(F.sum(n_words(text))).first()[0] or 0
    counts = docs.select(word).where(F.length("word").between(3, 20)).groupBy("word").agg(F.count("*").alias("n"))
    return checkpoint(counts.where(F.col("n") >= max(OFTEN, SHARE * total)))


def transitions(words: DataFrame) -> str:
    """For every pair of symbols a character whose code is 33 and the level of the second's share among what follows the first; one of 28 * 28 rows reaches the driver."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    letters = words.where(F.length("word") > 1).select("word", "n", at.alias("i")).select(F.substring("word", F.col("i"), F.lit(1)).alias("a"), F.substring("word", F.col("i") + 1, F.lit(1)).alias("b"), "n")
    letters = letters.where(F.col("a").between("a", "z") & F.col("b").between("a", "z"))
    n = {(r["a"], r["b"]): r["n"] for r in letters.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    after = {a: sum(n.get((a, b), 0) for b in string.ascii_lowercase) for a in string.ascii_lowercase}
    symbols = string.ascii_lowercase + "09"
    level = lambda a, b: min(_LEVELS, round(-8 * math.log((n.get((a, b), 0) + 0.01) / (after.get(a, 0) + 1))))
    return "".join(chr(33 + level(a, b)) for a in symbols for b in symbols)


def candidates(docs: DataFrame, text: str = "text", id: str = "doc_id", path: str | None = "source", words: DataFrame | None = None, table: str | None = None) -> DataFrame:
    """id, start, end, kind, FEATURES for every candidate of every whole text; null texts have none.

    ``words`` and ``table`` are what ``corpus_words`` and ``transitions`` give; without them no word but those of DICTIONARY is known.
    """
    t = text_or_empty(text)
    may = t.rlike(r"A[KS]IA[0-9A-Z]{16}|xox[abprs]-|eyJ|PRIVATE KEY") | (t.rlike(rf"(?i){_NAME}") & t.rlike("[:=]")) | t.rlike(rf"{_VALUE}{{24}}")
    rows = docs.select(F.col(id).alias("id"), F.lower(F.coalesce(F.col(path).cast("string"), F.lit(""))).alias("path") if path else F.lit("").alias("path"), F.when(may, matches(t, PATTERN)).otherwise(F.array().cast(FOUND)).alias("found"))
    rows = rows.select("id", "path", F.explode("found").alias("c")).select("id", "path", "c.start", "c.match", F.lower(F.concat_ws(" ", "c.before", "c.after")).alias("around"))
    named = F.col("match").rlike(rf"^{_GIVEN}")
    rows = rows.withColumn("named", named.cast("double")).withColumn("value", F.regexp_replace(F.when(named, F.regexp_replace("match", rf"^{_GIVEN}\x20{{0,2}}", "")).otherwise(F.col("match")), r"[\x22']", ""))
    n = F.greatest(F.length("value"), F.lit(1))

    def share(pattern: str) -> Column:
        return F.regexp_count("value", F.lit(pattern)) / n

    turns = r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"
    plain = F.translate(F.regexp_replace(F.lower("value"), "[^a-z0-9]", "|"), string.digits, "{" * 10)
    code = lambda i: F.ascii(F.substring("plain", i, F.lit(1))) - 97
    step = lambda i: F.ascii(F.substring(F.lit(table), code(i) * _SYMBOLS + code(i + 1) + 1, F.lit(1))) - 33
    likely = F.aggregate(F.sequence(F.lit(1), F.length("plain") - 1), F.lit(0), lambda a, i: a + step(i)) / (F.length("plain") - 1)
    rows = rows.withColumn("plain", plain).withColumns({
        "length": F.length("value").cast("double"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "turns": share(turns), "signs": share("[^A-Za-z0-9]"), "vowels": share("[aeiouAEIOU]"),
        "likely": F.when(F.length("plain") > 1, likely).otherwise(float(_LEVELS)) if table else F.lit(float(_LEVELS)),
        "hex": F.col("value").rlike("^[0-9a-fA-F]+$").cast("double"),
        "covered": 1 - F.length(F.regexp_replace(F.lower("value"), DICTIONARY, "")) / n,
        "known_form": F.col("value").rlike(rf"^(?:{_KNOWN}|{_JWT}|{_BLOCK})").cast("double"),
        "quoted": F.col("match").rlike(r"[\x22']").cast("double"),
        "path_told": F.col("path").rlike("test|example|sample|fixture|mock|doc/|docs/|lock").cast("double"),
        "words_for": F.regexp_count("around", F.lit(rf"\b(?:{_NAME}|key|credential|login)")).cast("double"),
        "words_against": F.regexp_count("around", F.lit(r"\b(?:commit|sha1?|sha256|sha512|md5|hash|checksum|digest|uuid|revision|example|sample|dummy|integrity|build|request|trace)")).cast("double"),
    })
    kind = F.when(F.col("value").startswith("-----BEGIN"), "private_key").when(F.col("named") == 1, "assigned").when(F.col("known_form") == 1, "access_key").otherwise("long_token")
    rows = rows.withColumn("kind", kind).withColumn("end", F.col("start") + F.length("match"))
    # Letters of the value that are in frequent words: pieces between capitals, digits and signs, met with the dictionary.
    pieces = F.filter(F.split(F.lower(F.regexp_replace("value", "([a-z])([A-Z])", "$1 $2")), r"[^a-z]+"), lambda x: F.length(x) >= 3)
    rows = rows.withColumn("pieces", pieces)
    columns = ["id", "start", "end", "kind", *FEATURES]
    if words is None:
        return rows.withColumn("known_words", F.lit(0.0)).select(*columns)
    rows = checkpoint(rows.drop("match", "around", "value", "plain").withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode("pieces").alias("word"))
    of = each.join(small(words.select("word").join(small(each.select("word").distinct()), "word", "left_semi")), "word").groupBy("row").agg(F.sum(F.length("word")).alias("letters"))
    return rows.join(small(of), "row", "left").withColumn("known_words", F.coalesce(F.col("letters") / F.greatest("length", F.lit(1.0)), F.lit(0.0))).select(*columns)


def labelled_findings(spark: SparkSession, n: int = FINDINGS, words: list[str] = ()) -> DataFrame:
    """doc_id, text, source, label: n texts with one finding each, from hashes of their numbers; label 1 is a secret.

    Secrets are random values of usual lengths and forms; the others are placeholders, names (some made of ``words``), references to
    where a secret is kept, checksums, revisions, identifiers and documented examples.
    """
    k, h, many, mixed, three = map(F.col, ("id", "h", "many", "mixed", "three"))
    words = list(words) or ["value", "name", "index", "report", "order", "item"]

    def pick(*of: str, by: int = 1) -> Column:
        return F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.floor(many / by), F.lit(len(of))) + 1).cast("int"))

    name, sign, quote = pick("password", "passwd", "pwd", "secret", "token", "api_key", "auth", "DB_PASSWORD", "clientSecret", "access-key"), pick("=", ": ", " = ", "=", by=7), pick("", '"', "", by=3)
    size = (8 + F.pmod(many, F.lit(24))).cast("int")
    part = lambda s, m: F.substring(s, F.lit(1), m)
    filler, close = pick("and then it was ", "", "set the ", "for this ", "see ", by=11), pick("", " and more", " is used", " in the file", by=13)
    given = lambda v: F.concat(name, sign, quote, v, quote)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    spiced = F.concat(F.initcap(pick(*words)), pick("!", "$", "#", "%", by=3), F.pmod(many, F.lit(97)).cast("string"), part(mixed, F.lit(4)), pick("*", "?", "&", by=19))
    cases = [
        (given(part(h, size)), 1),
        (given(h), 1),
        (given(part(mixed, size)), 1),
        (given(spiced), 1),
        (F.concat(pick("AKIA", "ASIA"), part(F.upper(mixed), F.lit(16))), 1),
        (F.concat(pick("key ", "login ", "credential "), part(mixed, F.lit(36))), 1),
        (F.concat(pick("", "token ", "use "), F.lit("ghp_"), part(mixed, F.lit(36))), 1),
        (F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9."), part(mixed, F.lit(30)), F.lit("."), F.substring(mixed, 31, 43)), 1),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed, F.lit("\n-----END RSA PRIVATE KEY-----")), 1),
        (given(pick("changeme", "example", "your_token_here", "placeholder", "test_password", "insert_key_here", "dummy-value", "xxxxxxxx", "default_secret", "none_or_null", "********", "undefined")), 0),
        (given(three), 0),
        (given(F.concat(pick("os.environ[", "${", "get_", "config.", "process.env.", "<", "{{"), three, pick("]", "}", "()", "", "", ">", "}}"))), 0),
        (F.concat(pick("commit ", "sha1 ", "revision ", "checksum ", "hash ", "build "), h), 0),
        (F.concat(pick("md5 ", "digest ", "integrity ", "etag hash "), F.md5(h)), 0),
        (F.concat(pick("uuid ", "request ", "trace ", "id "), uuid), 0),
        (F.concat(three, pick("/", "_", "-"), three, F.pmod(many, F.lit(100)).cast("string"), pick("/", "_", "-"), three), 0),
        (F.concat(pick("this_is_a_long_function_name_", "some-path/with/file/name/", "test_config_default_value_"), part(h, F.lit(4))), 0),
        (F.concat(pick("example ", "sample ", "dummy "), F.lit("AKIA"), part(F.upper(mixed), F.lit(9)), F.lit("EXAMPLE")), 0),
    ]
    rows = spark.range(0, n, 1, 1).withColumn("h", F.sha1(F.concat(F.lit("finding"), k.cast("string")))).withColumn("many", F.conv(F.substring(h, 1, 4), 16, 10).cast("int"))
    rows = rows.withColumn("mixed", F.regexp_replace(F.base64(F.unhex(F.concat(F.sha2(h, 256), F.sha2(h, 512)))), "[+/=\\r\\n]", ""))
    sep = pick("_", "-", "", by=5)
    rows = rows.withColumn("three", F.concat(pick(*words), sep, pick(*words, by=17), sep, pick(*words, by=5)))
    # A projection for each case, so that none is too large to be compiled.
    told = lambda y: F.lit("src") if y else F.when(F.pmod(many, F.lit(3)) == 0, "tests/example.py").otherwise("src")
    one = lambda i, c, y: rows.where(F.pmod(k, F.lit(len(cases))) == i).select(k.alias("doc_id"), F.concat(filler, c, close).alias("text"), told(y).alias("source"), F.lit(float(y)).alias("label"))
    return reduce(DataFrame.unionByName, [one(i, c, y) for i, (c, y) in enumerate(cases)])


def fit(findings: DataFrame, learn_from: int = LEARN_FROM, seed: int = 5, words: DataFrame | None = None, table: str | None = None) -> PipelineModel:
    """The forest, from texts with one finding each (doc_id, text, source, label); at most ``learn_from`` of them, in the order of a hash."""
    seen = candidates(findings.withColumn("_y", F.struct("doc_id", "label")), id="_y", words=words, table=table)
    rows = checkpoint(seen.orderBy(F.xxhash64("id.doc_id"), "start").limit(learn_from).select(F.col("id.label").alias("label"), *FEATURES).coalesce(1))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", id: str = "doc_id", path: str | None = "source", secret_from: float = SECRET_FROM) -> DataFrame:
    """One row per candidate: id, start, end (code points), kind, probability, is_secret.

    ``findings`` is a table of labelled ones to learn from. Rows without candidates (null and empty texts among them) give none;
    repeated rows give their candidates again. A null path counts as empty; other columns are ignored.
    """
    words = corpus_words(docs, text)
    table = transitions(words)
    if findings is None:
        often = [r["word"] for r in words.where(F.col("word").rlike("^[a-z]+$")).orderBy(F.desc("n"), "word").limit(NAMES).collect()]
        findings = labelled_findings(docs.sparkSession, words=often)
    scored = fit(findings, words=words, table=table).transform(candidates(docs, text, id, path, words, table))
    p = F.round(vector_to_array("probability")[1], 4)
    return scored.select(F.col("id").alias(id), "start", "end", "kind", p.alias("probability"), (p >= secret_from).alias("is_secret"))
