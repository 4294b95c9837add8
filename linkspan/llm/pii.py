"""PII (2): regular expressions propose spans, checksums confirm them, words nearby adjust the score.

All of it is JVM-side expressions: two ``regexp_extract_all`` calls per kind give, for each match, the text between it and the
match before it and the match itself; their lengths add up to positions in code points, and the text on both sides of a match (48
code points, other matches in it or not) is where context words are looked for. A cheap test (a character or a bounded pattern that every match contains) keeps most texts from
the extraction. Patterns are anchored to the end of the last match and never start inside a run that has just failed, and
repetition is possessive, so very long texts cost time in proportion to their length and no deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .spans import matches

#: A span is reported when its score reaches this.
THRESHOLD = 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _characters(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits holds: every second digit from the right doubled, digits summed, modulo 10."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (1 + F.pmod(F.length(digits) - i, F.lit(2)))
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an international account number leaves 1 modulo 97 with its first four characters last and letters as 10 to 35."""
    s = F.regexp_replace(account, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, (rest * 10 + v - 48) % 97).otherwise((rest * 100 + v - 55) % 97)

    return F.aggregate(_characters(turned), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # of the match
    may: Callable[[Column], Column]  # whether a text may hold a match
    valid: Callable[[Column], Column]
    base: bool
    score: float  # before context
    near: str = ""  # context words that speak for it
    far: str = ""  # and against


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_LOCAL = "A-Za-z0-9._%+-"

#: In the order of the report. Scores of base kinds without context already reach the threshold.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda m: F.lit(True), True, 0.8, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"), lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), True, 0.7, "ip|host|server|address|adresse|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), lambda m: F.when(F.length(_digits(m)).between(12, 19), luhn(_digits(m))).otherwise(False), True, 0.8, "card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(9, 15), True, 0.7, "tel|phone|call|fax|mobil|anruf|llam"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), lambda m: F.when(F.length(F.regexp_replace(m, r"\x20", "")).between(15, 34), mod97(m)).otherwise(False), False, 0.6, "iban|konto|account|cuenta|compte", "sha|md5|key|token"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: F.lit(True), False, 0.3, "ssn|social security|sozialvers"),
    Kind("local_phone", r"(?<![0-9+.-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])", lambda t: t.rlike(r"[0-9]{3}[.-][0-9]{4}"), lambda m: F.lit(True), False, 0.3, "tel|phone|call|fax|mobil|anruf|llam", "order|invoice|isbn|serial|bestell"),
)


def _spans(text: Column, kind: Kind, order: int) -> Column:
    """array<struct<start, ord, end, kind, score>> of the valid matches of a kind, leftmost and non-overlapping."""
    near = lambda x, words: x["before"].rlike(rf"(?i)\b(?:{words})") | x["after"].rlike(rf"(?i)\b(?:{words})")
    score = lambda x: F.lit(kind.score) + F.when(near(x, kind.near), 0.3).otherwise(0.0) - (F.when(near(x, kind.far), 0.3).otherwise(0.0) if kind.far else F.lit(0.0))
    valid = F.filter(matches(text, kind.pattern), lambda x: kind.valid(x["match"]))
    out = F.transform(valid, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), (x["start"] + F.length(x["match"])).alias("end"), F.lit(kind.name).alias("kind"), F.round(F.lit(0.0) + score(x), 2).alias("score")))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,score:double>>")
    return F.when(kind.may(text), out).otherwise(none)


def _report(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, text: str = "text", id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """id and spans (array of start, ord, end, kind, score; code points, end exclusive) of every row, sorted by start, then kind.

    Base kinds (email, ip, card, phone) are reported whenever their check holds; the others need a score of ``threshold`` and
    must not overlap a base span. Null texts count as empty and give no spans; other columns are ignored.
    """
    found = docs.select(F.col(id).alias("id"), text_or_empty(text).alias("t"))
    found = found.select("id", *[_spans(F.col("t"), k, i).alias(k.name) for i, k in enumerate(KINDS)])
    base = F.concat(*[F.col(k.name) for k in KINDS if k.base])
    found = found.select("id", base.alias("base"), *[k.name for k in KINDS if not k.base])
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = [F.filter(k.name, lambda s: (s["score"] >= threshold) & clear(s)) for k in KINDS if not k.base]
    return found.select(F.col("id").alias(id), F.array_sort(F.concat("base", *more)).alias("spans"))


def pii_report(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text), scores."""
    base = [k.name for k in KINDS if k.base]
    found = find_pii(docs, text, id).withColumn("_base", F.filter("spans", lambda s: s["kind"].isin(base)))
    of = lambda name: F.filter("_base", lambda s: s["kind"] == name)
    counts = [F.size(of(n)).cast("long").alias(f"n_{n}") for n in base]
    return found.select(
        id, *counts, F.sha2(_report(F.col("_base")), 256).alias("base_sha256"), _report(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
