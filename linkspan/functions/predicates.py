"""Predicates as native column expressions: term and phrase matching, gates, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

# ---- fixed values -------------------------------------------------------------------------------------------------------
#: Types of concepts that a mention of a condition may mean.
ACCEPTED_TYPES = (
    "Disease or Syndrome", "Neoplastic Process", "Mental or Behavioral Dysfunction", "Sign or Symptom", "Injury or Poisoning", "Anatomical Abnormality",
    "Pathologic Function", "Finding", "Congenital Abnormality", "Acquired Abnormality", "Cell or Molecular Dysfunction", "Experimental Model of Disease",
)
#: Interventions that are no therapy.
CONTROL_TERMS = (
    "placebo", "saline", "sodium chloride", "sham", "standard of care", "standard therapy", "usual care", "best supportive care", "supportive care",
    "no intervention", "observation", "vehicle", "matching placebo", "optimal medical therapy", "optimal medical treatment", "control rx", "control arm",
    "guideline-directed medical therapy", "guideline directed medical therapy",
)
#: Strings that plainly name no drug, at the start of an intervention.
NON_DRUG = (
    r"placebo|sham|no intervention|observation|blank control|control|standard[\s\-]|usual care|best supportive care|supportive care|monotherapy|"
    r"combination therapy|polypill|medication management|weight loss|medical (?:therapy|treatment)|optimal medical|optimized medical|"
    r"guideline[\s\-]directed|gdmt|vehicle|saline|sodium chloride|iv solution|iv fluids?"
)
#: Terms of safety and laboratory outcomes, which are no instruments.
SCAFFOLDING = ("ctcae", "common terminology criteria", "meddra", "adverse event", "adverse events", "pharmacokinetic", "concentration-time", "blood pressure", "vital sign")
#: Terms of at most so many characters match whole words only; terms of fewer than so many are not searched in prose.
SHORT_TERM, LEAST_TERM = 4, 6
# -------------------------------------------------------------------------------------------------------------------------


def typed(types: Column, accepted: tuple[str, ...] = ACCEPTED_TYPES) -> Column:
    """Whether an array of types has an accepted one; false for null."""
    return F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, accepted))), F.lit(False))


def quoted(c: Column) -> Column:
    """A literal for use inside a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def term_matches(term: Column, text: Column) -> Column:
    """A term of up to four characters as a whole word, a longer one anywhere; case does not count, empty terms match nothing."""
    t, x = F.lower(F.trim(term)), F.lower(text)
    whole = F.regexp_like(x, F.concat(F.lit(r"(?U)\b"), quoted(t), F.lit(r"\b")))
    return F.coalesce((t != "") & F.when(F.length(t) <= SHORT_TERM, whole).otherwise(x.contains(t)), F.lit(False))


def phrase_in(phrase: Column, text: Column) -> Column:
    """Whether a phrase stands in a text with no ASCII letter or digit on either side; both lower case, hyphens as spaces."""
    return F.coalesce((phrase != "") & F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])"), quoted(phrase), F.lit("(?![a-z0-9])"))), F.lit(False))


def scaffolding(text: Column) -> Column:
    """Whether a lower-case outcome is about safety or laboratory values."""
    return text.rlike("|".join(SCAFFOLDING))


def control(name: Column) -> Column:
    """P10: whether an intervention is no therapy."""
    return F.lower(name).rlike("|".join(CONTROL_TERMS))


def plainly_no_drug(name: Column) -> Column:
    """P18."""
    return name.rlike(rf"(?i)^\s*(?:{NON_DRUG})\b")


def trial_id(c: Column) -> Column:
    """NCT and eight digits."""
    return F.coalesce(c.rlike(r"^NCT\d{8}$"), F.lit(False))


def disease_code(c: Column) -> Column:
    """Codes that begin with D or C."""
    return c.rlike("^[DC]")


def disease_branch(tree_numbers: Column) -> Column:
    """Whether a tree number lies in C or F03."""
    return F.exists(tree_numbers, lambda x: x.startswith("C") | x.startswith("F03"))


def symbol_in_name(symbol: Column, name: Column) -> Column:
    """P20: a gene symbol as a whole word of a name, case aside; false where either is null or empty."""
    s = F.coalesce(symbol, F.lit(""))
    return (s != "") & F.regexp_like(F.coalesce(name, F.lit("")), F.concat(F.lit(r"(?i)\b"), quoted(s), F.lit(r"\b")))


def matching_outcomes(outcomes: Column, needle: Column) -> Column:
    """The measures of an array<struct<measure>> that contain the needle, verbatim but for white space at the ends; case does not count, null gives none."""
    n = F.lower(F.trim(needle))
    hit = F.filter(F.coalesce(outcomes, F.array().cast("array<struct<measure:string>>")), lambda o: F.lower(o["measure"]).contains(n) & (n != ""))
    return F.transform(hit, lambda o: trimmed(o["measure"]))


def uses_instrument(primary: Column, secondary: Column, other: Column, needle: Column) -> Column:
    """Whether any outcome of three kinds contains the needle."""
    return F.size(F.concat(*[matching_outcomes(x, needle) for x in (primary, secondary, other)])) > 0


def text_contains_any_field(query: Column, *fields: Column) -> Column:
    """The query anywhere in the fields joined by spaces, case aside."""
    return F.lower(F.concat_ws(" ", *fields)).contains(F.lower(query))


def words_present(name: Column, blob: Column, longer_than: int = 4) -> Column:
    """struct<present, of> of the words of a name longer than four characters, found in a text."""
    words = F.filter(F.split(name, " "), lambda w: F.length(w) > longer_than)
    return F.struct(F.size(F.filter(words, lambda w: blob.contains(w))).alias("present"), F.size(words).alias("of"))


def overlaps_enough(found: Column) -> Column:
    """All words but one, and two at least."""
    return found["present"] >= F.greatest(F.lit(2), found["of"] - 1)


def pdf_magic(content: Column) -> Column:
    """Whether a file begins as a PDF does."""
    return F.substring(content, 1, 4) == F.lit(b"%PDF")
