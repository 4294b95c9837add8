"""Text functions as native column expressions: normal forms, name splitting, keys and codes.

Every function takes a Column and returns one; none is a UDF, so all of them stay inside generated code and can be pushed,
folded and pruned by Catalyst. Null gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------------
#: Words in front of an outcome that do not name what is measured.
MEASURE_PREFIXES = ("change from baseline in ", "change in ", "mean change in ", "percent change in ", "absolute change in ", "time to ", "number of ", "proportion of ", "incidence of ", "rate of ")
#: What a qualifier of a population begins with; a name does not.
QUALIFIER_LEADS = ("in ", "for ", "among ", "with ", "and in ")
#: Words of form and schedule in drug strings.
FORM_WORDS = (
    "oral|tablet|tablets|tab|tabs|capsule|capsules|cap|caps|injection|injectable|solution|extended[\\s\\-]release|sustained[\\s\\-]release|"
    "enteric[\\s\\-]coated|bid|tid|qd|daily|product|group|dose|high|low|medium"
)
#: How five axes of an instrument show in its definition.
AXES = {
    "STRUCTURE": r"\b(?:\d{1,3}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)[- ]item\b",
    "REPORTER": r"\b(?:self[- ]administered|self[- ]report|patient[- ]reported|clinician[- ]reported|observer[- ]reported|interviewer[- ]administered|proxy[- ]administered|performance)\b",
    "SCALE": r"\b(?:\d{1,2}[- ]point|likert|visual analog|analogue|\d\s*(?:to|-)\s*\d\s*(?:rating|scale|point))\b",
    "RECALL": r"\b(?:preceding day|past \d+ (?:hours|days|weeks)|last \d+ (?:hours|days|weeks)|past week|past month|previous \d+ (?:hours|days|weeks)|daily|weekly|24[- ]hour|7[- ]day)\b",
    "DEVELOPER": r"\b(?:developed by|adapted from|created by)\b",
}
#: A name with its abbreviation; the same where a slash may stand in the abbreviation.
UNIT, UNIT_WITH_SLASH = r"([^()]+?)\s*\(([A-Z][A-Za-z0-9\-]*)\)", r"([^()]+?)\s*\(([A-Z][A-Za-z0-9\-/]*)\)"
#: Doses in drug strings: an amount, and an amount in an amount.
DOSE = r"(?i)\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|%|units?|iu)\b"
DOSE_IN = r"(?i)\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml)\s*/\s*\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml)\b"
#: Time points at the end of an outcome.
AT_WEEK_N, AT_N_WEEKS = r"(?idU)\s+at\s+(?:week|day|month|year)s?\s*\d+.*$", r"(?idU)\s+at\s+\d+\s+(?:week|day|month|year)s?.*$"
#: A drug in a compendium cell: brand, generic, day of approval.
DRUG_ENTRY = r"([A-Z][A-Za-z0-9\-’']*)\s*\(([^)]+)\)\s*((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4})"
# -------------------------------------------------------------------------------------------------------------------------

#: White space as Unicode has it, which is what trimming in these functions means.
_WS = r"(?U)\s"


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, rf"{_WS}+", " "), "^ | $", "")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def normalize(c: Column) -> Column:
    """without parentheses, typographic apostrophes plain, lower case, only letters, digits, hyphens and apostrophes; null gives ''."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), rf"{_WS}*\([^)]*\)", " ")
    s = F.lower(F.replace(s, F.lit("’"), F.lit("'")))
    return squeeze(F.regexp_replace(s, rf"[^a-z0-9\-'&&\S]|[^a-z0-9\-'\s]", " "))


def normalize_loose(c: Column) -> Column:
    """as ``normalize``, hyphens and apostrophes gone too."""
    return squeeze(F.regexp_replace(normalize(c), "[-']", " "))


def loose_words(c: Column) -> Column:
    """The words of ``normalize_loose``, in order, by one cut instead of its replacements."""
    s = F.lower(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{_WS}*\([^)]*\)", " "), F.lit("’"), F.lit("'")))
    return F.filter(F.split(s, "[^a-z0-9]+"), lambda w: w != "")


def after_colon(c: Column) -> Column:
    """What follows the first colon, or all of it."""
    return F.when(c.contains(":"), F.regexp_extract(c, r"(?s)^[^:]*:(.*)$", 1)).otherwise(c)


def split_names(c: Column) -> Column:
    """the names of a cell of at least two complete ``Name (ABBR)`` units, else an empty array."""
    units = F.regexp_extract_all(c, F.lit(UNIT), 1)
    return F.when(F.size(units) >= 2, F.filter(F.transform(units, trimmed), lambda u: u != "")).otherwise(F.array().cast("array<string>"))


def instrument_names(c: Column) -> Column:
    """names in a catalogue entry: units that are noun phrases when there are two or more, else the whole without parentheses."""
    body = after_colon(c)
    units = F.transform(F.regexp_extract_all(body, F.lit(UNIT_WITH_SLASH), 1), trimmed)
    leads = lambda u: F.array(*[F.startswith(F.lower(u), F.lit(x)) for x in QUALIFIER_LEADS])
    named = F.transform(F.filter(units, lambda u: (u != "") & ~F.exists(leads(u), lambda x: x)), lambda u: trimmed(F.regexp_replace(u, r"(?i)^and\s+", "")))
    whole = squeeze(F.regexp_replace(body, r"\s*\([^)]*\)", " "))
    one = F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(named) >= 2, named).otherwise(one)


def abbreviations(c: Column) -> Column:
    """Abbreviations of two or more characters in parentheses."""
    return F.regexp_extract_all(c, F.lit(r"\(([A-Za-z0-9\-]{2,})\)"), 1)


def aliases(c: Column) -> Column:
    """distinct lower-case spellings of a name: all of it with hyphens and spaces alike, and each abbreviation."""
    return F.array_distinct(F.concat(F.array(flat_spaces(F.lower(c))), F.transform(abbreviations(c), F.lower)))


def flat_spaces(c: Column) -> Column:
    """runs of hyphens and spaces as one space."""
    return F.trim(F.regexp_replace(c, r"[-\s]+", " "))


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def six_digit_key(c: Column) -> Column:
    """the first run of six digits, else null."""
    return _or_null(F.regexp_extract(c, r"(\d{6})", 1))


def entry_number(c: Column) -> Column:
    """six digits, or four digits, a hyphen and digits; '' without either."""
    return F.regexp_extract(c, r"(\d{6}|\d{4}-\d+)", 1)


def digits_key(c: Column, least: int = 4, width: int = 6) -> Column:
    """The last ``width`` digits of the first token (number signs and white space part tokens) that has at least ``least`` digits, filled with zeros; null without one."""
    digits = F.transform(F.split(c, r"(?U)[#\s]+"), lambda t: F.regexp_replace(t, "[^0-9]", ""))
    run = F.get(F.filter(digits, lambda t: F.length(t) >= least), F.lit(0))
    return F.lpad(F.right(run, F.lit(width)), width, "0")


def clean_drug(c: Column) -> Column:
    """a drug string without brackets, parentheses, doses and words of form."""
    s = F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", " "), r"\([^)]*\)", " ")
    s = F.regexp_replace(F.regexp_replace(s, DOSE, " "), DOSE_IN, " ")
    s = F.regexp_replace(s, rf"(?i)\b(?:{FORM_WORDS})\b", " ")
    return F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" -,/"))


def in_parentheses(c: Column) -> Column:
    """the first text in parentheses, '' without."""
    return F.regexp_extract(c, r"\(([^)]+)\)", 1)


def clean_measure(c: Column) -> Column:
    """an outcome without the words in front of what is measured (any number of them) and without a time point at the end of its last line."""
    lead = "|".join(MEASURE_PREFIXES)
    s = F.regexp_replace(trimmed(c), rf"(?i)^(?:{lead})+", "")
    return trimmed(F.regexp_replace(F.regexp_replace(s, AT_WEEK_N, ""), AT_N_WEEKS, ""))


def drug_entries(c: Column) -> Column:
    """array<struct<brand, generic, approved>> of ``1. Brand (generic) July 20, 2011`` entries in a cell."""
    part = lambda i: F.regexp_extract_all(c, F.lit(DRUG_ENTRY), i)
    return F.transform(F.arrays_zip(part(1).alias("brand"), part(2).alias("generic"), part(3).alias("approved")), lambda x: F.struct(trimmed(x["brand"]).alias("brand"), trimmed(x["generic"]).alias("generic"), x["approved"].alias("approved")))


def generics_agree(a: Column, b: Column) -> Column:
    """whether the first word of one, lower case, is contained in the other; false where either is empty or null."""
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    first = lambda s: F.element_at(F.split(F.trim(s), r"\s+"), 1)
    return (x != "") & (y != "") & (y.contains(first(x)) | x.contains(first(y)))


def dotted_code(c: Column) -> Column:
    """a dot after the third character of codes longer than that."""
    return F.when(F.length(c) <= 3, c).otherwise(F.concat(F.substring(c, 1, 3), F.lit("."), F.substring(c, F.lit(4), F.length(c))))


def last_segment(c: Column) -> Column:
    """F16: what follows the last slash, slashes at the end aside."""
    return F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1)


def iri_to_curie(c: Column) -> Column:
    """last segment with colons for underscores."""
    return F.replace(last_segment(c), F.lit("_"), F.lit(":"))


def instrument_version(c: Column) -> Column:
    """the number after V or Version, '' without."""
    return F.regexp_extract(c, r"(?i)\bV(?:ersion)?\s*(\d+(?:\.\d+)?)\b", 1)


def axes(c: Column) -> dict[str, Column]:
    """the text that shows each axis in a definition, '' where none does."""
    return {name: F.regexp_extract(c, f"(?i){pattern}", 0) for name, pattern in AXES.items()}


def first_of(c: Column) -> Column:
    """the first element of an array, '' without."""
    return F.coalesce(F.get(c, F.lit(0)), F.lit(""))


def joined(c: Column) -> Column:
    """an array as a cell of values between bars."""
    return F.array_join(c, "|")


def listed(c: Column) -> Column:
    """The values of a cell between bars, empty ones dropped; null and '' give an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")


def combination_key(names: Column, ids: Column) -> Column:
    """struct<names, ids> of a combination, parts in the order of their lower-case names, joined by slashes."""
    parts = F.array_sort(F.transform(F.arrays_zip(names.alias("n"), ids.alias("i")), lambda x: F.struct(F.lower(x["n"]).alias("k"), x["n"].alias("n"), x["i"].alias("i"))))
    return F.struct(F.array_join(F.transform(parts, lambda x: x["n"]), "/").alias("names"), F.array_join(F.transform(parts, lambda x: x["i"]), "/").alias("ids"))


def safe_name(c: Column) -> Column:
    """runs of anything but ASCII letters and digits as an underscore."""
    return F.regexp_replace(c, "[^A-Za-z0-9]+", "_")


def without_tags(c: Column) -> Column:
    """HTML tags gone, white space single."""
    return squeeze(F.regexp_replace(c, "<[^>]*>", " "))


def bare_id(c: Column, prefix: str) -> Column:
    """an id without its prefix."""
    return F.regexp_replace(c, f"^{prefix}:", "")


def prefixed_id(c: Column, prefix: str) -> Column:
    """an id with its prefix."""
    return F.when(c.startswith(prefix + ":"), c).otherwise(F.concat(F.lit(prefix + ":"), c))


def iso_date(c: Column) -> Column:
    """The date in the first ten characters, null where they are none."""
    return F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def long_date(c: Column) -> Column:
    """A date such as July 20, 2011."""
    return F.try_to_timestamp(c, F.lit("MMMM d, yyyy")).cast("date")


def first_words(c: Column, n: int) -> Column:
    """A10: the first n words of a text, lower case, joined by spaces."""
    return F.lower(F.array_join(F.slice(F.split(squeeze(c), " "), 1, n), " "))


def group_prefix_stripped(c: Column, strip: bool = False) -> Column:
    """A10: trimmed; with ``strip`` also without a leading ``part 1:`` or ``cohort 2:``."""
    s = trimmed(c)
    return trimmed(F.regexp_replace(s, r"(?i)^(?:part|cohort)\s*\w+\s*:\s*", "")) if strip else s
