"""Queries of text functions and predicates over strings made of the driver's columns, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display
from ..functions import predicates as P
from ..functions import text as X
from ..operators import link
from ..session import table
from .registry import query

_NORM = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '\s*\([^)]*\)', ' ', 'g')), '[^a-z0-9\-''\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_SHOWN = "p_brand || '  (' || p_type || ') -' || p_name || '''s, No.' || p_size"


@query(rf"""WITH t AS (SELECT p_partkey AS partkey, {_SHOWN} AS s FROM part)
            SELECT partkey, {_NORM.format('s')} AS normal, trim(regexp_replace(regexp_replace({_NORM.format('s')}, '[-'']', ' ', 'g'), '\s+', ' ', 'g')) AS loose,
                   trim(regexp_replace(s, '[-\s]+', ' ', 'g')) AS flat, regexp_replace(s, '[^A-Za-z0-9]+', '_', 'g') AS file_name, regexp_extract(s, '\(([^)]+)\)', 1) AS inner_text FROM t""")
def normal_forms(spark, d):
    """F01, F02, F08, F10, F22."""
    s = F.concat(F.col("p_brand"), F.lit("  ("), F.col("p_type"), F.lit(") -"), F.col("p_name"), F.lit("'s, No."), F.col("p_size"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), s.alias("s"))
    t = F.col("s")
    return rows.select("partkey", X.normalize(t).alias("normal"), X.normalize_loose(t).alias("loose"), X.flat_spaces(t).alias("flat"), X.safe_name(t).alias("file_name"), X.in_parentheses(t).alias("inner_text"))


@query(r"""WITH t AS (SELECT c_custkey AS custkey, c_name, 'C' || c_custkey AS code, 'http://example.org/obo/MONDO_' || c_custkey || '/' AS iri FROM customer)
           SELECT custkey, nullif(regexp_extract(c_name, '([0-9]{6})', 1), '') AS six, regexp_extract(c_name, '([0-9]{6}|[0-9]{4}-[0-9]+)', 1) AS number,
                  CASE WHEN length(code) <= 3 THEN code ELSE substr(code, 1, 3) || '.' || substr(code, 4) END AS dotted, 'MONDO_' || custkey AS segment, 'MONDO:' || custkey AS curie,
                  custkey::VARCHAR AS bare, 'MONDO:' || custkey AS prefixed, regexp_matches(code, '^[DC]') AS disease, custkey % 2 = 1 AS trial FROM t""")
def code_forms(spark, d):
    """F05, F06, F14, F15, F16, F23, P07, P19."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", F.concat(F.lit("C"), "c_custkey").alias("code"), F.concat(F.lit("http://example.org/obo/MONDO_"), "c_custkey", F.lit("/")).alias("iri"))
    curie = X.iri_to_curie(F.col("iri"))
    id_ = F.concat(F.lit("NCT"), F.lpad(F.col("custkey").cast("string"), (7 + F.col("custkey") % 2).cast("int"), F.lit("0")))
    return rows.select(
        "custkey", X.six_digit_key(F.col("c_name")).alias("six"), X.entry_number(F.col("c_name")).alias("number"), X.dotted_code(F.col("code")).alias("dotted"), X.last_segment(F.col("iri")).alias("segment"), curie.alias("curie"),
        X.bare_id(curie, "MONDO").alias("bare"), X.prefixed_id(X.bare_id(curie, "MONDO"), "MONDO").alias("prefixed"), P.disease_code(F.col("code")).alias("disease"), P.trial_id(id_).alias("trial"),
    )


_ITEM = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_size || ' mg Oral Tablet [' || p_brand || ']' WHEN 1 THEN 'Placebo for ' || p_name WHEN 2 THEN '2.5mg/' || p_size || 'ml ' || p_name || ' (' || p_type || ')' ELSE p_name || ' 10 units daily, high dose' END"


@query(rf"""WITH t AS (SELECT p_partkey AS partkey, p_name, {_ITEM} AS item FROM part),
            a AS (SELECT *, regexp_replace(regexp_replace(item, '\[[^\]]*\]', ' ', 'g'), '\([^)]*\)', ' ', 'g') AS x FROM t),
            b AS (SELECT *, regexp_replace(x, '(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:mg|mcg|g|ml|%|units?|iu)\b', ' ', 'g') AS y FROM a),
            c AS (SELECT *, regexp_replace(y, '(?i)\b(?:oral|tablet|daily|dose|high)\b', ' ', 'g') AS z FROM b)
            SELECT partkey, trim(regexp_replace(z, '\s+', ' ', 'g'), ' -,/') AS clean, partkey % 4 = 1 AS no_drug, partkey % 2 = 0 AS agree FROM c""")
def drug_strings(spark, d):
    """F07, F13, P18."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_name", F.expr(_ITEM).alias("item"))
    clean = X.clean_drug(F.col("item"))
    return rows.select("partkey", clean.alias("clean"), P.plainly_no_drug(F.col("item")).alias("no_drug"), X.generics_agree(F.col("p_name"), F.when(F.col("partkey") % 2 == 0, F.concat(F.upper("p_name"), F.lit(" salt"))).otherwise("zzz")).alias("agree"))


_CELL = "CASE WHEN p_size > 40 THEN 'under review' ELSE '1. Brand' || p_partkey || ' (' || p_name || ') July ' || (1 + p_size % 28) || ', 2011' END"


@query(r"""SELECT p_partkey::VARCHAR AS disease, CASE WHEN p_size <= 40 THEN 'Brand' || p_partkey END AS brand, CASE WHEN p_size <= 40 THEN p_name END AS generic,
                  CASE WHEN p_size <= 40 THEN 'July ' || (1 + p_size % 28) || ', 2011' END AS approved,
                  CASE WHEN p_size > 40 THEN 'NOT_A_DRUG' WHEN p_partkey % 3 = 0 THEN 'NOT_FOUND' WHEN p_partkey % 2 = 0 THEN 'OK' ELSE 'GENERIC_MISMATCH' END AS status,
                  CASE WHEN p_size <= 40 AND p_partkey % 3 <> 0 THEN 'A' || p_partkey END AS appl FROM part""")
def compendium_brands(spark, d):
    """Drugs named in the cells of a compendium, and the cells that name none."""
    part = table(spark, d, "part")
    cells = part.select(F.col("p_partkey").cast("string").alias("disease"), F.expr(_CELL).alias("drug_approval"))
    even = F.col("p_partkey") % 2 == 0
    labels = part.where("p_partkey % 3 <> 0").select(F.concat(F.lit("BRAND"), "p_partkey").alias("brand_name"), F.concat(F.lit("A"), "p_partkey").alias("ApplNo"), F.when(even, F.upper("p_name")).otherwise("zzz").alias("generic_name"))
    return link.brand_resolution(cells, labels).select("disease", "brand", "generic", "approved", "status", "appl")


_MEASURE = "CASE p_partkey % 4 WHEN 0 THEN 'Change from Baseline in ' || p_name || ' at Week ' || p_size WHEN 1 THEN 'Time to mean change in ' || p_name || ' at 12 weeks' WHEN 2 THEN 'Number of adverse events of ' || p_name ELSE p_name || ' at rest' END"


@query(rf"""WITH t AS (SELECT p_partkey AS partkey, {_MEASURE} AS m FROM part)
            SELECT partkey, regexp_replace(regexp_replace(regexp_replace(m, '(?i)^(?:change from baseline in |mean change in |time to |number of )+', ''), '(?i)\s+at\s+weeks?\s*[0-9]+.*$', ''), '(?i)\s+at\s+[0-9]+\s+weeks?.*$', '') AS clean,
                   contains(lower(m), 'adverse event') AS scaffolding FROM t""")
def measures_cleaned(spark, d):
    """F09, P13."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), F.expr(_MEASURE).alias("m"))
    return rows.select("partkey", X.clean_measure(F.col("m")).alias("clean"), P.scaffolding(F.lower("m")).alias("scaffolding"))


_ENTRY = "'Fatigue: ' || p_name || ' (A' || p_size || ') and ' || p_type || ' scale V' || (p_size % 7) || ' (B' || p_partkey || ')' || CASE WHEN p_size % 2 = 0 THEN ' in adults (AD)' ELSE '' END"


@query(rf"""WITH t AS (SELECT p_partkey AS partkey, p_size, p_name, p_type, {_ENTRY} AS e FROM part)
            SELECT partkey, p_name || '|' || p_type || ' scale V' || (p_size % 7) AS instruments,
                   'Fatigue: ' || p_name || '|and ' || p_type || ' scale V' || (p_size % 7) || CASE WHEN p_size % 2 = 0 THEN '|in adults' ELSE '' END AS units,
                   lower(trim(regexp_replace(e, '[-\s]+', ' ', 'g'))) || '|a' || p_size || '|b' || partkey || CASE WHEN p_size % 2 = 0 THEN '|ad' ELSE '' END AS aliases, (p_size % 7)::VARCHAR AS version FROM t""")
def instrument_entries(spark, d):
    """F03, F04, F11, F17, F19."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), F.expr(_ENTRY).alias("e"))
    e = F.col("e")
    return rows.select("partkey", X.joined(X.instrument_names(e)).alias("instruments"), X.joined(X.split_names(e)).alias("units"), X.joined(X.aliases(e)).alias("aliases"), X.instrument_version(e).alias("version"))


_DEFINITION = "'A ' || p_size || '-item, ' || CASE p_size % 3 WHEN 0 THEN 'Self-Report' WHEN 1 THEN 'clinician-reported' ELSE 'plain' END || ' tool with a ' || (p_size % 9) || '-point scale over the past ' || CASE WHEN p_size % 2 = 0 THEN 'week' ELSE p_size || ' days' END || CASE WHEN p_size > 30 THEN ', developed by ' || p_brand ELSE '' END"


@query(rf"""SELECT p_partkey AS partkey, p_size || '-item' AS structure, CASE p_size % 3 WHEN 0 THEN 'Self-Report' WHEN 1 THEN 'clinician-reported' ELSE '' END AS reporter, (p_size % 9) || '-point' AS scale,
                   CASE WHEN p_size % 2 = 0 THEN 'past week' ELSE 'past ' || p_size || ' days' END AS recall, CASE WHEN p_size > 30 THEN 'developed by' ELSE '' END AS developer FROM part""")
def axes_found(spark, d):
    """F18."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), F.expr(_DEFINITION).alias("text"))
    return rows.select("partkey", *[c.alias(name.lower()) for name, c in X.axes(F.col("text")).items()])


@query("""SELECT p_partkey AS partkey, contains(' ' || p_name || ' ', ' ring ') AS phrase, contains('.' || p_type || '-' || p_size || '.', '-1.') AS symbol FROM part""")
def whole_words(spark, d):
    """A phrase and a symbol as whole words only."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_name", F.concat("p_type", F.lit("-"), "p_size").alias("n"))
    return rows.select("partkey", P.phrase_in(F.lit("ring"), F.col("p_name")).alias("phrase"), P.symbol_in_name(F.lit("1"), F.col("n")).alias("symbol"))


@query("""WITH b AS (SELECT DISTINCT p_type, p_brand FROM part), l AS (SELECT p_type, list(p_brand ORDER BY p_brand) AS names FROM b GROUP BY 1),
           c AS (SELECT p_type, list_transform(names, lambda x, i: CASE WHEN i < len(names) THEN x || ',' ELSE x END) AS pieces FROM l)
           SELECT p_type, list_reduce(list_prepend('   6  ' || pieces[1], pieces[2:]), lambda acc, x: CASE WHEN length(string_split(acc, chr(10))[-1]) + 1 + length(x) > 72 THEN acc || chr(10) || '      ' || x ELSE acc || ' ' || x END) AS lines,
                  p_type || CASE WHEN p_type IN ('SMALL', 'LARGE') THEN ' [not in RxNorm]' ELSE '' END AS drug, CASE p_type WHEN 'SMALL' THEN '   [child of your search]' WHEN 'MEDIUM' THEN '   [text of your search]' ELSE '' END AS relation FROM c""")
def display_lines(spark, d):
    """lists of names in lines, and the tags of drugs and relations."""
    names = table(spark, d, "part").groupBy("p_type").agg(F.sort_array(F.collect_set("p_brand")).alias("names"))
    t = F.col("p_type")
    relation = F.when(t == "SMALL", "child").when(t == "MEDIUM", "text").when(t == "LARGE", "exact")
    return names.select("p_type", display.wrapped(F.col("names"), "   6  ").alias("lines"), display.drug_tag(t, ~t.isin("SMALL", "LARGE")).alias("drug"), display.relation_tag(relation).alias("relation"))
