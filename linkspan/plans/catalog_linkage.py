"""Queries of trials, routes, releases and diseases over the driver's tables, and SQL that gives the same rows.

Orders stand in for trials, their lines for outcomes and interventions, suppliers for genes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import uses_instrument
from ..operators import dedup, facets, genes, hierarchy, link, resolve, setops, usage
from ..session import table
from ..sources import files
from .catalog import _EDGES, _hierarchies
from .registry import query

# ---- trials -------------------------------------------------------------------------------------------------------------
_LINES = """
    WITH lines AS (SELECT 'NCT' || lpad(l_orderkey::VARCHAR, 8, '0') AS nct_id, 'Customer ' || o_custkey AS sponsor, o_orderpriority AS priority, p_name AS drug, p_type, l_returnflag AS flag,
                          'Change in ' || p_name || ' ' || p_type AS measure FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("Customer "), "o_custkey").alias("sponsor"), F.col("o_orderpriority").alias("priority"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("flag")).join(orders, "l_orderkey").join(part, "l_partkey")
    return rows.select(F.concat(F.lit("NCT"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")).alias("nct_id"), "sponsor", "priority", "flag", "p_name", "p_type", F.concat_ws(" ", F.lit("Change in"), "p_name", "p_type").alias("measure"))


def _trials(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of lines returned (R) are primary, not yet returned (N) secondary, the others other; STANDARD parts are drugs, SMALL ones biologicals."""
    measures = lambda flag: F.collect_list(F.when(F.col("flag") == flag, F.struct("measure")))
    kind = F.when(F.col("p_type") == "STANDARD", "DRUG").when(F.col("p_type") == "SMALL", "BIOLOGICAL").otherwise("DEVICE")
    return _lines(spark, d).groupBy("nct_id", "sponsor", "priority").agg(
        measures("R").alias("primary_outcomes"), measures("N").alias("secondary_outcomes"), measures("A").alias("other_outcomes"), F.collect_list(F.struct(kind.alias("type"), F.col("p_name").alias("name"))).alias("interventions")
    ).select("*", F.col("nct_id").alias("title"), F.lit("DONE").alias("status"), F.array(F.when(F.col("priority") == "1-URGENT", "PHASE3").when(F.col("priority") == "2-HIGH", "PHASE2").otherwise("PHASE1")).alias("phases"), F.lit("1996-01-01").alias("start_date"), F.array("priority").alias("conditions"))


@query(_LINES + " SELECT nct_id, CASE flag WHEN 'R' THEN 'primary' ELSE 'secondary' END AS kind, measure FROM lines WHERE flag IN ('R', 'N')")
def outcome_stream(spark, d):
    """R17."""
    return usage.outcomes(_trials(spark, d))


_SCALES = ("ring", "Widget small", "red widget large", "Change", "nothing at all")


@query(_LINES + f""", i(instrument) AS (VALUES {", ".join(f"('{s}')" for s in _SCALES)}),
    u AS (SELECT instrument, nct_id, any_value(sponsor) AS sponsor, bool_or(flag = 'R') AS pri FROM lines JOIN i ON contains(lower(measure), lower(instrument)) WHERE flag IN ('R', 'N') GROUP BY 1, 2),
    s AS (SELECT instrument, sponsor, count(*) AS n, min(nct_id) AS f FROM u GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY n DESC, f) AS r FROM s)
    SELECT i.instrument, count(nct_id) AS trials, count(*) FILTER (pri) AS as_primary, count(*) FILTER (NOT pri) AS secondary_only,
           coalesce((SELECT string_agg(sponsor || '(' || n || ')', '|' ORDER BY r) FROM k WHERE k.instrument = i.instrument AND r <= 3), '') AS top_sponsors,
           CASE WHEN count(nct_id) > 0 THEN 'OK' ELSE 'NO_TRIALS' END AS status FROM i LEFT JOIN u USING (instrument) GROUP BY 1""")
def instrument_usage(spark, d):
    """R16, P08, A03 to A05, O06, O07."""
    named = spark.range(1).select(F.explode(F.array(*map(F.lit, _SCALES))).alias("instrument"))
    return usage.usage(named, usage.using(_trials(spark, d), named))


@query(_LINES + " SELECT DISTINCT nct_id FROM lines WHERE contains(lower(measure), 'red widget')")
def any_outcome(spark, d):
    """Trials with a term in any of three kinds of outcomes."""
    t = _trials(spark, d)
    return t.where(uses_instrument(F.col("primary_outcomes"), F.col("secondary_outcomes"), F.col("other_outcomes"), F.lit("Red Widget "))).select("nct_id")


@query(_LINES + """SELECT nct_id, CASE priority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS phase_rank, count(*) FILTER (flag = 'R') AS n_primary, count(*) FILTER (flag = 'N') AS n_secondary
           FROM lines GROUP BY nct_id, priority HAVING bool_or(contains(lower(drug), 'ring'))""")
def trials_of_drug(spark, d):
    """R15, O05."""
    return usage.drugs_of(_trials(spark, d), "Ring").select("nct_id", "phase_rank", F.size("primary").cast("long").alias("n_primary"), F.size("secondary").cast("long").alias("n_secondary"))


@query(_LINES + """, i(instrument) AS (VALUES ('ring'), ('widget')),
    t AS (SELECT DISTINCT instrument, nct_id FROM lines JOIN i ON contains(lower(measure), instrument)),
    g AS (SELECT DISTINCT nct_id, drug FROM lines WHERE p_type IN ('STANDARD', 'SMALL') AND NOT contains(drug, 'green'))
    SELECT instrument, upper(drug) AS drug, 'X' || length(drug) || drug AS key_ids, count(*) AS trials FROM t JOIN g USING (nct_id) WHERE NOT contains(drug, 'red') GROUP BY 1, drug""")
def cooccurring_drugs(spark, d):
    """Canonical drugs of the trials of an instrument, approved ones only, each once a trial."""
    named = spark.range(1).select(F.explode(F.array(F.lit("ring"), F.lit("widget"))).alias("instrument"))
    key = F.concat(F.lit("X"), F.length("p_name"), "p_name")
    items = table(spark, d, "part").select("p_name").distinct()
    resolved = items.where("not contains(p_name, 'green')").select(F.col("p_name").alias("item"), F.upper("p_name").alias("key_names"), key.alias("key_ids"))
    approved = items.select(key.alias("key_ids"), (~F.col("p_name").contains("red")).alias("approved"))
    return usage.cooccurring_drugs(_trials(spark, d), named, resolved, approved).drop("in_vocabulary")


@query(_LINES + """, c AS (SELECT nct_id, flag, CASE WHEN p_type = 'ECONOMY' THEN 'Adverse events of ' || drug ELSE drug || ' ' || p_type END AS clean FROM lines WHERE flag IN ('R', 'N')),
    m AS (SELECT *, CASE WHEN regexp_matches(clean, '\\bring\\b') THEN 0 WHEN regexp_matches(clean, '\\bwidget\\b') AND NOT contains(clean, 'Adverse event') THEN 1 END AS list_rank FROM c),
    n AS (SELECT *, CASE list_rank WHEN 0 THEN 'Ring scale (RING)' WHEN 1 THEN 'Widget index (widget)' ELSE clean END AS instrument FROM m)
    SELECT instrument, CASE any_value(list_rank) WHEN 0 THEN 'qualified' WHEN 1 THEN 'listed' ELSE 'other' END AS category, count(DISTINCT nct_id) FILTER (flag = 'R') AS as_primary, count(DISTINCT nct_id) FILTER (flag = 'N') AS as_secondary,
           count(DISTINCT nct_id) AS trials, count(DISTINCT clean) FILTER (clean <> instrument) AS n_variants, coalesce(string_agg(DISTINCT clean, '|' ORDER BY clean) FILTER (clean <> instrument), '') AS variants FROM n GROUP BY 1""")
def canonical_measures(spark, d):
    """The first list that names a measure wins; safety outcomes meet the first list only."""
    lists = spark.createDataFrame([("Ring scale (RING)", "qualified", 0, 0), ("Widget index (widget)", "listed", 1, 1), ("Late (ring)", "listed", 1, 0)], "label string, category string, list_rank int, _ord int")
    drug = F.regexp_replace("measure", "^Change in ", "")
    stream = usage.outcomes(_trials(spark, d)).withColumn("measure", F.when(drug.endswith(" ECONOMY"), F.concat(F.lit("Number of Adverse events of "), F.regexp_replace(drug, " ECONOMY$", ""), F.lit(" at week 3"))).otherwise(F.col("measure")))
    found = usage.canonical_measures(stream, lists)
    return usage.ranked_measures(found).drop("list_rank").withColumn("variants", F.array_join("variants", "|"))


# ---- routes and approvals -----------------------------------------------------------------------------------------------
@query("""WITH a AS (SELECT l_partkey AS appl, min(l_shipdate)::DATE AS approved FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1),
           t(condition, term, o) AS (VALUES ('red', 'zzzzz', 0), ('red', 'red', 1), ('red', 'economy', 2), ('wide', 'large', 0))
           SELECT condition, appl::VARCHAR AS appl, arg_min(term, o) AS term, any_value(approved) AS approved FROM a JOIN part ON p_partkey = appl
           JOIN t ON CASE WHEN length(term) <= 4 THEN regexp_matches(lower(p_name || ' of ' || p_type), '\\b' || term || '\\b') ELSE contains(lower(p_name || ' of ' || p_type), term) END
           WHERE approved >= DATE '1997-06-01' GROUP BY 1, 2""")
def approvals_since(spark, d):
    """The first term of a condition that stands in the indication of an item approved since a date."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("ApplNo"), F.when(F.col("l_returnflag") == "R", "ORIG").otherwise("SUPPL").alias("SubmissionType"), F.when(F.col("l_linestatus") == "F", "AP").otherwise("TA").alias("SubmissionStatus"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("SubmissionStatusDate"))
    items = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("appl"), F.concat_ws(" of ", "p_name", "p_type").alias("indication_text"))
    terms = spark.createDataFrame([("red", "zzzzz", 0), ("red", "red", 1), ("red", "economy", 2), ("wide", "large", 0)], "condition string, term string, _ord int")
    return link.approved_since(items, link.original_approvals(lines), terms, "1997-06-01")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS fact FROM orders WHERE o_orderstatus = 'P')
           SELECT c_custkey AS custkey, fact, CASE WHEN fact IS NULL THEN 'NO_MAY_TREAT' ELSE 'OK' END AS status FROM customer LEFT JOIN f ON k = c_custkey""")
def key_status(spark, d):
    """A miss is a row with a status of its own."""
    facts = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("fact"))
    return link.key_status(table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), facts, "custkey", "NO_MAY_TREAT")


@query("""WITH p AS (SELECT p_brand AS rxcui, p_type AS part FROM part WHERE p_brand < 'Brand#2' GROUP BY 1, 2)
           SELECT DISTINCT o.p_partkey AS partkey, coalesce(p.part, o.p_brand) AS rxcui FROM part o LEFT JOIN p ON p.rxcui = o.p_brand""")
def ingredient_ids(spark, d):
    """J15."""
    part = table(spark, d, "part")
    parts = part.where("p_brand < 'Brand#2'").select(F.col("p_brand").alias("rxcui"), F.col("p_type").alias("ingredient_rxcui")).distinct()
    return link.ingredient_ids(part.select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("rxcui")), parts)


_STRING = "CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' 20 mg tablet' WHEN 2 THEN 'qqqq ' || p_partkey || ' (' || p_name || ')' WHEN 3 THEN 'placebo ' || p_partkey WHEN 4 THEN 'unheard of ' || p_partkey WHEN 5 THEN p_name || 'x' ELSE '' END"


@query(f"""WITH n AS (SELECT p_name, min(p_brand) AS id FROM part GROUP BY 1), s AS (SELECT DISTINCT {_STRING} AS item, p_partkey % 7 AS k, CASE WHEN p_partkey % 7 IN (0, 1, 2, 5) THEN p_name END AS p_name FROM part)
            SELECT item, CASE WHEN k IN (3, 6) THEN 'UNRESOLVED_NOT_A_DRUG' WHEN k = 4 THEN 'UNRESOLVED_NOT_IN_RXNORM' ELSE 'RESOLVED' END AS status,
                   CASE k WHEN 0 THEN 'exact_raw' WHEN 1 THEN 'exact_clean' WHEN 2 THEN 'parenthetical' WHEN 5 THEN CASE WHEN 1 <= (1 - 0.85::DOUBLE) * (length(p_name) + 1) THEN 'approximate' END END AS match_step,
                   id AS rxcui, id || '1/' || id || '2' AS key_ids FROM s LEFT JOIN n USING (p_name)""")
def item_strings(spark, d):
    """Exact, cleaned, approximate and parenthetical names, with ingredients."""
    part = table(spark, d, "part")
    names = part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("rxcui"))
    brands = part.select(F.col("p_brand").alias("rxcui")).distinct()
    parts = brands.select("rxcui", F.explode(F.array(F.lit("2"), F.lit("1"))).alias("n")).select("rxcui", F.concat("rxcui", "n").alias("ingredient_rxcui"), F.concat(F.lit("Part "), "n").alias("ingredient"))
    return resolve.resolve_items(part.select(F.expr(_STRING).alias("item")), names, parts).select("item", "status", "match_step", "rxcui", "key_ids")


# ---- releases -----------------------------------------------------------------------------------------------------------
_REL = """
    WITH rel AS (SELECT 'P' || l_partkey AS child, 'S' || l_suppkey AS parent, l_linestatus = 'F' AS active, l_returnflag <> 'A' AS isa FROM lineitem)"""


def _relationships(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("sourceId"), F.concat(F.lit("S"), "l_suppkey").alias("destinationId"),
        F.when(F.col("l_linestatus") == "F", "1").otherwise("0").alias("active"), F.when(F.col("l_returnflag") != "A", files.ISA).otherwise("7").alias("typeId"),
    )


@query(_REL + """, e AS (SELECT DISTINCT child, parent FROM rel WHERE active AND isa)
    SELECT child AS code, string_agg(parent, '|' ORDER BY parent) AS parents, '' AS children FROM e GROUP BY 1 UNION ALL SELECT parent, '', string_agg(child, '|' ORDER BY child) FROM e GROUP BY 1""")
def release_index(spark, d):
    """S09, S11."""
    edges = files.isa_edges(_relationships(spark, d))
    names = edges.select(F.col("child").alias("code"), F.col("child").alias("name")).distinct()
    return files.node_index(edges, names).select("code", F.array_join("parents", "|").alias("parents"), F.array_join("children", "|").alias("children"))


@query(_REL + " SELECT DISTINCT child AS code FROM rel WHERE active AND NOT isa")
def defined_codes(spark, d):
    """S12."""
    return files.defined_codes(_relationships(spark, d)).select("code")


@query("""WITH a AS (SELECT 'A' || l_orderkey || '-' || l_linenumber AS aui, 'C' || l_partkey AS code FROM lineitem), t AS (SELECT 'A' || l_orderkey || '-' || l_linenumber AS aui, 'A' || l_orderkey || '-' || (l_linenumber - 1) AS paui FROM lineitem),
           f AS (SELECT aui, min(code) AS code FROM a GROUP BY 1)
           SELECT DISTINCT c.code AS child, p.code AS parent FROM t JOIN f c ON c.aui = t.aui JOIN f p ON p.aui = t.paui WHERE c.code <> p.code""")
def atom_edges(spark, d):
    """Edges of atoms as edges of codes."""
    lines = table(spark, d, "lineitem")
    aui = lambda n: F.concat(F.lit("A"), "l_orderkey", F.lit("-"), n)
    code = F.concat(F.lit("C"), "l_partkey")
    atoms = lines.select(aui(F.col("l_linenumber")).alias("aui"), code.alias("code"), code.alias("_ord"))
    tree = lines.select(aui(F.col("l_linenumber")).alias("aui"), aui(F.col("l_linenumber") - 1).alias("paui"), F.lit("X").alias("sab"))
    return files.edges_from_atoms(tree, atoms).select("child", "parent")


@query("""SELECT p_type AS cui, arg_min(p_brand, p_partkey) AS first_code, (SELECT string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) FROM part q WHERE q.p_type = p.p_type AND q.p_size > 45) AS codes FROM part p WHERE p_size > 45 GROUP BY 1""")
def concept_codes(spark, d):
    """S05, S06, W01."""
    atoms = table(spark, d, "part").select(F.col("p_type").alias("cui"), F.when(F.col("p_size") > 45, "BIG").otherwise("ANY").alias("sab"), F.col("p_brand").alias("code"), F.col("p_partkey").alias("_ord"))
    first = files.first_codes(atoms).where("sab = 'BIG'").select("cui", F.col("code").alias("first_code"))
    return first.join(files.all_codes(atoms, "BIG"), "cui").select("cui", "first_code", F.array_join("codes", "|").alias("codes"))


@query("""SELECT p_brand AS code, count(*) FILTER (p_size % 10 > 1) AS n_items, bool_or(p_size % 10 = 0) AS has_total_score FROM part GROUP BY 1""")
def codelists(spark, d):
    """S30."""
    k = F.col("p_size") % 10
    name = F.concat(F.lit("Q"), "p_partkey", F.when(k == 0, " Total Score").when(k == 1, " Test Code Terminology").otherwise(" item"))
    items = files.codelist_items(table(spark, d, "part").select(F.col("p_brand").alias("code"), name.alias("name")))
    return items.select("code", F.size("items").cast("long").alias("n_items"), "has_total_score")


@query("""SELECT o_custkey AS code, coalesce(arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'P'), arg_min(o_orderpriority, o_orderkey)) AS definition FROM orders GROUP BY 1""")
def definitions(spark, d):
    """The preferred source's definition, else the first of any."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("definition"), F.col("o_orderkey").alias("_ord"), F.col("o_orderstatus").alias("source"))
    pick = dedup.first_match(o.withColumn("list_rank", F.when(F.col("source") == "P", 0).otherwise(1)), ["code"], "definition", "list_rank")
    return pick.select("code", "definition")


# ---- diseases and genes -------------------------------------------------------------------------------------------------
@query("""SELECT l_orderkey AS orpha_id, arg_min(s_name, (l_linenumber, s_name)) AS symbol FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 AND l_partkey % 3 <> 0 GROUP BY 1""")
def gene_chain(spark, d):
    """The first step of a chain that ends at an approved gene."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orpha_id"), F.col("l_linenumber").alias("_ord"), F.concat_ws(":", "l_partkey", "l_suppkey").alias("omim_id"), "l_partkey", "l_suppkey")
    to_gene = lines.where("l_partkey % 3 <> 0").select("omim_id", F.col("l_suppkey").alias("gene_id")).distinct()
    hgnc = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entrez_id"), F.col("s_name").alias("symbol"))
    return genes.omim_chain(lines.select("orpha_id", "omim_id", "_ord"), to_gene, hgnc)


@query("""WITH own AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS symbol FROM orders WHERE o_orderstatus = 'P')
           SELECT 'N' || c_nationkey AS orpha_id, symbol FROM own JOIN customer ON c_custkey = c UNION SELECT 'C' || c, symbol FROM own""")
def gene_family(spark, d):
    """A nation's genes are its customers'."""
    parents = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("child"), F.concat(F.lit("N"), "c_nationkey").alias("parent"))
    rows = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("C"), "o_custkey").alias("orpha_id"), F.col("o_orderpriority").alias("symbol"), F.lit(sorted(genes.CAUSATIVE)[0]).alias("assoc_type"), F.col("o_orderkey").alias("_ord"))
    return genes.gene_family(parents, genes.genes_of(rows, None, True))


_TYPE = "CASE c_custkey % 7 WHEN 0 THEN 'Disease' WHEN 1 THEN 'Etiological subtype' WHEN 2 THEN 'Clinical syndrome' WHEN 3 THEN 'Clinical group' WHEN 4 THEN 'Biological anomaly' WHEN 5 THEN 'Unlisted' END"


@query(f"""WITH g AS (SELECT 'c' || o_custkey AS id, 'G' || substr(o_orderpriority, 1, 1) AS sym, o_orderstatus = 'P' AS causal, min(o_orderkey) AS o FROM orders GROUP BY 1, 2, 3),
            cs AS (SELECT id, sym, o FROM g WHERE causal), a AS (SELECT id, sym, min(o) AS o FROM g GROUP BY 1, 2),
            d AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'about G3' ELSE 'plain' END AS name, {_TYPE} AS kind, c_custkey AS k FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name, 'Disease', NULL FROM nation),
            up AS (SELECT 'n' || c_nationkey AS id, sym FROM cs JOIN customer ON cs.id = 'c' || c_custkey), f AS (FROM up UNION SELECT id, sym FROM cs),
            diverse AS (SELECT id FROM up GROUP BY 1 HAVING count(DISTINCT sym) > 3),
            dl AS (SELECT id, list(sym ORDER BY o) AS direct FROM cs GROUP BY 1), al AS (SELECT id, list(sym ORDER BY o) AS any_ FROM a GROUP BY 1), fl AS (SELECT id, list(sym ORDER BY sym) AS fam FROM f GROUP BY 1),
            c AS (SELECT d.*, direct, any_, fam, CASE WHEN k % 4 = 0 THEN ['Z'] END AS chain, CASE kind WHEN 'Disease' THEN CASE WHEN diverse.id IS NULL THEN 'MONOGENIC' ELSE 'HETEROGENEOUS' END WHEN 'Etiological subtype' THEN 'PHENOCOPY'
                  WHEN 'Clinical syndrome' THEN 'SYNDROMIC' WHEN 'Clinical group' THEN 'HETEROGENEOUS' WHEN 'Biological anomaly' THEN 'PATHWAY_DISORDER' ELSE 'UNKNOWN' END AS class FROM d LEFT JOIN dl USING (id) LEFT JOIN al USING (id) LEFT JOIN fl USING (id) LEFT JOIN diverse USING (id)),
            s AS (SELECT *, coalesce(CASE class WHEN 'MONOGENIC' THEN coalesce(direct[1:1], chain) WHEN 'PHENOCOPY' THEN coalesce(direct, chain) WHEN 'SYNDROMIC' THEN coalesce(any_, chain) WHEN 'UNKNOWN' THEN NULL ELSE fam END, []) AS gs FROM c),
            p AS (SELECT *, CASE WHEN class = 'MONOGENIC' OR class = 'PHENOCOPY' AND len(gs) = 1 THEN gs[1] END AS primary_gene,
                  CASE WHEN len(gs) = 0 THEN 'NONE' WHEN k % 3 <> 0 AND list_contains(gs, 'G1') AND k % 5 = 0 THEN 'CONFIRMED' WHEN k % 3 <> 0 AND list_contains(gs, 'G2') AND k % 5 = 1 THEN 'HIGH' ELSE 'LOW' END AS told FROM s),
            q AS (SELECT *, CASE WHEN told = 'LOW' AND primary_gene = 'G3' AND name = 'about G3' THEN 'CONFIRMED' ELSE told END AS gene_confidence FROM p)
            SELECT id AS orpha_id, class AS disease_class, array_to_string(gs, '|') AS genes, primary_gene, gene_confidence,
                   CASE WHEN class = 'MONOGENIC' AND len(direct) > 1 THEN 'CONFLICT_DETECTED' WHEN len(gs) > 0 AND gene_confidence IN ('CONFIRMED', 'HIGH') THEN 'RESOLVED' WHEN len(gs) > 0 THEN 'HIGH_CONFIDENCE'
                        WHEN class IN ('HETEROGENEOUS', 'PATHWAY_DISORDER') THEN 'MODERATE_CONFIDENCE' ELSE 'GENE_NOT_RESOLVED' END AS resolution_status,
                   gene_confidence IN ('CONFIRMED', 'HIGH') OR gene_confidence = 'LOW' AND class IN ('MONOGENIC', 'HETEROGENEOUS', 'PATHWAY_DISORDER') AS gene_identified, class IN ('HETEROGENEOUS', 'PATHWAY_DISORDER') AND len(gs) > 1 AS is_polygenic FROM q""")
def disease_genes(spark, d):
    """Customers and nations as diseases, order priorities as genes."""
    k = F.col("c_custkey")
    customer, cid = table(spark, d, "customer"), F.concat(F.lit("c"), "c_custkey")
    sick = customer.select(cid.alias("orpha_id"), F.when(k % 2 == 0, "about G3").otherwise("plain").alias("name"), F.expr(_TYPE).alias("disorder_type"))
    sick = sick.union(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.lit("Disease")))
    parents = customer.select(cid.alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    found = table(spark, d, "orders")
    symbol = F.concat(F.lit("G"), F.substring("o_orderpriority", 1, 1))
    listed = found.select(F.concat(F.lit("c"), "o_custkey").alias("orpha_id"), symbol.alias("symbol"), F.when(F.col("o_orderstatus") == "P", genes.CAUSATIVE[0]).otherwise("Role in the phenotype of").alias("assoc_type"), F.col("o_orderkey").alias("_ord"))
    chain = customer.where("c_custkey % 4 = 0").select(cid.alias("orpha_id"), F.lit("Z").alias("symbol"))
    mondo = customer.where("c_custkey % 3 <> 0").select(cid.alias("orpha_id"), F.col("c_custkey").cast("string").alias("mondo_id"))
    classed = customer.where("c_custkey % 5 < 2").select(F.col("c_custkey").cast("string").alias("mondo_id"), F.when(k % 5 == 0, "G1").otherwise("G2").alias("symbol"), F.when(k % 5 == 0, "Definitive").otherwise("Strong").alias("classification"), F.lit(0).alias("_ord"))
    out = genes.resolve_diseases(sick, parents, listed, None, chain, mondo, classed)
    return out.select("orpha_id", "disease_class", F.array_join("gene_set", "|").alias("genes"), "primary_gene", "gene_confidence", "resolution_status", "gene_identified", "is_polygenic")


# ---- neighbours, sets, totals -------------------------------------------------------------------------------------------
@query(_EDGES + """,
    v AS (SELECT a, b, relation, count(*) AS n, min(CASE sab WHEN 'GEO' THEN 0 WHEN 'SUP' THEN 1 ELSE 2 END) AS f FROM rel WHERE relation <> 'NO_HIERARCHY' AND a <> b GROUP BY 1, 2, 3),
    w AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, relation = 'UNRELATED', CASE relation WHEN 'PARENT' THEN 1 WHEN 'CHILD' THEN 1 WHEN 'SIBLING' THEN 2 WHEN 'UNRELATED' THEN 9 ELSE 3 END, f) AS r FROM v)
    SELECT a, b, relation, n::INT AS n_agreeing, 'of ' || b AS condition FROM w WHERE r = 1 AND relation <> 'UNRELATED' AND a LIKE 'N%' AND b LIKE 'N1%'""")
def catalog_neighbours(spark, d):
    """J08, P16, O03."""
    edges, codes, _, defined, order = _hierarchies(spark, d)
    nodes = codes.select("cui").distinct()
    wanted = nodes.where("cui like 'N1%'").select("cui", F.concat(F.lit("of "), "cui").alias("condition"))
    lines = hierarchy.closure(edges, codes.where("cui like 'N%'").select("sab", F.col("code").alias("node")))
    near = hierarchy.neighbours(nodes.where("cui like 'N%'"), wanted, codes, edges, lines, order, defined, ("CUS",))
    return near.select("a", "b", "relation", "n_agreeing", "condition")


@query("SELECT 'customer' AS origin, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def flagged_union(spark, d):
    """Two sources one after another, with totals."""
    rows = setops.with_flag("origin", customer=table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), supplier=table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))
    return rows.groupBy("origin", "k").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS custkey, bool_or(o_orderstatus = 'P') AS qualified, count(*) AS n FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'P') OR max(o_totalprice) > 450000""")
def shown_blocks(spark, d):
    """Qualified blocks, and others that some trial used."""
    trials = F.when(F.col("o_totalprice") > 450000, 1).otherwise(0)
    blocks = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("qualified"), F.collect_list(F.struct(trials.alias("trials"))).alias("instruments"))
    return usage.shown(blocks).select("custkey", "qualified", F.size("instruments").cast("long").alias("n"))


@query("""WITH i AS (SELECT c_custkey AS custkey, lpad(right(CASE WHEN c_custkey % 2 = 0 THEN '2016' ELSE '' END || lpad(c_custkey::VARCHAR, 6, '0'), 6), 6, '0') AS k FROM customer),
           o AS (SELECT CASE WHEN length(o_custkey::VARCHAR) < 6 THEN lpad(o_custkey::VARCHAR, 6, '0') ELSE o_custkey::VARCHAR END AS k, o_orderkey AS document FROM orders WHERE o_orderstatus = 'P')
           SELECT custkey, document FROM i LEFT JOIN o USING (k)""")
def numbered_documents(spark, d):
    """Documents of the number in an entry's name."""
    name = F.concat(F.lit("DDT#COA v12 "), F.when(F.col("c_custkey") % 2 == 0, "2016-").otherwise(""), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(": Scale 36"))
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), name.alias("item"))
    documents = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("number"), F.col("o_orderkey").alias("document"))
    return link.by_number(items, documents, "item", "number").select("custkey", "document")


@query("SELECT l_suppkey AS suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def id_set_union(spark, d):
    """U07."""
    return setops.id_set_union(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("suppkey"), "l_orderkey"), ["suppkey"], "l_orderkey")


@query("""WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS r FROM lineitem) SELECT l_orderkey AS orderkey, l_partkey AS claimant FROM r WHERE r = 1""")
def claimed_once(spark, d):
    """The first part claims an order."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("claimant"))
    return dedup.claimed_once(rows, "orderkey", ["claimant"]).select("orderkey", "claimant")


@query("""SELECT count(DISTINCT p_brand) FILTER (p_size > 10) AS concepts, count(DISTINCT p_name) FILTER (p_size BETWEEN 4 AND 10) AS names, count(*) FILTER (p_size <= 3) AS neither,
                  count(DISTINCT p_brand) FILTER (p_size > 10) + count(DISTINCT p_name) FILTER (p_size BETWEEN 4 AND 10) + count(*) FILTER (p_size <= 3) AS size FROM part""")
def catalog_size(spark, d):
    """A09."""
    size = F.col("p_size")
    return link.catalog_size(table(spark, d, "part").select(F.when(size > 10, F.col("p_brand")).otherwise("").alias("cui"), F.when(size > 3, F.col("p_name")).otherwise("").alias("norm")))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 12")
def most_frequent(spark, d):
    """A top-k report."""
    return facets.largest_groups(table(spark, d, "part").select("p_name"), "p_name", 12)


@query("""SELECT lower(p_type) AS norm, count(*) AS n FROM part WHERE lower(p_type) IN ('large', 'small') GROUP BY 1""")
def registry_population(spark, d):
    """How often conditions of trials are a normal form."""
    trials = table(spark, d, "part").select(F.array("p_type").alias("conditions"))
    norms = spark.range(1).select(F.explode(F.array(F.lit("large"), F.lit("small"), F.lit("unheard"))).alias("norm"))
    return resolve.registry_population(norms, trials, 2).select("norm", F.col("n_mentions").alias("n"))
