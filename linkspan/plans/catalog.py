"""Queries over the driver's tables, each by the operators of this library, and SQL that gives the same rows.

Parts stand in for vocabularies (mention = name and shelf, concept = type, source = brand), customers and orders for catalogues,
line items for trials and their outcomes, nations for concepts of three hierarchies, events for logs.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as X
from ..operators import dedup, facets, hierarchy, link, quality, resolve, setops, usage
from ..session import table
from ..sources import files
from .registry import ORACLES, QUERIES  # noqa: F401
from .registry import query as _query

# ---- settling mentions --------------------------------------------------------------------------------------------------
RULES = resolve.Rules(accepted_types=("STANDARD", "SMALL", "LARGE", "MEDIUM"), consumer=tuple(f"Brand#{i}" for i in range(1, 6)), narrower=("Brand#1", "Brand#2"))

_VOTES = """
    WITH m AS (SELECT DISTINCT lower(p_name) || ' ' || (p_partkey // 200) AS query, p_type AS cui, p_brand AS sab FROM part),
    v AS (SELECT query, cui, count(DISTINCT sab) AS n, cui IN ('STANDARD','SMALL','LARGE','MEDIUM') AS typed,
                 bool_or(sab IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5')) AS consumer, bool_or(sab IN ('Brand#1','Brand#2')) AS narrower FROM m GROUP BY 1, 2),
    s AS (SELECT query, count(*) FILTER (typed) AS t, count(*) FILTER (typed AND n >= 2) AS k, count(*) FILTER (typed AND n >= 2 AND consumer) AS c,
                 count(*) FILTER (typed AND n >= 2 AND narrower) AS w, min(cui) FILTER (typed AND n >= 2) AS one,
                 min(cui) FILTER (typed AND n >= 2 AND consumer) AS by_c, min(cui) FILTER (typed AND n >= 2 AND narrower) AS by_w FROM v GROUP BY 1),
    d AS (SELECT query, CASE WHEN k = 1 THEN one WHEN k > 1 AND c = 1 THEN by_c WHEN k > 1 AND c > 1 AND w = 1 THEN by_w END AS cui,
                 CASE WHEN k > 1 AND c = 1 THEN 'consumer' WHEN k > 1 AND c > 1 AND w = 1 THEN 'narrower' END AS authority, t, k FROM s)"""


def _parts_as_vocabulary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, d, "part").select(F.concat_ws(" ", F.lower("p_name"), F.floor(F.col("p_partkey") / 200)).alias("str"), F.col("p_type").alias("cui"), F.col("p_brand").alias("sab"))
    mentions = rows.select(F.col("str").alias("query_id"), F.col("str").alias("query")).distinct()
    concepts = rows.select("cui").distinct().select("cui", F.col("cui").alias("name"), F.array("cui").alias("semantic_types"), F.lit(1).alias("atom_count"))
    return mentions, rows, concepts


@_query(_VOTES + """
    SELECT query, CASE WHEN t = 0 THEN 'NOT_A_CONDITION' WHEN k = 0 THEN 'NOT_A_CONDITION' WHEN cui IS NOT NULL THEN 'RESOLVED' ELSE 'CONFLICT_DETECTED' END AS status, cui FROM d""")
def resolve_mentions(spark, d):
    """F01, R01, R03, R04, P02, P03, A01."""
    mentions, atoms, concepts = _parts_as_vocabulary(spark, d)
    return resolve.resolve(mentions, atoms, concepts, rules=RULES).select("query", "status", "cui")


@_query(_VOTES + "\n    SELECT query, cui, authority FROM d WHERE authority IS NOT NULL")
def authority_tiebreak(spark, d):
    """R04."""
    mentions, atoms, concepts = _parts_as_vocabulary(spark, d)
    found = resolve.candidates(mentions, atoms, concepts, RULES)
    return resolve.decide(mentions, found, RULES).where("authority is not null").select("query", "cui", "authority")


@_query(_VOTES + """
    SELECT query, (row_number() OVER (PARTITION BY query ORDER BY n DESC, v.cui))::INT AS place, v.cui, n::INT AS n_support FROM v JOIN s USING (query) WHERE typed AND n >= 2 AND k > 1""")
def contest_order(spark, d):
    """The concepts that contest a mention, those of most sources first."""
    mentions, atoms, concepts = _parts_as_vocabulary(spark, d)
    found = resolve.decide(mentions, resolve.candidates(mentions, atoms, concepts, RULES), RULES)
    each = found.select("query", F.posexplode("contest").alias("at", "c"))
    return each.select("query", (F.col("at") + 1).alias("place"), F.col("c.by").alias("cui"), F.col("c.n_support").alias("n_support"))


@_query(" UNION ALL ".join(f"""
    FROM ({_VOTES.replace("n >= 2", f"n >= {k}")} SELECT {k} AS min_support, CASE WHEN t = 0 OR k = 0 THEN 'NOT_A_CONDITION' WHEN cui IS NOT NULL THEN 'RESOLVED' ELSE 'CONFLICT_DETECTED' END AS status, count(*) AS n FROM d GROUP BY 2)""" for k in (1, 2, 3)))
def rule_limits(spark, d):
    """How mentions settle as the number of sources that a concept needs is 1, 2 (the default) or 3."""
    mentions, atoms, concepts = _parts_as_vocabulary(spark, d)
    told = lambda k: resolve.resolve(mentions, atoms, concepts, rules=replace(RULES, min_support=k)).groupBy("status").agg(F.count("*").alias("n")).select(F.lit(k).alias("min_support"), "status", "n")
    return told(1).union(told(2)).union(told(3))


@_query(_VOTES + """
    SELECT query, CASE WHEN NOT typed THEN 'TYPE_REJECTED' WHEN n < 2 THEN 'SINGLE_VOCABULARY_ONLY' ELSE 'NOT_THE_LAY_MEANING' END AS reason, v.cui AS candidate
    FROM v JOIN d USING (query) WHERE NOT typed OR n < 2 OR (authority IS NOT NULL AND d.cui <> v.cui)""")
def near_miss_log(spark, d):
    """C01."""
    mentions, atoms, concepts = _parts_as_vocabulary(spark, d)
    return resolve.near_misses(mentions, resolve.candidates(mentions, atoms, concepts, RULES), RULES).select(F.col("query_id").alias("query"), "reason", "candidate")


# ---- hierarchies --------------------------------------------------------------------------------------------------------
_EDGES = """
    WITH RECURSIVE n AS (SELECT n_nationkey AS k, 'N' || n_nationkey AS code, 'R' || n_regionkey AS reg FROM nation),
    sup AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
    cus AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1),
    edges AS (
      SELECT 'GEO' AS sab, code AS child, reg AS parent FROM n UNION SELECT 'GEO', 'R' || r_regionkey, 'W' FROM region
      UNION SELECT 'SUP', code, 'S' || (n % 3) FROM n JOIN sup USING (k) UNION SELECT 'SUP', 'S' || (n % 3), 'W' FROM sup
      UNION SELECT 'CUS', code, 'C' || (n % 4) FROM n JOIN cus USING (k) UNION SELECT 'CUS', code, reg FROM n JOIN cus USING (k) WHERE n % 2 = 0),
    concepts AS (SELECT code AS cui FROM n UNION SELECT 'R' || r_regionkey FROM region UNION SELECT 'W'),
    up(sab, node, ancestor) AS (SELECT sab, child, parent FROM edges UNION SELECT u.sab, u.node, e.parent FROM up u JOIN edges e ON e.sab = u.sab AND e.child = u.ancestor),
    rel AS (
      SELECT a.cui AS a, b.cui AS b, s.sab, CASE
        WHEN a.cui = b.cui THEN 'EXACT'
        WHEN EXISTS (FROM edges e WHERE e.sab = s.sab AND e.child = a.cui AND e.parent = b.cui) THEN 'PARENT'
        WHEN EXISTS (FROM edges e WHERE e.sab = s.sab AND e.child = b.cui AND e.parent = a.cui) THEN 'CHILD'
        WHEN EXISTS (FROM edges x JOIN edges y USING (sab, parent) WHERE sab = s.sab AND x.child = a.cui AND y.child = b.cui AND (sab <> 'CUS' OR parent NOT LIKE 'C%')) THEN 'SIBLING'
        WHEN EXISTS (FROM edges x JOIN edges y USING (sab, parent) WHERE sab = s.sab AND x.child = a.cui AND y.child = b.cui) THEN 'UNRELATED'
        WHEN EXISTS (FROM up u WHERE u.sab = s.sab AND u.node = a.cui AND u.ancestor = b.cui) THEN 'ANCESTOR'
        WHEN EXISTS (FROM up u WHERE u.sab = s.sab AND u.node = b.cui AND u.ancestor = a.cui) THEN 'DESCENDANT' ELSE 'UNRELATED' END AS relation
      FROM concepts a, concepts b, (VALUES ('GEO'), ('SUP'), ('CUS')) s(sab))"""


def _hierarchies(spark: SparkSession, d: str):
    """edges, codes, pairs, defined, order: nations in regions (GEO), by suppliers (SUP) and by customers (CUS, where C nodes are undefined groupers)."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("N"), "n_nationkey").alias("code"), F.concat(F.lit("R"), "n_regionkey").alias("reg"))
    r = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("code"))
    sup = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    cus = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    edge = lambda df, sab, child, parent: df.select(F.lit(sab).alias("sab"), child.alias("child"), parent.alias("parent"))
    s3, c4 = F.concat(F.lit("S"), F.col("n") % 3), F.concat(F.lit("C"), F.col("n") % 4)
    edges = edge(n, "GEO", F.col("code"), F.col("reg")).union(edge(r, "GEO", F.col("code"), F.lit("W"))).union(edge(n.join(sup, "k"), "SUP", F.col("code"), s3)).union(edge(sup, "SUP", s3, F.lit("W")))
    edges = edges.union(edge(n.join(cus, "k"), "CUS", F.col("code"), c4)).union(edge(n.join(cus, "k").where("n % 2 = 0"), "CUS", F.col("code"), F.col("reg"))).distinct()
    concepts = n.select(F.col("code").alias("cui")).union(r).union(spark.range(1).select(F.lit("W").alias("cui")))
    sources = spark.range(3).select(F.element_at(F.array(*map(F.lit, ("GEO", "SUP", "CUS"))), (F.col("id") + 1).cast("int")).alias("sab"), F.col("id").alias("source_order"))
    codes = concepts.crossJoin(F.broadcast(sources)).select("cui", "sab", F.col("cui").alias("code"))
    # Every pair of the 31 concepts is asked about: a stated set of questions, not a search.
    pairs = concepts.select(F.col("cui").alias("a")).crossJoin(F.broadcast(concepts.select(F.col("cui").alias("b"))))
    defined = edges.where(~((F.col("sab") == "CUS") & F.col("parent").startswith("C"))).select("sab", F.col("parent").alias("code")).distinct()
    return edges, codes, pairs, defined, sources


@_query("""WITH RECURSIVE e AS (SELECT 'O' || o_orderkey AS child, 'C' || o_custkey AS parent FROM orders UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
             UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
           up(node, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT u.node, e.parent, u.depth + 1 FROM up u JOIN e ON e.child = u.ancestor)
           SELECT node, ancestor, min(depth)::INT AS depth FROM up GROUP BY 1, 2""")
def closure(spark, d):
    """H02."""
    edge = lambda t, p, c, q, o: table(spark, d, t).select(F.lit("ALL").alias("sab"), F.concat(F.lit(p), c).alias("child"), F.concat(F.lit(q), o).alias("parent"))
    edges = edge("orders", "O", "o_orderkey", "C", "o_custkey").union(edge("customer", "C", "c_custkey", "N", "c_nationkey")).union(edge("nation", "N", "n_nationkey", "R", "n_regionkey"))
    return hierarchy.closure(edges).select("node", "ancestor", "depth")


@_query("""WITH e AS (SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)
           SELECT child AS code, 'parent' AS kind, parent AS relative FROM e UNION SELECT parent, 'child', child FROM e
           UNION SELECT x.child, 'sibling', y.child FROM e x JOIN e y USING (parent) WHERE x.child <> y.child""")
def neighbourhood(spark, d):
    """H01, H04, U03."""
    e = table(spark, d, "supplier").select(F.lit("G").alias("sab"), F.concat(F.lit("S"), "s_suppkey").alias("child"), F.concat(F.lit("N"), "s_nationkey").alias("parent"))
    e = e.union(table(spark, d, "nation").select(F.lit("G").alias("sab"), F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent")))
    codes = e.select("sab", F.col("child").alias("code")).union(e.select("sab", F.col("parent").alias("code"))).distinct()
    names = codes.select("sab", "code", F.col("code").alias("name"))
    return hierarchy.neighbourhood(codes, e, names).select("code", "kind", "relative")


@_query(_EDGES + "\n    SELECT a, b, sab, relation FROM rel")
def relation_per_source(spark, d):
    """H05, H06."""
    edges, codes, pairs, defined, _ = _hierarchies(spark, d)
    return hierarchy.relation_per_source(pairs, codes, edges, hierarchy.closure(edges), defined, ("CUS",)).select("a", "b", "sab", "relation")


@_query(_EDGES + """,
    v AS (SELECT a, b, relation, count(*) AS n, min(CASE sab WHEN 'GEO' THEN 0 WHEN 'SUP' THEN 1 ELSE 2 END) AS f FROM rel WHERE relation <> 'NO_HIERARCHY' GROUP BY 1, 2, 3),
    w AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, relation = 'UNRELATED',
            CASE relation WHEN 'EXACT' THEN 0 WHEN 'PARENT' THEN 1 WHEN 'CHILD' THEN 1 WHEN 'SIBLING' THEN 2 WHEN 'UNRELATED' THEN 9 ELSE 3 END, f) AS r FROM v)
    SELECT x.cui AS a, y.cui AS b, CASE WHEN x.cui = y.cui THEN 'EXACT' ELSE coalesce(relation, 'NO_HIERARCHY') END AS relation,
           CASE WHEN x.cui = y.cui THEN 0 ELSE coalesce(n, 0) END::INT AS n_agreeing
    FROM concepts x CROSS JOIN concepts y LEFT JOIN (FROM w WHERE r = 1) w ON w.a = x.cui AND w.b = y.cui""")
def relation_vote(spark, d):
    """H07, H09."""
    edges, codes, pairs, defined, order = _hierarchies(spark, d)
    per = hierarchy.relation_per_source(pairs, codes, edges, hierarchy.closure(edges), defined, ("CUS",))
    return hierarchy.vote(pairs, per, order).select("a", "b", "relation", "n_agreeing")


@_query(_EDGES + """,
    p AS (SELECT sab, child, count(DISTINCT parent) AS n FROM edges GROUP BY 1, 2)
    SELECT c.cui, s.sab, coalesce(p.n, 0) AS n_parents, count(p.n) OVER (PARTITION BY c.cui) AS n_sources
    FROM concepts c CROSS JOIN (VALUES ('GEO'), ('SUP'), ('CUS')) s(sab) LEFT JOIN p ON p.sab = s.sab AND p.child = c.cui""")
def hierarchy_coverage(spark, d):
    """H13, J21."""
    edges, codes, _, _, _ = _hierarchies(spark, d)
    return hierarchy.coverage(codes, edges).select("cui", "sab", "n_parents", "n_sources")


# ---- linking ------------------------------------------------------------------------------------------------------------
@_query("""WITH c AS (SELECT DISTINCT right(regexp_extract(c_name, '([0-9]{4,})', 1), 6) AS key FROM customer), o AS (SELECT DISTINCT lpad(o_custkey::VARCHAR, 6, '0') AS key FROM orders)
           SELECT CASE WHEN o.key IS NULL THEN 'customers' WHEN c.key IS NULL THEN 'orders' ELSE 'customers+orders' END AS sources, count(*) AS n_keys FROM c FULL JOIN o USING (key) GROUP BY 1""")
def key_bridge(spark, d):
    """F05, J03, U02."""
    customers = table(spark, d, "customer").select(X.digits_key(F.col("c_name")).alias("key"))
    orders = table(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("key"))
    return setops.overlap_report("key", customers=customers, orders=orders)


@_query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1996 GROUP BY 1)
           SELECT c_custkey AS custkey, CASE WHEN n IS NULL THEN 'NO_COA' ELSE 'COA_FOUND' END AS status, coalesce(n, 0) AS n_items FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def catalog_lookup(spark, d):
    """J01, J02, J09, C02."""
    urgent = table(spark, d, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 1996))
    children = urgent.select(F.concat(F.lit("K"), "o_custkey").alias("condition"), "o_orderkey")
    catalog = children.select("condition").distinct().select("condition", F.substring("condition", 2, 20).alias("cui"), F.lit("").alias("norm"))
    queries = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").cast("string").alias("cui"), F.lit("").alias("normalized"))
    found = link.catalog_lookup(queries, catalog, children)
    n = F.aggregate("entries", F.lit(0), lambda a, e: a + F.size(e["items"]))
    return found.select(F.col("query_id").alias("custkey"), "status", F.coalesce(n, F.lit(0)).cast("long").alias("n_items"))


@_query("""WITH q AS (SELECT DISTINCT p_type AS query_id FROM part),
           coded AS (SELECT DISTINCT q.query_id, p.p_partkey AS item FROM q JOIN part t ON t.p_type = q.query_id AND t.p_size = 1 JOIN part p ON p.p_brand = t.p_brand),
           prose AS (SELECT q.query_id, p_partkey AS item FROM q JOIN part ON contains(lower(p_name || ' of ' || p_type), lower(q.query_id)) WHERE length(q.query_id) >= 6)
           SELECT query_id, item, string_agg(route, '+' ORDER BY route) AS routes, count(*) = 2 AS both_routes
           FROM (SELECT *, 'coded' AS route FROM coded UNION ALL SELECT *, 'prose' FROM prose) GROUP BY 1, 2""")
def two_route_link(spark, d):
    """Parts of a brand that makes the type in size 1, and parts whose description names the type."""
    part = table(spark, d, "part")
    concepts = part.select(F.col("p_type").alias("query_id"), F.col("p_type").alias("code")).distinct()
    treats = part.where("p_size = 1").select(F.col("p_type").alias("code"), F.col("p_brand").alias("id")).distinct()
    items = part.select(F.col("p_partkey").alias("item"), F.array("p_brand").alias("ids"), F.concat_ws(" of ", "p_name", "p_type").alias("text"))
    terms = concepts.select("query_id", F.col("query_id").alias("term"))
    found = link.merged_routes(coded=link.coded_route(concepts, treats, items), prose=link.text_route(terms, items))
    return found.select("query_id", "item", F.array_join("routes", "+").alias("routes"), "both_routes")


_TERMS = ("inti", "the", "blethe", "erentation", "stupid", "licensed")


@_query(f"""WITH t(term) AS (VALUES {", ".join(f"('{t}')" for t in _TERMS)})
            SELECT doc_id, term FROM documents JOIN t ON CASE WHEN length(term) <= 4 THEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || term || '($|[^\\p{{L}}\\p{{N}}_])') ELSE contains(lower(text), term) END""")
def term_match(spark, d):
    """P11, P12."""
    terms = spark.range(len(_TERMS)).select(F.element_at(F.array(*map(F.lit, _TERMS)), (F.col("id") + 1).cast("int")).alias("term"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(terms), P.term_matches(F.col("term"), F.col("text"))).select("doc_id", "term")


@_query("""SELECT p_name AS drug, count(DISTINCT l_orderkey) AS trials FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
           WHERE o_orderpriority = '1-URGENT' GROUP BY 1""")
def cooccurrence(spark, d):
    """A02, O01, U07."""
    orders = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(orders, "l_orderkey")
    named = lines.join(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("drug")), "p_partkey")
    return setops.id_set_union(named, ["drug"], "l_orderkey").withColumnRenamed("n", "trials")


@_query("""WITH u AS (SELECT l_partkey AS part, o_orderkey, bool_or(l_returnflag = 'R') AS pri, any_value(o_custkey) AS sponsor FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
           s AS (SELECT part, sponsor, count(*) AS n FROM u GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, sponsor) AS r FROM s)
           SELECT part, count(*) AS trials, count(*) FILTER (pri) AS as_primary, count(*) FILTER (NOT pri) AS secondary_only,
                  (SELECT string_agg(sponsor || '(' || n || ')', '; ' ORDER BY r) FROM k WHERE k.part = u.part AND r <= 3) AS top_sponsors FROM u GROUP BY part""")
def usage_primary_secondary(spark, d):
    """Usage of parts in orders, customers as sponsors."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), (F.col("l_returnflag") == "R").alias("pri"))
    used = lines.groupBy("part", "l_orderkey").agg(F.bool_or("pri").alias("pri"))
    used = used.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sponsor")), "l_orderkey")
    top = usage.top_names(used, ["part"], "sponsor", "sponsor", sep="; ").withColumnRenamed("top", "top_sponsors")
    per = usage.rolled_up(used.withColumn("none", F.lit(None).cast("string")), "part", "l_orderkey", "none", as_primary=F.col("pri"), secondary_only=~F.col("pri"))
    return per.join(top, "part").select("part", F.col("facts").alias("trials"), "as_primary", "secondary_only", "top_sponsors")


@_query("""SELECT split_part(p_name, ' ', 2) AS canonical, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS as_primary, count(DISTINCT l_orderkey) AS trials,
                  count(DISTINCT p_name) AS n_variants, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS variants FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def rollup_canonical(spark, d):
    """A06."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.element_at(F.split("p_name", " "), -1).alias("canonical"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(part, "l_partkey")
    found = usage.rolled_up(rows, "canonical", "l_orderkey", "p_name", as_primary=F.col("l_returnflag") == "R")
    return found.select("canonical", "as_primary", F.col("facts").alias("trials"), "n_variants", F.array_join("variants", "|").alias("variants"))


@_query("""SELECT l_orderkey AS orderkey, string_agg(DISTINCT l_partkey::VARCHAR, '/' ORDER BY l_partkey::VARCHAR) AS key_ids, bool_and(p_retailprice >= 905) AS approved
           FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def approved_components(spark, d):
    """J14, J15, F21."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.array_join(F.sort_array(F.collect_set(F.col("l_partkey").cast("string"))), "/").alias("key_ids"))
    approved = table(spark, d, "part").where("p_retailprice >= 905").select(F.col("p_partkey").cast("string").alias("id"))
    return link.all_approved(lines, approved).select("orderkey", "key_ids", "approved")


@_query("SELECT o_custkey AS custkey, min(o_orderdate) AS approved FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1996-06-01' GROUP BY 1")
def earliest_approval(spark, d):
    """W04, P05, P06."""
    rows = table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1996-06-01").cast("timestamp")))
    return dedup.earliest(rows.select(F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("approved")), ["custkey"], "approved")


# ---- one row per key ----------------------------------------------------------------------------------------------------
@_query("""WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE r = 1""")
def first_wins(spark, d):
    """W01, W07."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return dedup.first_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@_query("""WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE r = 1""")
def last_wins(spark, d):
    """W02."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return dedup.last_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@_query("""SELECT user_id, coalesce((arg_max(value, event_id) FILTER (event_type = 'signup')), arg_min(value, event_id)) AS value FROM events GROUP BY 1""")
def preferred_or_first(spark, d):
    """W03."""
    return dedup.preferred_or_first(table(spark, d, "events"), ["user_id"], "value", F.col("event_type") == "signup", "event_id").select("user_id", "value")


@_query("""WITH r AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders)
           SELECT o_custkey AS custkey, o_orderpriority AS priority FROM r WHERE r = 1""")
def best_priority(spark, d):
    """W05, A13."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return dedup.highest_priority(o, ["custkey"], "priority", -F.substring("priority", 1, 1).cast("int"), "o_orderkey")


@_query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS banner FROM events""")
def forward_fill(spark, d):
    """W06, S17."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "signup", F.col("value")).alias("v"))
    return dedup.forward_fill(e, "v", ["ts", "event_id"], ["user_id"], "banner").select("event_id", "banner")


# ---- facets, counts, sets -----------------------------------------------------------------------------------------------
@_query("""SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def facet_counts(spark, d):
    """P14, A07."""
    return facets.facet_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@_query("SELECT o_orderpriority, count(*) AS n, (100 * count(*)) // (SELECT count(*) FROM orders) AS percent FROM orders GROUP BY 1")
def status_histogram(spark, d):
    """A08, A15, A16."""
    return facets.histogram(table(spark, d, "orders").select("o_orderpriority"), "o_orderpriority")


@_query("""WITH r AS (SELECT 'part' AS source, p_name AS name, p_type AS condition, p_brand AS type FROM part)
           SELECT name, condition, type, CASE WHEN condition = 'LARGE' THEN 'exact' ELSE 'sibling' END AS relation FROM r
           WHERE contains(lower(type), '#2') AND condition IN ('LARGE', 'MEDIUM', 'SMALL')
           UNION ALL SELECT name, condition, type, 'text' FROM r WHERE contains(lower(type), '#1') AND contains(lower(name || ' ' || condition || ' ' || type), 'red')""")
def search_fallback(spark, d):
    """Parts of some brands related to LARGE; for a query without a concept those that name it."""
    rows = facets.unified(table(spark, d, "part"), "part", name="p_name", condition="p_type", type="p_brand")
    relations = rows.select("condition").distinct().withColumn("relation", F.when(F.col("condition") == "LARGE", "EXACT").when(F.col("condition").isin("MEDIUM", "SMALL"), "SIBLING").otherwise("UNRELATED"))
    found = facets.search(rows, query="large", type="#2", relations=relations).unionByName(facets.search(rows, query="RED", type="#1"))
    return found.select("name", "condition", "type", "relation")


@_query("""SELECT l_orderkey AS orderkey, count(DISTINCT l_linenumber) AS retrieved, max(l_linenumber)::INT AS total, CASE WHEN count(DISTINCT l_linenumber) < max(l_linenumber) THEN 'INCOMPLETE_RETRIEVAL' ELSE 'OK' END AS status
           FROM lineitem GROUP BY 1""")
def completeness(spark, d):
    """T03."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", F.col("l_linenumber").alias("total"))
    return quality.completeness(lines, "orderkey", "l_linenumber", "total")


@_query("SELECT count(*) FILTER (regexp_full_match(p_brand, 'Brand#[0-9]{2}')) AS n_valid, count(*) FILTER (NOT regexp_full_match(p_brand, 'Brand#[0-9]{2}')) AS n_malformed FROM part")
def id_validity(spark, d):
    """P07."""
    return quality.validity(table(spark, d, "part"), F.col("p_brand").rlike("^Brand#[0-9]{2}$"))


@_query(r"""WITH t AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations), g AS (SELECT lower(array_to_string(string_split(t, ' ')[1:2], ' ')) AS k, min(t) AS first, count(DISTINCT t) AS size FROM t WHERE t <> '' GROUP BY 1)
            SELECT array_to_string(string_split(first, ' ')[1:2], ' ') AS header, size FROM g""")
def group_first_words(spark, d):
    """A10: turns by their first two words."""
    rows = table(spark, d, "conversations").select(X.squeeze(F.col("text")).alias("t"))
    return facets.by_first_words(rows, "t", 2, members=False).select("header", F.col("size").cast("long").alias("size"))


@_query(r"""WITH n AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: length(w) > 4) AS words FROM benchmark),
            b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS b FROM documents),
            p AS (SELECT item_id, doc_id, len(list_filter(words, lambda w: contains(b, w))) AS present, len(words) AS n FROM n, b)
            SELECT item_id, doc_id, present::INT AS present FROM p WHERE present >= greatest(2, n - 1)""")
def word_overlap(spark, d):
    """Benchmark items nearly all of whose long words stand in a document."""
    names = table(spark, d, "benchmark").select(F.col("item_id").alias("name_id"), F.regexp_replace("text", r"[\(\)]", " ").alias("name"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("blob_id"), F.regexp_replace("text", r"[\(\)]", " ").alias("blob"))
    return link.word_overlap(names, docs, "name", "blob").select(F.col("name_id").alias("item_id"), F.col("blob_id").alias("doc_id"), "present")


@_query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href=[\x22'']([^\x22'']*)[\x22''][^>]*>(.*?)</a>', 1)) AS link FROM pages)
            SELECT page_id, link, count(*) AS n FROM a GROUP BY 1, 2""")
def html_links(spark, d):
    """S18, F22."""
    return files.links(table(spark, d, "pages").select("page_id", "html")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, d):
    """A field of a JSON cell, by Spark's own function: no operator of the library takes part."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@_query("""WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p_size, n, (SELECT coalesce(sum(n) FILTER (n > 1 AND p_size > 0), 0)::BIGINT FROM c) AS colliding FROM c""")
def distribution_collisions(spark, d):
    """A11."""
    counts, total = facets.collisions(table(spark, d, "part").select("p_size"), "p_size")
    return counts.crossJoin(F.broadcast(total))


@_query(r"""SELECT doc_id, (regexp_matches(text, '[0-9]{4,}'))::INT AS digits, (regexp_matches(text, '[A-Z]{5,}'))::INT AS shout, (regexp_matches(lower(text), 'licensed'))::INT AS licence,
                   (regexp_matches(text, '[0-9]{4,}'))::INT + (regexp_matches(text, '[A-Z]{5,}'))::INT + (regexp_matches(lower(text), 'licensed'))::INT AS n_hits FROM documents""")
def pattern_hits(spark, d):
    """A12, F18."""
    t = F.col("text")
    rows = facets.hits(table(spark, d, "documents").select("doc_id", "text"), digits=t.rlike("[0-9]{4,}"), shout=t.rlike("[A-Z]{5,}"), licence=F.lower(t).contains("licensed"))
    return rows.select("doc_id", "digits", "shout", "licence", "n_hits")


@_query("""SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)""")
def common_keys(spark, d):
    """U02."""
    return setops.common_keys("k", table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@_query("SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def not_yet_cached(spark, d):
    """U06."""
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"))
    return setops.missing_from(table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), done, ["custkey"])


@_query("""WITH u AS (SELECT p_brand AS k, 0 AS list_rank, p_partkey AS o FROM part WHERE p_size > 40 UNION ALL SELECT p_brand, 1, p_partkey FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY list_rank, o) AS r FROM u)
           SELECT k, list_rank::INT AS list_rank, o FROM r WHERE r = 1""")
def ordered_union(spark, d):
    """U05, W01."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("o"), "p_size")
    return setops.ordered_union("k", p.where("p_size > 40"), p, order="o")


@_query("""SELECT n_nationkey AS nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '!' ELSE n_name END AS name,
                  CASE WHEN n_nationkey % 3 = 0 THEN 'UPDATED' WHEN n_nationkey % 3 = 1 THEN 'SKIPPED_OLD_VALUE_DIFFERS' ELSE 'UNTOUCHED' END AS outcome FROM nation""")
def repoint(spark, d):
    """R21."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    k = F.col("nationkey") % 3
    changes = n.where(k < 2).select("nationkey", F.when(k == 0, F.col("name")).otherwise("other").alias("old"), F.concat("name", F.lit("!")).alias("new"))
    return link.repointed(n, changes, "nationkey", "name").select("nationkey", "name", "outcome")


@_query("""SELECT user_id::VARCHAR AS gauge, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate, count(*) FILTER (event_type = 'error') / count(*) >= 0.2 AND count(*) FILTER (event_type = 'error') > 0 AS over_band
           FROM events GROUP BY user_id""")
def calibration_bands(spark, d):
    """C06."""
    rates = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("gauge")).agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("rate"))
    banded = quality.over_band(rates, spark.range(1).select(F.lit("any").alias("all"), F.lit(0.2).alias("band")).join(rates.select("gauge"), F.lit(True)).select("gauge", "band"))
    return banded.select("gauge", F.round("rate", 6).alias("rate"), "over_band")


@_query("""WITH f AS (SELECT user_id AS source, arg_min(CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END, event_id) AS s FROM events GROUP BY 1)
           SELECT coalesce(string_agg(source::VARCHAR, ',' ORDER BY source) FILTER (s <> 'ok'), '') AS degraded, count(*) AS n_sources FROM f""")
def source_health(spark, d):
    """C07, W10."""
    e = table(spark, d, "events").select(F.col("user_id").alias("source"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("event_id").alias("_ord"))
    return quality.source_health(e).select(F.array_join(F.transform("degraded", lambda x: x.cast("string")), ",").alias("degraded"), "n_sources")


@_query("""SELECT c_custkey AS custkey, CASE WHEN c_acctbal < 0 THEN 'LOOKUP_FAILED' WHEN n IS NULL THEN 'NONE_FOUND' ELSE 'FOUND' END AS status
           FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000 GROUP BY 1) ON o_custkey = c_custkey""")
def three_valued(spark, d):
    """An account in the red counts as not checked."""
    big = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("orders"))
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal").join(big, "c_custkey", "left")
    return rows.select(F.col("c_custkey").alias("custkey"), quality.three_valued(F.col("c_acctbal") >= 0, F.col("orders"), "FOUND", "NONE_FOUND", "LOOKUP_FAILED").alias("status"))


@_query("""WITH p AS (SELECT p_brand AS gene, p_type AS disease, CASE WHEN p_size > 45 THEN 4 WHEN p_size > 35 THEN 3 WHEN p_size > 25 THEN 2 ELSE 1 END AS c FROM part),
           b AS (SELECT disease, gene, max(c) AS c FROM p GROUP BY 1, 2)
           SELECT disease, CASE max(c) WHEN 4 THEN 'CONFIRMED' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'HIGH' ELSE 'LOW' END AS confidence FROM b GROUP BY 1""")
def gene_confidence(spark, d):
    """A13, W05, J12."""
    from ..operators import genes

    size = F.col("p_size")
    kind = F.when(size > 45, "Definitive").when(size > 35, "Strong").when(size > 25, "Moderate").otherwise("Limited")
    rows = table(spark, d, "part").select(F.col("p_type").alias("mondo_id"), F.col("p_brand").alias("symbol"), kind.alias("classification"), F.col("p_partkey").alias("_ord"))
    best = genes.best_classification(rows).groupBy("mondo_id").agg(F.collect_set("classification").alias("c"))
    return best.select(X.bare_id(F.col("mondo_id"), "MONDO").alias("disease"), genes.confidence(F.col("c")).alias("confidence"))


@_query("""WITH a AS (SELECT n_nationkey AS cui, n_regionkey AS code FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0), c AS (SELECT n_nationkey AS cui, n_regionkey + 100 AS code FROM nation)
           SELECT n_nationkey::VARCHAR AS cui, CASE WHEN n_nationkey % 2 = 0 THEN coalesce(a.code::VARCHAR, '') ELSE c.code::VARCHAR END AS code
           FROM nation LEFT JOIN a ON a.cui = n_nationkey LEFT JOIN c ON c.cui = n_nationkey""")
def code_bridge(spark, d):
    """A curated row without the source does not fall through to the cache."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("cui"), F.col("n_nationkey").alias("k"), "n_regionkey")
    curated = n.where("k % 2 = 0").select("cui", F.when(F.col("k") % 5 != 0, "S").otherwise("OTHER").alias("sab"), F.col("n_regionkey").cast("string").alias("code"))
    cached = n.select("cui", F.lit("S").alias("sab"), (F.col("n_regionkey") + 100).cast("string").alias("code"))
    return hierarchy.code_bridge(n.select("cui", F.lit("S").alias("sab")), curated, cached).select("cui", "code")


@_query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2""")
def event_windows(spark, d):
    """The batch form of the windowed stream (``stream_windows``), each event once."""
    e = table(spark, d, "events").dropDuplicates(["event_id"])
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
