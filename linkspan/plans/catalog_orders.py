"""Whole runs whose vocabulary, catalogue and hierarchies grow with the tables: orders as concepts, urgent ones and customers in debt as the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve
from ..session import table
from . import batch
from .registry import query

RULES = resolve.Rules(accepted_types=("order",))


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, batch.Sources]:
    """Every order is in the ledger, audited ones in a second vocabulary; line items are the registry that mentions them. GEO: orders under customers under nations
    under regions; FILE: orders under a customer's orders of one status, and those under the customer."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_returnflag")
    code = lambda letter, of: F.concat(F.lit(letter), of)
    o = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.concat(F.lit("Order "), "o_orderkey").alias("name"), code("O", F.col("o_orderkey")).alias("cui"), code("C", F.col("o_custkey")).alias("of"))
    pile = F.concat_ws("-", F.concat(F.lit("Y"), "o_custkey"), "o_orderstatus")
    edge = lambda df, sab, child, parent: df.select(F.lit(sab).alias("sab"), child.alias("child"), parent.alias("parent"))
    edges = edge(o, "GEO", F.col("cui"), F.col("of")).union(edge(c, "GEO", code("C", F.col("c_custkey")), code("N", F.col("c_nationkey")))).union(edge(n, "GEO", code("N", F.col("n_nationkey")), code("R", F.col("n_regionkey"))))
    edges = edges.union(edge(o, "FILE", F.col("cui"), pile)).union(edge(o, "FILE", pile, F.col("of")).distinct())
    debt = c.where("c_acctbal < 0").select(code("C", F.col("c_custkey")).alias("cui"), (F.col("c_mktsegment") == "BUILDING").alias("qualified"))
    listed = o.where("o_orderpriority = '1-URGENT'").select("cui").union(debt.select("cui"))
    file = lambda of: F.concat(F.lit("file of "), of)
    children = lines.select(file(code("O", F.col("k"))).alias("condition"), F.concat(F.lit("line "), "l_linenumber").alias("instrument"), F.col("l_returnflag").alias("stage"), (F.col("l_returnflag") == "R").alias("qualified"))
    children = children.union(debt.select(file(F.col("cui")), F.lit("account"), F.lit(""), "qualified"))
    return o.select(F.col("name").alias("query_id"), F.col("name").alias("query")), batch.Sources(
        atoms=o.select("cui", F.lit("LEDGER").alias("sab"), F.col("name").alias("str")).union(o.where("o_orderstatus <> 'P'").select("cui", F.lit("AUDIT"), "name")),
        concepts=o.select("cui", "name", F.array(F.lit("order")).alias("semantic_types"), F.lit(1).alias("atom_count")),
        catalog=listed.select(file(F.col("cui")).alias("condition"), "cui", F.lit("").alias("norm")), children=children,
        codes=edges.select(F.col("child").alias("cui"), "sab", F.col("child").alias("code")).union(edges.select("parent", "sab", "parent")).distinct(), edges=edges,
        order=spark.range(2).select(F.when(F.col("id") == 0, "GEO").otherwise("FILE").alias("sab"), F.col("id").alias("source_order")),
        trials=lines.select(F.array(F.concat(F.lit("order "), "k")).alias("conditions")),
    )


_OWN = """
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderstatus <> 'P' AS known, o_orderpriority = '1-URGENT' AS listed FROM orders),
    l AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS q FROM lineitem GROUP BY 1),
    own AS (SELECT o.k, known, coalesce(l.n, 0) AS lines, CASE WHEN listed AND known THEN coalesce(l.n, 0) ELSE 0 END AS n, CASE WHEN listed AND known THEN coalesce(l.q, 0) ELSE 0 END AS q FROM o LEFT JOIN l ON l.k = o.k),
    near AS (SELECT a.k, 'O' || b.k AS b, 'file of O' || b.k AS condition, 'SIBLING' AS relation, 1 + (a.s = b.s)::INT AS agreed, l.n AS items, l.q AS good FROM o a JOIN o b ON a.c = b.c AND a.k <> b.k AND b.listed JOIN l ON l.k = b.k
             UNION ALL SELECT o.k, 'C' || c, 'file of C' || c, 'PARENT', 1, 1, (c_mktsegment = 'BUILDING')::INT FROM o JOIN customer ON c_custkey = c WHERE c_acctbal < 0)"""


@query(_OWN + """,
    best AS (SELECT k, condition || ':' || relation || ':' || items AS said, row_number() OVER (PARTITION BY k ORDER BY agreed DESC, condition) AS place FROM near),
    three AS (SELECT k, string_agg(said, '|' ORDER BY place) AS said FROM best WHERE place <= 3 GROUP BY 1)
    SELECT 'Order ' || k AS query_id, CASE WHEN known THEN 'RESOLVED' WHEN lines >= 2 THEN 'RESOLVED_AS_TRIAL_POPULATION' ELSE 'NOT_A_CONDITION' END AS status, n AS n_coas, q AS n_qualified, n > 0 AS has_coa, q > 0 AS has_qualified_coa,
           CASE WHEN n > 0 THEN NULL WHEN known THEN coalesce(said, '') ELSE '' END AS nearby FROM own LEFT JOIN three USING (k)""")
def order_runs(spark, d):
    """Every order through identity, catalogue and neighbours; nearby are the three best-agreed entries of those that have none."""
    asked, s = _sources(spark, d)
    out = batch.run(asked, s, RULES, parts=("neighbours",))
    nearby = F.array_join(F.transform("nearby", lambda x: F.concat_ws(":", x["condition"], x["relation"], x["n_items"])), "|")
    rows = out["assembled"].withColumn("nearby", nearby).join(out["identity"].select("query_id", "status"), "query_id")
    return rows.select("query_id", "status", "n_coas", "n_qualified", "has_coa", "has_qualified_coa", "nearby")


@query(_OWN + "\n    SELECT 'Order ' || own.k AS query_id, b, condition, relation, agreed::INT AS n_agreeing, items AS n_items FROM own JOIN near ON near.k = own.k WHERE known AND own.q = 0 AND good > 0")
def order_neighbours(spark, d):
    """Neighbours with a qualified item, of all orders that have none of their own."""
    asked, s = _sources(spark, d)
    return batch.run(asked, s, RULES, suppress_on="qualified", parts=("neighbours",))["neighbours"].select("query_id", "b", "condition", "relation", "n_agreeing", "n_items")
