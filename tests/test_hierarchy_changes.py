"""Closures and relations after changes against a rebuild, and labels against the closure, on random graphs with several parents and cycles."""

import random

import pytest
from pyspark.sql import functions as F

from linkspan.operators import hierarchy, incremental, labels

EDGE = "sab string, child string, parent string"


def graph(seed, nodes, edges, cycles):
    rng = random.Random(seed)
    out = set()
    while len(out) < edges:
        a, b = rng.sample(range(nodes), 2)
        if not cycles and a < b:
            a, b = b, a
        out.add((rng.choice("XY"), f"n{a:02}", f"n{b:02}"))
    return rng, sorted(out)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("seed,cycles", [(1, False), (2, True)])
def test_changes_equal_a_rebuild(spark, seed, cycles):
    rng, e = graph(seed, 16, 34, cycles)
    _, more = graph(seed + 100, 16, 8, cycles)
    out = rng.sample(e, 9)
    edges, inserted, deleted = (spark.createDataFrame(x, EDGE) for x in (e + e[:3], more + out[:2] + [("X", "n01", "n01")], out + [("X", "no", "such")]))
    codes = spark.createDataFrame([(f"c{i:02}", s, f"n{i % 14:02}") for i in range(16) for s in "XY" if (i + seed) % 5 or s == "X"], "cui string, sab string, code string")
    catalog = codes.select("cui").distinct().withColumn("condition", F.upper("cui"))
    order = spark.createDataFrame([("X", 0), ("Y", 1)], "sab string, source_order int")
    known = hierarchy.closure(edges)
    before = hierarchy.neighbours(catalog, catalog, codes, edges, known, order)
    after, came, went = incremental.changed(edges, inserted, deleted)
    assert rows(after, "sab", "child", "parent") == sorted((set(e) - set(out)) | set(more) | set(out[:2]), key=str)
    delta = incremental.closure_delta(known, after, came, went)
    now, rebuilt = incremental.applied(known, delta), hierarchy.closure(after)
    assert rows(now, *incremental.KEY, "depth") == rows(rebuilt, *incremental.KEY, "depth")
    old = {r[:3]: r[3] for r in rows(known, *incremental.KEY, "depth")}
    new = {r[:3]: r[3] for r in rows(rebuilt, *incremental.KEY, "depth")}
    assert rows(delta, *incremental.KEY, "was", "depth") == sorted(((*k, old.get(k), new.get(k)) for k in old.keys() | new.keys() if old.get(k) != new.get(k)), key=str)
    pairs = incremental.touched(delta, after, came, went, codes, catalog)
    told = ("a", "b", "relation", "n_agreeing", "via", "n_voting", "condition")
    assert rows(incremental.relations(before, pairs, now, after, codes, catalog, order), *told) == rows(hierarchy.neighbours(catalog, catalog, codes, after, rebuilt, order), *told)


def test_no_change_and_nulls(spark):
    edges = spark.createDataFrame([("X", "a", "b"), ("X", None, "b"), (None, "a", "b"), ("X", "b", None)], EDGE)
    known = hierarchy.closure(edges.dropna())
    after, came, went = incremental.changed(edges, edges.limit(0), edges.limit(0))
    assert incremental.closure_delta(known, after, came, went).isEmpty() and rows(after, "child", "parent") == [("a", "b")]
    after, came, went = incremental.changed(edges.limit(0), edges, edges)
    delta = incremental.closure_delta(known.limit(0), after, came, went)
    assert rows(delta, *incremental.KEY, "was", "depth") == [("X", "a", "b", None, 1)]


@pytest.mark.parametrize("seed,cycles", [(4, False), (5, True)])
def test_labels_equal_the_closure(spark, seed, cycles):
    _, e = graph(seed, 18, 30, cycles)
    if cycles:  # cycles that no root leads to, one of them above others
        e += [("X", "p", "q"), ("X", "q", "p"), ("X", "p", "n01"), ("Y", "k", "l"), ("Y", "l", "m"), ("Y", "m", "k"), ("Y", "j", "m"), ("Y", "a", "a")]
    edges = spark.createDataFrame(e + e[:2] + [("X", None, "n01"), (None, "n00", "n01")], EDGE)
    nodes = sorted({x for _, a, b in e for x in (a, b)} | {"nowhere"})
    asked = spark.createDataFrame([(s, a, b) for s in "XY" for a in nodes for b in nodes], "sab string, node string, ancestor string")
    places, ranges = labels.label(edges)
    assert rows(labels.descents(asked, places, ranges), *incremental.KEY) == rows(hierarchy.closure(edges.dropna()), *incremental.KEY)
    assert places.count() == places.select("sab", "node").distinct().count() == places.select("sab", "place").distinct().count()


def test_labels_of_a_tree_and_of_nothing(spark):
    tree = [("T", f"n{i}", f"n{(i - 1) // 3}") for i in range(1, 40)]
    places, ranges = labels.label(spark.createDataFrame(tree, EDGE))
    assert ranges.count() == places.count() == 40  # a row for each node, where the closure has one for each pair
    assert ranges.where("node = 'n0'").select("lo", "hi").first() == (0, 39)
    places, ranges = labels.label(spark.createDataFrame([], EDGE))
    assert places.isEmpty() and labels.descents(spark.createDataFrame([("T", "a", "b")], "sab string, node string, ancestor string"), places, ranges).isEmpty()


def test_places_and_ranges_meet_by_stretches(spark):
    """A node that holds very many ranges, each of one leaf, is asked by as many nodes: they never meet all of them."""
    n = 3000
    lines = spark.range(n).select(F.format_string("l%05d", "id").alias("child"), F.array(F.lit("a"), F.when(F.col("id") % 2 == 0, F.lit("q"))).alias("parents"))
    edges = lines.select(F.lit("T").alias("sab"), "child", F.explode("parents").alias("parent")).dropna()
    places, ranges = labels.label(edges)
    assert ranges.where("node = 'q'").count() == 1 + n // 2
    asked = lines.select(F.lit("T").alias("sab"), F.col("child").alias("node"), F.explode(F.array(F.lit("a"), F.lit("q"), F.lit("l00001"))).alias("ancestor"))
    out = labels.descents(asked, places, ranges)
    assert out.groupBy("ancestor").count().sort("ancestor").collect() == [("a", n), ("q", n // 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(_from" in plan and "_at" in plan and labels._cut(ranges.where("node = 'q'"), labels.STRETCH).groupBy("_at").count().agg(F.max("count")).first()[0] <= labels.STRETCH


@pytest.mark.parametrize("seed", [7, 8])
def test_leaves_are_seated_in_lots(spark, seed):
    rng = random.Random(seed)
    e = [("X", f"l{i:03}", f"p{rng.choice((0, 0, 0, 1, 2))}") for i in range(60)] + [("X", f"l{i:03}", "p3") for i in range(0, 60, 7)] + [("X", "p1", "p0"), ("X", "p2", "p0"), ("X", "p3", "p2")]
    edges = spark.createDataFrame(e, EDGE)
    places, ranges = labels.label(edges, lot=8)
    count = places.count()
    assert count == places.select("place").distinct().count() == 64 and places.agg(F.min("place"), F.max("place")).first() == (0, 63)
    nodes = places.select("sab", "node")
    asked = nodes.join(nodes.withColumnRenamed("node", "ancestor"), "sab")
    assert rows(labels.descents(asked, places, ranges), *incremental.KEY) == rows(hierarchy.closure(edges), *incremental.KEY)


def test_relations_from_labels(spark):
    _, e = graph(6, 12, 22, False)
    edges = spark.createDataFrame(e, EDGE)
    codes = spark.createDataFrame([(f"c{i:02}", s, f"n{i:02}") for i in range(12) for s in "XY"], "cui string, sab string, code string")
    pairs = spark.createDataFrame([(f"c{a:02}", f"c{b:02}") for a in range(12) for b in range(12)], "a string, b string")
    lines = labels.asked_lines(pairs, codes, *labels.label(edges))
    told = ("a", "b", "sab", "relation", "via")
    assert rows(hierarchy.relation_per_source(pairs, codes, edges, lines), *told) == rows(hierarchy.relation_per_source(pairs, codes, edges, hierarchy.closure(edges)), *told)


def test_concepts_under_one_code_are_siblings(spark):
    edges = spark.createDataFrame([("X", "k", "p"), ("X", "q", "p2")], EDGE)
    codes = spark.createDataFrame([("a", "X", "k"), ("b", "X", "k"), ("c", "X", "p2"), ("d", "X", "p2")], "cui string, sab string, code string")
    catalog = codes.select("cui").withColumn("condition", F.col("cui"))
    out = hierarchy.neighbours(catalog, catalog, codes, edges, hierarchy.closure(edges), spark.createDataFrame([("X", 0)], "sab string, source_order int"))
    assert rows(out, "a", "b", "relation", "via") == [("a", "b", "SIBLING", ["p"]), ("b", "a", "SIBLING", ["p"])]  # c and d have no parent


@pytest.mark.parametrize("seed,cycles,gated", [(7, False, ()), (8, True, ("Y",))])
def test_counted_relations_are_those_of_the_vote(spark, seed, cycles, gated):
    """Without reasons a pair is shuffled once, not once for each step of the vote, and the relations are the same, also where most sources see none."""
    rng, e = graph(seed, 16, 30, cycles)
    edges = spark.createDataFrame(e + [("Z", "n01", "n02"), ("Z", "n03", "n03")], EDGE)
    codes = spark.createDataFrame([(f"c{i:02}", s, f"n{i % 14:02}" if i % 6 else "") for i in range(16) for s in "XYZ" if rng.random() < 0.8], "cui string, sab string, code string")
    catalog = codes.select("cui").distinct().withColumn("condition", F.upper("cui"))
    order = spark.createDataFrame([("Y", 0), ("X", 1), ("Z", 2)], "sab string, source_order int")
    defined = spark.createDataFrame([("Y", "n03"), ("Y", "n05")], "sab string, code string")
    args = (catalog, catalog, codes, edges, hierarchy.closure(edges), order, defined, gated)
    lean, told = hierarchy.neighbours(*args, reasons=False), ("a", "b", "relation", "n_agreeing", "condition")
    assert lean.columns == list(lean.select("b", "a", "relation", "n_agreeing", "condition").columns)
    assert rows(lean, *told) == rows(hierarchy.neighbours(*args), *told) != []
    twice = codes.union(spark.createDataFrame([("c01", "X", "n09")], codes.schema))
    args = (catalog, catalog, twice, *args[3:])
    assert rows(hierarchy.neighbours(*args, reasons=False), *told) == rows(hierarchy.neighbours(*args), *told)  # several codes: by the whole vote
