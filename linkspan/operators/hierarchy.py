"""Hierarchies as edge tables (sab, child, parent): closure, relations per source, and the vote across sources.

Pairs are related by equi-joins on edges and closure, never by walking. Siblings are found from the asked codes only, so a
parent with very many children costs what is asked of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint

EXACT, PARENT, CHILD, SIBLING, ANCESTOR, DESCENDANT, UNRELATED, NO_HIERARCHY = "EXACT", "PARENT", "CHILD", "SIBLING", "ANCESTOR", "DESCENDANT", "UNRELATED", "NO_HIERARCHY"
STRUCTURAL = (PARENT, CHILD, SIBLING, ANCESTOR, DESCENDANT)
#: The nearer relation wins between equal votes.
RANK = {EXACT: 0, PARENT: 1, CHILD: 1, SIBLING: 2, ANCESTOR: 3, DESCENDANT: 3, UNRELATED: 9}


#: Rounds of a closure that are kept apart before they are written as one.
PIECES = 16


def reverse(edges: DataFrame) -> DataFrame:
    """Sab, parent, children (sorted)."""
    return edges.groupBy("sab", "parent").agg(F.sort_array(F.collect_set("child")).alias("children"))


def relatives(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sab, code, kind (parent or child), relative of each code (sab, code)."""
    up = codes.join(edges.withColumnRenamed("child", "code"), ["sab", "code"]).select("sab", "code", F.lit("parent").alias("kind"), F.col("parent").alias("relative"))
    down = codes.join(edges.withColumnRenamed("parent", "code"), ["sab", "code"]).select("sab", "code", F.lit("child").alias("kind"), F.col("child").alias("relative"))
    return up.unionByName(down).distinct()


def closure(edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Sab, node, ancestor, depth (least). Each round extends what the last one added and drops what is known, so cycles end, and paths may be of any length.

    ``only`` (sab, node) limits the starting points. A node is its own ancestor only through a cycle, and then is left out.
    """
    step = edges.select("sab", F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node <> ancestor").distinct()
    start = step.join(only.select("sab", "node").distinct(), ["sab", "node"], "left_semi") if only is not None else step
    known = checkpoint(start.withColumn("depth", F.lit(1)))
    frontier, up = known, step.select("sab", F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    depth = 1
    while not frontier.isEmpty():
        depth += 1
        new = frontier.join(up, ["sab", "ancestor"]).select("sab", "node", F.col("next").alias("ancestor")).where("node <> ancestor").distinct()
        frontier = checkpoint(new.join(known.select("sab", "node", "ancestor"), ["sab", "node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.unionByName(frontier)
        if depth % PIECES == 0:
            known = checkpoint(known)
    return known


def siblings(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sab, code, sibling: other children of a parent of the code."""
    up = codes.select("sab", "code").distinct().join(edges.select("sab", F.col("child").alias("code"), "parent"), ["sab", "code"])
    return up.join(edges.select("sab", "parent", F.col("child").alias("sibling")), ["sab", "parent"]).where("code <> sibling").select("sab", "code", "sibling").distinct()


def neighbourhood(codes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Sab, code, kind, relative, name of parents, children and siblings."""
    near = relatives(codes, edges).unionByName(siblings(codes, edges).select("sab", "code", F.lit("sibling").alias("kind"), F.col("sibling").alias("relative")))
    return near.join(names.select("sab", F.col("code").alias("relative"), "name"), ["sab", "relative"], "left").select("sab", "code", "kind", "relative", "name")


def relation_per_source(pairs: DataFrame, codes: DataFrame, edges: DataFrame, ancestors: DataFrame, defined: DataFrame | None = None, gated: tuple[str, ...] = ()) -> DataFrame:
    """A, b, sab, relation of b to a, via (shared parents), code_a, code_b, for every source that has codes for pairs (a, b).

    ``codes`` (cui, sab, code) with one code per concept and source. The ladder: parent, child, sibling, ancestor, descendant,
    unrelated. In a gated source siblings must share a defined parent (``defined``: sab, code); sharing only others is UNRELATED
    at once. An empty ``defined`` switches the gate off. A source without a code for both abstains: it gives no row. One that has
    both and finds no path says UNRELATED; different concepts under one code are siblings through its parents.
    """
    side = lambda c: codes.select(F.col("cui").alias(c), "sab", F.col("code").alias(f"code_{c}")).where(F.col(f"code_{c}") != "")
    known = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), ["b", "sab"])
    up = edges.select("sab", "child", "parent").distinct()
    parent = up.select("sab", F.col("child").alias("code_a"), F.col("parent").alias("code_b"), F.lit(True).alias("is_parent"))
    child = up.select("sab", F.col("parent").alias("code_a"), F.col("child").alias("code_b"), F.lit(True).alias("is_child"))
    above = ancestors.select("sab", F.col("node").alias("code_a"), F.col("ancestor").alias("code_b"), F.lit(True).alias("is_ancestor")).distinct()
    below = ancestors.select("sab", F.col("ancestor").alias("code_a"), F.col("node").alias("code_b"), F.lit(True).alias("is_descendant")).distinct()
    asked = known.select("sab", "code_a", "code_b").distinct()
    shared = asked.join(up.select("sab", F.col("child").alias("code_a"), "parent"), ["sab", "code_a"]).join(up.select("sab", F.col("child").alias("code_b"), "parent"), ["sab", "code_b", "parent"])
    gate = defined is not None and not defined.isEmpty()
    if gate:
        shared = shared.join(defined.select("sab", F.col("code").alias("parent"), F.lit(True).alias("d")).distinct(), ["sab", "parent"], "left").withColumn("good", F.coalesce("d", F.lit(False)) | ~F.col("sab").isin(*gated))
    else:
        shared = shared.withColumn("good", F.lit(True))
    shared = shared.groupBy("sab", "code_a", "code_b").agg(F.bool_or("good").alias("good"), F.sort_array(F.collect_set(F.when(F.col("good"), F.col("parent")))).alias("via"))
    keys = ["sab", "code_a", "code_b"]
    rows = known
    for other in (parent, child, shared, above, below):
        rows = rows.join(other, keys, "left")
    relation = (
        F.when(F.col("a") == F.col("b"), EXACT)
        .when(F.col("is_parent"), PARENT)
        .when(F.col("is_child"), CHILD)
        .when(F.col("good"), SIBLING)
        .when(F.col("good").isNotNull(), UNRELATED)
        .when(F.col("is_ancestor"), ANCESTOR)
        .when(F.col("is_descendant"), DESCENDANT)
        .otherwise(UNRELATED)
    )
    empty = F.array().cast("array<string>")
    return rows.withColumn("relation", relation).select("a", "b", "sab", "relation", F.when(F.col("relation") == SIBLING, F.coalesce("via", empty)).otherwise(empty).alias("via"), "code_a", "code_b")


def rank(relation: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in RANK.items() for v in kv]), relation)


def vote(pairs: DataFrame, per_source: DataFrame, order: DataFrame) -> DataFrame:
    """A, b, relation, n_agreeing, agreeing (sources), via, dissent (relation to sources), n_voting.

    The relation most sources name wins; then a structural one over UNRELATED, then the nearer, then the one first named in the
    sources' order (``order``: sab, source_order). NO_HIERARCHY abstains; a pair without votes is NO_HIERARCHY, equal ids are EXACT.
    """
    votes = per_source.where(F.col("relation") != NO_HIERARCHY).join(order, "sab")
    by = votes.groupBy("a", "b", "relation").agg(F.count_distinct("sab").alias("n"), F.min("source_order").alias("first"), F.sort_array(F.collect_set(F.struct("source_order", "sab"))).alias("said"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("source_order", "via"))), lambda x: x["via"])).alias("via"))
    by = by.withColumn("key", F.struct((-F.col("n")).alias("n"), (F.col("relation") == UNRELATED).alias("u"), rank(F.col("relation")).alias("r"), F.col("first").alias("f")))
    names = lambda c: F.transform(c, lambda x: x["sab"])
    won = by.groupBy("a", "b").agg(F.min_by(F.struct("relation", "n", "said", "via"), "key").alias("w"), F.collect_list(F.struct("relation", names(F.col("said")).alias("sources"))).alias("all"), F.sum("n").alias("n_voting"))
    rows = pairs.select("a", "b").distinct().join(won, ["a", "b"], "left")
    same = (F.col("a") == F.col("b")) & (F.col("a") != "")
    dissent = F.map_from_entries(F.filter("all", lambda x: x["relation"] != F.col("w.relation")))
    return rows.select(
        "a", "b", F.when(same, EXACT).otherwise(F.coalesce("w.relation", F.lit(NO_HIERARCHY))).alias("relation"),
        F.when(same, 0).otherwise(F.coalesce("w.n", F.lit(0))).cast("int").alias("n_agreeing"), F.when(~same, names(F.col("w.said"))).alias("agreeing"),
        F.when(~same, F.array_distinct("w.via")).alias("via"), F.when(~same, dissent).alias("dissent"), F.coalesce("n_voting", F.lit(0)).cast("int").alias("n_voting"),
    )


def label(relation: Column) -> Column:
    """What a row is to the query: child, parent, sibling, exact, else null."""
    return F.when(relation.isin(CHILD, DESCENDANT), "child").when(relation.isin(PARENT, ANCESTOR), "parent").when(relation == SIBLING, "sibling").when(relation == EXACT, "exact")


#: Sources that have a bit each.
_BITS = 62


def _counted(mine: DataFrame, theirs: DataFrame, edges: DataFrame, ancestors: DataFrame, order: DataFrame, defined: DataFrame | None, gated: tuple[str, ...]) -> DataFrame | None:
    """a, b, relation, n_agreeing: what ``vote`` says of the related pairs of ``mine`` (a, sab, code) and ``theirs`` (b, sab, other). None where a concept has several codes in a source, or there are more sources than bits.

    Every edge, shared parent and line of descent between two codes is a row with its rung on the ladder; of a pair and source the first rung counts.
    Sources in which both have a code and that are on no rung say UNRELATED; how many they are is told by the bits of both."""
    place = order.where("sab IS NOT NULL").groupBy("sab").agg(F.min("source_order").alias("o")).withColumn("i", F.row_number().over(W.orderBy("o", "sab")).cast("byte")).drop("o")  # a row for each source
    if place.count() > _BITS:
        return None
    by = F.broadcast(place)

    def coded(df: DataFrame, who: str, code: str, bits: str) -> DataFrame | None:
        own = checkpoint(df.where(F.col(code) != "").join(by, "sab").select(who, "i", code).distinct())
        if not own.groupBy(who, "i").count().where("count > 1").isEmpty():
            return None
        return own.join(own.groupBy(who).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i").cast("int"))).alias(bits)), who)

    left, right = coded(mine, "a", "code", "bits_a"), coded(theirs, "b", "other", "bits_b")
    if left is None or right is None:
        return None
    up = edges.select("sab", "child", "parent").distinct()
    if defined is not None and not defined.isEmpty():
        up = up.join(defined.select("sab", F.col("code").alias("parent"), F.lit(True).alias("d")).distinct(), ["sab", "parent"], "left").withColumn("rung", F.when(F.coalesce("d", F.lit(False)) | ~F.col("sab").isin(*gated), 3).otherwise(4))
    else:
        up = up.withColumn("rung", F.lit(3))
    up = up.join(by, "sab").select("i", "child", "parent", "rung")
    lines = ancestors.select("sab", "node", "ancestor").distinct().join(by, "sab").select("i", "node", "ancestor")
    # A line is met from the side of the catalogue first, which is the smaller one.
    met = lambda rows, mine_, theirs_, rung: rows.select("i", F.col(theirs_).alias("other"), F.col(mine_).alias("code")).join(right, ["i", "other"]).join(left, ["i", "code"]).select("a", "b", "i", "bits_a", "bits_b", F.lit(rung).alias("rung"))
    shared = up.withColumnRenamed("child", "other").join(right, ["i", "other"]).select("i", "parent", "b", "bits_b")
    shared = up.withColumnRenamed("child", "code").join(left, ["i", "code"]).select("i", "parent", "rung", "a", "bits_a").join(shared, ["i", "parent"]).select("a", "b", "i", "bits_a", "bits_b", "rung")
    rows = met(up, "child", "parent", 1).union(met(up, "parent", "child", 2)).union(shared).union(met(lines, "node", "ancestor", 5)).union(met(lines, "ancestor", "node", 6))
    rows = rows.where("a <> b").select("a", "b", "i", F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b"))).cast("byte").alias("voting"), F.col("rung").cast("byte").alias("rung"))
    each = rows.repartition("a", "b").groupBy("a", "b", "i").agg(F.min("rung").alias("rung"), F.first("voting").alias("voting"))
    rungs = {PARENT: 1, CHILD: 2, SIBLING: 3, ANCESTOR: 5, DESCENDANT: 6}
    at = lambda r: F.col("rung") == rungs[r]
    counts = [c for r in rungs for c in (F.count_if(at(r)).alias(f"n_{r}"), F.min(F.when(at(r), F.col("i"))).alias(f"f_{r}"))]
    pairs = each.groupBy("a", "b").agg(F.first("voting").alias("voting"), *counts)
    said = [F.when(F.col(f"n_{r}") > 0, F.struct((-F.col(f"n_{r}")).alias("n"), F.lit(RANK[r]).alias("r"), F.col(f"f_{r}").alias("f"), F.lit(r).alias("relation"))) for r in rungs]
    unrelated = F.col("voting") - sum((F.col(f"n_{r}") for r in rungs), F.lit(0))
    pairs = pairs.select("a", "b", F.least(*said).alias("w"), unrelated.alias("u")).where("w IS NOT NULL AND -w.n >= u")
    return pairs.select("a", "b", F.col("w.relation").alias("relation"), (-F.col("w.n")).cast("int").alias("n_agreeing"))


def neighbours(identities: DataFrame, catalog: DataFrame, codes: DataFrame, edges: DataFrame, ancestors: DataFrame, order: DataFrame, defined: DataFrame | None = None, gated: tuple[str, ...] = (), reasons: bool = True) -> DataFrame:
    """Catalogue concepts (cui, condition) that stand in a structural relation to each identity (a), best agreed first.

    Only pairs that share an edge, a parent or a line of descent in some source are formed; unrelated ones never are.
    Without ``reasons`` only a, b, relation, n_agreeing and condition come: what relates a pair is then counted where it is found, in one shuffle of the pairs."""
    mine = identities.select(F.col("cui").alias("a")).distinct().join(codes.select(F.col("cui").alias("a"), "sab", "code"), "a")
    theirs = catalog.select(F.col("cui").alias("b")).distinct().join(codes.select(F.col("cui").alias("b"), "sab", F.col("code").alias("other")), "b")
    codes_of = mine.select("sab", "code").distinct()
    near = relatives(codes_of, edges).select("sab", "code", F.col("relative").alias("other")).union(siblings(codes_of, edges))
    near = near.union(codes_of.join(edges.select("sab", F.col("child").alias("code")), ["sab", "code"], "left_semi").select("sab", "code", F.col("code").alias("other")))  # concepts under one code
    lines = ancestors.select("sab", F.col("node").alias("code"), F.col("ancestor").alias("other"))
    lines = lines.union(ancestors.select("sab", F.col("ancestor").alias("code"), F.col("node").alias("other"))).join(codes_of, ["sab", "code"], "left_semi")
    pairs = mine.join(near.union(lines).distinct(), ["sab", "code"]).join(theirs, ["sab", "other"]).where("a <> b").select("a", "b").distinct()
    if not reasons and (lean := _counted(mine, theirs, edges, ancestors, order, defined, gated)) is not None:
        return lean.join(catalog.select(F.col("cui").alias("b"), "condition").distinct(), "b")
    related = vote(pairs, relation_per_source(pairs, codes, edges, ancestors, defined, gated), order).where(F.col("relation").isin(*STRUCTURAL))
    return related.join(catalog.select(F.col("cui").alias("b"), "condition").distinct(), "b")


def coverage(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cui, sab, code, n_parents, and n_sources (sources in which the concept has a parent)."""
    n = edges.groupBy("sab", F.col("child").alias("code")).agg(F.count_distinct("parent").alias("n_parents"))
    rows = codes.join(n, ["sab", "code"], "left").withColumn("n_parents", F.coalesce("n_parents", F.lit(0)))
    total = rows.groupBy("cui").agg(F.count_if(F.col("n_parents") > 0).alias("n_sources"))
    return rows.join(total, "cui").select("cui", "sab", "code", "n_parents", "n_sources")


def code_bridge(wanted: DataFrame, curated: DataFrame, cached: DataFrame) -> DataFrame:
    """Cui, sab, code ('' for none). A concept that the curated index (cui, sab, code) has at all is answered by it alone; the rest by the cache."""
    owned = curated.select("cui", F.lit(True).alias("owned")).distinct()
    rows = wanted.join(owned, "cui", "left").join(curated.select("cui", "sab", F.col("code").alias("c1")), ["cui", "sab"], "left").join(cached.select("cui", "sab", F.col("code").alias("c2")), ["cui", "sab"], "left")
    return rows.select("cui", "sab", F.when(F.col("owned"), F.coalesce("c1", F.lit(""))).otherwise(F.coalesce("c2", F.lit(""))).alias("code"))
