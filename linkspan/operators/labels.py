"""Ancestor tests without a closure: interval labels over a hierarchy whose nodes may have several parents.

Every node gets a place in a spanning forest, so that what is below it in the forest is a range of places (lo to hi). Edges outside the
forest hand the range of the child to the parent and to all above it that do not hold it yet. A node is below another if its place
lies in one of the other's ranges: an equi-join on both codes and a comparison.

A tree costs a row for each node; what edges outside the forest add is at most what the closure would have, and far less where few nodes
have a second parent. Cycles end: ranges are a finite set. Nulls and empty codes make no edge, nor does an edge from a node to itself.

Nodes without children, mostly the greatest part, take no part in the rounds: they get their places below a parent at the end. A node
may hold very many ranges, so places and ranges meet by node and *stretch* of places, never all ranges of a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import bounded, checkpoint
from .hierarchy import PIECES

#: Places of a stretch at least; childless nodes of a parent that a task numbers.
STRETCH, LOT = 256, 100_000


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over all rows before each, in ``order`` (which must tell rows apart): ranges are summed up each in a task of its own, and the sums of the ranges before them are added."""
    placed = checkpoint(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    whole = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = whole.select("_part", (F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row for each partition
    own = F.sum(value).over(W.partitionBy("_part").orderBy(*order)) - F.col(value)
    return placed.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def _nearest(edges: DataFrame, roots: DataFrame, seen: DataFrame | None, first: int) -> DataFrame:
    """sab, node, up, level: from the roots downwards, each node under the least of the parents that reach it first."""
    level, frontier = first, checkpoint(roots.select("sab", "node", F.lit(None).cast("string").alias("up"), F.lit(first).alias("level")))
    known = frontier if seen is None else seen.unionByName(frontier)
    while not frontier.isEmpty():
        level += 1
        down = edges.join(frontier.select("sab", F.col("node").alias("parent")), ["sab", "parent"]).groupBy("sab", F.col("child").alias("node")).agg(F.min("parent").alias("up"))
        frontier = checkpoint(down.join(known.select("sab", "node"), ["sab", "node"], "left_anti").withColumn("level", F.lit(level)))
        known = known.unionByName(frontier)
        if level % PIECES == 0:
            known = checkpoint(known)
    return known


def forest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """sab, node, up (null for roots), level of ``nodes`` (sab, node). Nodes that no root leads to hang on cycles: there the least node of a cycle that nothing leads to is a root."""
    tops = nodes.join(edges.select("sab", F.col("child").alias("node")), ["sab", "node"], "left_anti")
    known = checkpoint(_nearest(edges, tops, None, 0))
    rest = checkpoint(nodes.join(known.select("sab", "node"), ["sab", "node"], "left_anti"))
    if rest.isEmpty():
        return known
    # The least code that reaches each node, by rounds; a node that only it itself or greater ones reach is a root.
    inner = edges.join(rest.select("sab", F.col("node").alias("child")), ["sab", "child"], "left_semi")
    least = checkpoint(rest.withColumn("least", F.col("node")))
    moved = least
    while not moved.isEmpty():
        told = inner.join(moved.select("sab", F.col("node").alias("parent"), "least"), ["sab", "parent"]).groupBy("sab", F.col("child").alias("node")).agg(F.min("least").alias("new"))
        both = checkpoint(least.join(told, ["sab", "node"], "left"))
        moved = both.where("new < least").select("sab", "node", F.col("new").alias("least"))
        least = both.select("sab", "node", F.least("least", "new").alias("least"))
    return checkpoint(_nearest(edges, least.where("node = least"), known, int(known.agg(F.max("level")).first()[0] or 0) + 1))


def places(tree: DataFrame) -> DataFrame:
    """sab, node, leaves, lo, hi: places in a forest, whose nodes have ``leaves`` further children without children: lo is a node's own, the next are those of its leaves, lo to hi those of all below it. Of each root one range, of each source ranges of its own."""
    deepest = tree.agg(F.max("level")).first()[0]
    if deepest is None:
        return tree.select("sab", "node", "leaves", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    # Sizes from the deepest level up, each level once.
    sizes, below = None, None
    for level in range(deepest, -1, -1):
        at = tree.where(F.col("level") == level).select("sab", "node", "up", "level", "leaves")
        at = at.withColumn("size", F.col("leaves") + 1) if below is None else at.join(below, ["sab", "node"], "left").select("sab", "node", "up", "level", "leaves", (F.coalesce("inner", F.lit(0)) + F.col("leaves") + 1).alias("size"))
        at = checkpoint(at)
        below = at.where("up IS NOT NULL").groupBy("sab", F.col("up").alias("node")).agg(F.sum("size").alias("inner"))
        sizes = at if sizes is None else sizes.unionByName(at)
    # Children of a node follow each other in the order of all edges, so what lies before a child is a difference of two running sums.
    summed = checkpoint(running(sizes.withColumn("_up", F.coalesce("up", F.lit(""))), ["sab", "_up", "node"], "size", "sum"))
    base = summed.groupBy("sab", "_up").agg(F.min("sum").alias("base"))
    shifts = checkpoint(summed.join(base, ["sab", "_up"]).select("sab", "node", "up", "level", "leaves", "size", (F.col("sum") - F.col("base")).alias("shift")))
    frontier = checkpoint(shifts.where("level = 0 OR up IS NULL").select("sab", "node", "level", "leaves", "size", F.col("shift").alias("lo")))
    out = frontier
    for level in range(1, deepest + 1):
        above = out.where(F.col("level") == level - 1).select("sab", F.col("node").alias("up"), (F.col("lo") + F.col("leaves")).alias("at"))
        at = checkpoint(shifts.where((F.col("level") == level) & F.col("up").isNotNull()).join(above, ["sab", "up"]).select("sab", "node", "level", "leaves", "size", (F.col("at") + 1 + F.col("shift")).alias("lo")))
        out = out.unionByName(at)
    return out.select("sab", "node", "leaves", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"))


def _seated(leaves: DataFrame, own: DataFrame, lot: int) -> DataFrame:
    """sab, node, lo, hi of ``leaves`` (sab, node, up): the places that ``own`` (sab, node, leaves, lo) has left for them, in any order. Those of a parent with more than ``lot`` are numbered in lots."""
    under = leaves.join(own.select("sab", F.col("node").alias("up"), "leaves", "lo"), ["sab", "up"])
    among = ["sab", "up"]
    crowded = not own.where(F.col("leaves") > lot).isEmpty()
    if crowded:
        among = ["sab", "up", "_lot"]
        under = checkpoint(under.withColumn("_lot", F.pmod(F.xxhash64("node"), F.ceil(F.col("leaves") / lot))))
        lots = under.where(F.col("leaves") > lot).groupBy(*among).agg(F.count("*").alias("n"))  # no more than all leaves by half a lot
        before = lots.select(*among, (F.sum("n").over(W.partitionBy("sab", "up").orderBy("_lot")) - F.col("n")).alias("_before"))
        under = under.repartition(*among)
    seated = under.withColumn("lo", F.col("lo") + F.row_number().over(W.partitionBy(*among).orderBy("node")))
    if crowded:
        seated = seated.join(bounded(before), among, "left").withColumn("lo", F.col("lo") + F.coalesce("_before", F.lit(0)))
    return seated.select("sab", "node", "lo", F.col("lo").alias("hi"))


def _stretch(ranges: DataFrame) -> int:
    """So many places that ranges cut at every such number of places are at most some three times as many."""
    n, places = ranges.agg(F.count("*"), F.sum(F.col("hi") - F.col("lo") + 1)).first()
    return max(STRETCH, (places or 0) // max(n, 1))


def _cut(ranges: DataFrame, stretch: int) -> DataFrame:
    """_sab, _node, _lo, _hi, _at: each range once for every stretch of places that it touches."""
    within = F.sequence(F.floor(F.col("lo") / stretch), F.floor(F.col("hi") / stretch))
    return ranges.select(F.col("sab").alias("_sab"), F.col("node").alias("_node"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(within).alias("_at"))


def label(edges: DataFrame, lot: int = LOT) -> tuple[DataFrame, DataFrame]:
    """Places (sab, node, place) and ranges (sab, node, lo, hi, lone: of a node without children) of the nodes of ``edges`` (sab, child, parent), both written down."""
    edges = edges.select("sab", "child", "parent").where("sab IS NOT NULL AND child <> '' AND parent <> '' AND child <> parent")
    nodes = checkpoint(edges.select("sab", F.col("parent").alias("node")).distinct())
    marked = edges.repartition("sab", "child").distinct().join(nodes.select("sab", F.col("node").alias("child"), F.lit(True).alias("inner")), ["sab", "child"], "left")
    marked = checkpoint(marked.withColumn("up", F.min("parent").over(W.partitionBy("sab", "child"))))
    inner = marked.where("inner").select("sab", "child", "parent")
    leaves = marked.where("inner IS NULL AND parent = up").select("sab", F.col("child").alias("node"), "up")
    tree = forest(inner, nodes)
    held_by = leaves.groupBy("sab", F.col("up").alias("node")).agg(F.count("*").alias("leaves"))
    trunk = checkpoint(places(checkpoint(tree.join(held_by, ["sab", "node"], "left").fillna(0, ["leaves"]))))
    held, seated = trunk.select("sab", "node", "lo", "hi"), checkpoint(_seated(leaves, trunk, lot))
    own = held.unionByName(seated)
    kept = tree.where("up IS NOT NULL").select("sab", F.col("node").alias("child"), F.col("up").alias("parent"))
    extra = inner.join(kept, ["sab", "child", "parent"], "left_anti").unionByName(marked.where("inner IS NULL AND parent <> up").select("sab", "child", "parent"))
    stretch = _stretch(held)
    found = extra.join(own.withColumnRenamed("node", "child"), ["sab", "child"]).select("sab", F.col("parent").alias("node"), "lo", "hi")
    rounds = 0
    while True:
        found = checkpoint(found.distinct())
        if found.isEmpty():
            break
        at, of = found.withColumn("_from", F.floor(F.col("lo") / stretch)), _cut(held, stretch)
        within = (F.col("sab") == F.col("_sab")) & (F.col("node") == F.col("_node")) & (F.col("_from") == F.col("_at")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
        frontier = checkpoint(at.join(of, within, "left_anti").drop("_from"))
        rounds += 1
        held = held.unionByName(frontier)
        if rounds % PIECES == 0:
            held = checkpoint(held)
        found = inner.join(frontier.withColumnRenamed("node", "child"), ["sab", "child"]).select("sab", F.col("parent").alias("node"), "lo", "hi")
    ranges = held.withColumn("lone", F.lit(False)).unionByName(seated.withColumn("lone", F.lit(True)))
    return own.select("sab", "node", F.col("lo").alias("place")), ranges


def descents(pairs: DataFrame, places: DataFrame, ranges: DataFrame) -> DataFrame:
    """Those of the asked ``pairs`` (sab, node, ancestor) in which ``ancestor`` is one of the node. A node is none of its own; codes without a label have none."""
    asked = pairs.select("sab", "node", "ancestor").where("node <> ancestor")
    ranges = ranges.where("NOT lone")  # nothing is below those
    stretch = _stretch(ranges)
    at = asked.join(places, ["sab", "node"]).distinct().withColumn("_from", F.floor(F.col("place") / stretch))
    within = (F.col("sab") == F.col("_sab")) & (F.col("ancestor") == F.col("_node")) & (F.col("_from") == F.col("_at")) & (F.col("_lo") <= F.col("place")) & (F.col("place") <= F.col("_hi"))
    return at.join(_cut(ranges, stretch), within, "left_semi").select("sab", "node", "ancestor")


def asked_lines(pairs: DataFrame, codes: DataFrame, places: DataFrame, ranges: DataFrame) -> DataFrame:
    """What ``hierarchy.relation_per_source`` needs of a closure for concepts ``pairs`` (a, b), asked of the labels in both directions: sab, node, ancestor."""
    side = lambda c, name: codes.where("code <> ''").select(F.col("cui").alias(c), "sab", F.col("code").alias(name))
    known = pairs.select("a", "b").distinct().join(side("a", "node"), "a").join(side("b", "ancestor"), ["b", "sab"]).select("sab", "node", "ancestor")
    return descents(known.unionByName(known.select("sab", F.col("ancestor").alias("node"), F.col("node").alias("ancestor"))), places, ranges)
