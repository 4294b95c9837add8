"""Sharding (7): k-d tree partitioning by distributed weighted medians.

A compact table holds, for each document, its size, the coordinates of its metadata and a rank of ties. Level by level every
node is cut at the weighted median of its widest dimension until there are ``shards`` leaves. A median comes from histograms: all
nodes of a level are counted at once in ``BUCKETS`` equal steps of the range, then only the bucket that holds the median is
counted again in as many steps, until it is light or one value. Documents that agree in that value are cut by the hash of
their text, then by that of their id, then, as equal rows, by a number of their own, found in the same way. What is known of a
node is a row of a table that is joined by node, so plans do not grow with the number of shards. The driver gets one row per node
and round, never documents.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, small, text_or_empty

BUCKETS = 512
#: A cut may miss its node's median by this share of the node's weight.
TOLERANCE = 1e-4
#: Documents numbered by one task.
SLOT_ROWS = 200_000
TIES = 3


def text_dimensions(text: str = "text") -> dict[str, Column]:
    """Metadata of the text alone, so that copies of a text have one place: logarithm of its bytes; bytes a word, a line and a full
    stop, as logarithms; share of bytes outside ASCII. Counts are lengths without the sign, which costs no match objects."""
    t = text_or_empty(text)
    size = F.octet_length(t)
    each = lambda sign: F.log2(size / (size - F.octet_length(F.replace(t, F.lit(sign), F.lit(""))) + 1) + 1)
    return {"length": F.log2(size + 1), "word": each(" "), "line": each("\n"), "stop": each("."), "beyond_ascii": (size - F.char_length(t)) / F.greatest(size, F.lit(1))}


def _table(spark: SparkSession, rows: list[dict], schema: dict[str, pa.DataType]) -> DataFrame:
    """Rows of the driver as a table, by way of Arrow: no Python worker has to unpack them."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema(list(schema.items()))))


def _open(goals: dict[int, dict]) -> list[dict]:
    return [{"node": n, "widest": g["widest"], "fixed": [], "lo": g["low"][0], "hi": g["high"][0], "want": g["want"]} for n, g in goals.items()]


def _cuts(rows: DataFrame, goals: dict[int, dict], tolerance: float) -> list[dict]:
    """For each node the bound of its left side: node, widest, bound (of the widest dimension, then of ties), inclusive.

    A goal has widest (number of the dimension), the low and high of it and of the ties, the weight of the node and the weight wanted
    on the left. Every round counts, for all open nodes at once, the rows still in question in equal steps of their range.
    """
    spark, cuts, open_ = rows.sparkSession, [], _open(goals)
    while open_:
        state = _table(spark, open_, {"node": pa.int64(), "widest": pa.int32(), "fixed": pa.list_(pa.float64()), "lo": pa.float64(), "hi": pa.float64(), "want": pa.float64()})
        at = rows.join(small(state, len(open_)), "node").withColumn("keys", F.concat(F.array(F.get("dims", "widest")), "ties"))
        at = at.where(F.slice("keys", F.lit(1), F.size("fixed")) == F.col("fixed")).withColumn("key", F.get("keys", F.size("fixed"))).where(F.col("key").between(F.col("lo"), F.col("hi")))
        share = F.when(F.col("hi") > F.col("lo"), (F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
        hist = at.withColumn("b", F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS))).groupBy("node", "b").agg(F.sum("size").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("want").alias("want"))
        hist = hist.withColumn("upto", F.sum("w").over(W.partitionBy("node").orderBy("b")))
        found = {r["node"]: r for r in hist.where(F.col("upto") >= F.col("want")).groupBy("node").agg(F.min(F.struct("b", "upto", "w", "lo", "hi")).alias("x")).select("node", "x.*").collect()}
        still = []
        for s in open_:
            r, g = found[s["node"]], goals[s["node"]]
            over, under = r["upto"] - s["want"], s["want"] - (r["upto"] - r["w"])
            one, stage = r["lo"] == r["hi"], len(s["fixed"])
            if min(over, under) <= tolerance * g["weight"] or one and stage == TIES:
                whole = over <= under
                cuts.append({"node": s["node"], "widest": s["widest"], "bound": [*s["fixed"], r["hi"] if whole else r["lo"]], "inclusive": whole})
            elif one:
                still.append(s | {"fixed": [*s["fixed"], r["lo"]], "lo": g["low"][stage + 1], "hi": g["high"][stage + 1], "want": float(under)})
            else:
                still.append(s | {"lo": r["lo"], "hi": r["hi"], "want": float(under)})
        open_ = still
    return cuts


def kd_tree(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` (size, dims: array of coordinates, ties: array of TIES numbers, any others) with the column shard; neighbours in the tree have neighbouring numbers.

    A node that is to hold n leaves is cut where n // 2 of n parts of its weight lie left. Its widest dimension is the one whose
    range is the largest share of that of all rows.
    """
    spark = rows.sparkSession
    first = rows.select(F.size("dims").alias("n")).first()
    if first is None:
        return rows.withColumn("shard", F.lit(0))
    d = first["n"]
    ends = [f(F.get(c, F.lit(i))).alias(f"{side}_{c}{i}") for side, f in (("lo", F.min), ("hi", F.max)) for c, n in (("dims", d), ("ties", TIES)) for i in range(n)]
    rows, leaves, width = rows.withColumn("node", F.lit(1).cast("long")), {1: (0, shards)}, None
    while any(n > 1 for _, n in leaves.values()):
        goals = {}
        stats = rows.groupBy("node").agg(F.sum("size").alias("weight"), F.count("*").alias("n"), *ends).collect()
        if width is None:
            width = [stats[0][f"hi_dims{i}"] - stats[0][f"lo_dims{i}"] for i in range(d)]
        for s in stats:
            n = leaves[s["node"]][1]
            if n > 1:
                wide = max(range(d), key=lambda i: (s[f"hi_dims{i}"] - s[f"lo_dims{i}"]) / width[i] if width[i] else 0.0)
                columns = [f"dims{wide}", *(f"ties{i}" for i in range(TIES))]
                goals[s["node"]] = {"widest": wide, "low": [s[f"lo_{c}"] for c in columns], "high": [s[f"hi_{c}"] for c in columns], "weight": s["weight"], "want": s["weight"] * (n // 2) / n}
        cuts = _cuts(rows, goals, tolerance)
        table = _table(spark, cuts, {"node": pa.int64(), "widest": pa.int32(), "bound": pa.list_(pa.float64()), "inclusive": pa.bool_()})
        keys = F.slice(F.concat(F.array(F.get("dims", "widest")), "ties"), F.lit(1), F.size("bound"))
        left = (keys < F.col("bound")) | (F.col("inclusive") & (keys == F.col("bound")))
        rows = rows.join(small(table, len(cuts)), "node", "left").withColumn("node", F.when(F.col("bound").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1)))
        rows = checkpoint(rows.drop("widest", "bound", "inclusive"))
        cut = {c["node"] for c in cuts}
        # Empty nodes drop out here: no row asks for their number.
        leaves = {c: v for k, (at, n) in leaves.items() if k in cut for c, v in ((2 * k, (at, n // 2)), (2 * k + 1, (at + n // 2, n - n // 2)))} | {k: v for k, v in leaves.items() if k not in cut and v[1] == 1}
    numbers = _table(spark, [{"node": k, "shard": at} for k, (at, _) in leaves.items()], {"node": pa.int64(), "shard": pa.int32()})
    return rows.join(small(numbers, len(leaves)), "node").drop("node")


def numbered(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds slot: gapless from 0 in each shard. Shards are numbered in pieces by the hash of ``order``, so that no task sorts a whole one."""
    pieces = max(1, math.ceil(rows.count() / SLOT_ROWS))
    rows = rows.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    counts = rows.groupBy(shard, "_piece").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_from", F.sum("_n").over(W.partitionBy(shard).orderBy("_piece")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(W.partitionBy(shard, "_piece").orderBy(*order)) - 1
    return rows.withColumn("_rank", rank).join(small(offsets), [shard, "_piece"]).withColumn("slot", (F.col("_from") + F.col("_rank")).cast("long")).drop("_piece", "_from", "_rank")


def shard(docs: DataFrame, shards: int = 16, text: str = "text", id: str = "doc_id", dims: dict[str, Column] | None = None, target_bytes: int | None = None) -> DataFrame:
    """One row per input row: id, size (bytes of the text and 1), text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    ``target_bytes`` sets the number of shards from the total size instead. Shards differ in bytes by the tolerance of the cuts
    or one document. Equal texts share their coordinates and so a shard, unless a cut has to go through them: then they part by id,
    and equal rows, which are interchangeable, by a number. Null texts count as empty; null or non-finite coordinates count as 0.
    Other columns are ignored. An empty table gives an empty result; with fewer documents than shards some shards stay empty.
    """
    t = text_or_empty(text)
    clean = [F.coalesce(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c), F.lit(0.0)) for c in (d.cast("double") for d in (dims or text_dimensions(text)).values())]
    high = lambda h: F.shiftright(h, 11).cast("double")  # noqa: E731  53 bits, exact in a double
    rows = docs.select(
        F.col(id).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("crc"), F.array(*clean).alias("dims"),
        F.array(high(F.xxhash64(t)), high(F.xxhash64(F.lit(7), F.col(id))), high(F.xxhash64(F.monotonically_increasing_id()))).alias("ties"),
    )
    rows = checkpoint(rows)
    if target_bytes:
        shards = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed = checkpoint(kd_tree(rows, shards).select("id", "size", "crc", "shard", F.get("ties", F.lit(TIES - 1)).alias("tie")))
    return numbered(placed, "shard", ["id", "crc", "size", "tie"]).select(
        F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
