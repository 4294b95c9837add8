"""Exact dedup (10): a tree of merges over sorted runs of digests.

Each input partition is a run: its distinct digests in order, with the count and the smallest row of each. A run is cut into lanes
by the leading bits of the digest. Runs are exchanged in binomial rounds: run i hands its lanes to the run whose number is i with
its low bits cleared, where the same lanes of all runs of the group are merged in order, keeping of each digest the sum of the
counts and the smallest row. A round does one binomial step for each bit it clears; as many bits as leave at most ROUNDS rounds.
A lane is a task, so the last run of all is as many tasks as lanes, and a merge streams: runs are sorted, then aggregated by order.
A digest that a third of all rows share is one entry in each run, so no task ever sees the copies themselves.

Rows merge only where SHA-256, a second independent 64-bit hash and the length all agree, at every level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hub_join, keep_rows, text_or_empty

#: Only runs of white space that are not already one space; the result is that of replacing every run by one space.
_UNEVEN = r"\x20*[\x09-\x0D][\x20\x09-\x0D]*|\x20{2,}"
_KEY = ["sha", "hash2", "length"]
#: Exchanges of runs at most.
ROUNDS = 3


def normalised(text: str | Column) -> Column:
    """Every run of space, tab, LF, VT, FF, CR as one space; null as empty."""
    return F.regexp_replace(text_or_empty(text), _UNEVEN, " ")


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, row (unique), sha (binary), hash2, length for every row, checkpointed: texts are read once and left behind."""
    norm = docs.select(F.col(id).alias("id"), normalised(text).alias("t"))
    return checkpoint(
        norm.select("id", F.unhex(F.sha2("t", 256)).alias("sha"), F.xxhash64("t").alias("hash2"), F.length("t").alias("length"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"))
    )


def merged(prints: DataFrame, bits: int | None = None) -> DataFrame:
    """One row per distinct text: key, n (rows), keep (the smallest id, nulls last, then row). ``bits`` of a run's number are cleared in a round."""
    runs = (prints.agg(F.max("run")).first()[0] or 0) + 1
    depth = (runs - 1).bit_length()
    bits = bits or max(1, math.ceil(depth / ROUNDS))
    # As many lanes as runs, so that no task grows when runs become fewer.
    lane = F.shiftright(F.conv(F.hex(F.substring("sha", 1, 3)), 16, 10).cast("int"), 24 - min(depth, 24))
    own = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))
    level = prints.withColumn("lane", lane).groupBy("run", "lane", *_KEY).agg(F.count("*").alias("n"), F.min(own).alias("keep"))
    for low in range(bits, depth + bits, bits):
        to = F.shiftleft(F.shiftright("run", low), low)
        # Runs change hands by number and lane only; the order they are put in is that of the merge.
        sent = level.withColumn("run", to).repartition(F.col("run"), F.col("lane")).sortWithinPartitions("run", "lane", *_KEY)
        level = sent.groupBy("run", "lane", *_KEY).agg(F.sum("n").alias("n"), F.min("keep").alias("keep"))
    return level.select(*_KEY, "n", "keep")


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", bits: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after every run of white space is made one space; null counts as empty, so all null and
    empty texts form one group. Of equal texts the row with the smallest id stays (null ids last); of rows that have even the
    id in common exactly one stays. Other columns are ignored. An empty table gives an empty result.
    """
    prints = fingerprints(docs, text, id)
    groups = merged(prints, bits).where(F.col("n") > 1)
    # Texts that occur once need no partner: only groups travel, those of many rows by broadcast.
    out = hub_join(prints.withColumn("key", F.struct(*_KEY)), groups.select(F.struct(*_KEY).alias("key"), F.col("n").alias("_rows"), "n", "keep"), "key", "_rows", prints.count(), "left")
    keep = F.coalesce(F.col("keep.row"), F.col("row"))
    return out.select(
        F.col("id").alias(id),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (keep == F.col("row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    decided = exact_dedup(docs, text, id).select(F.col(id).alias("_id"), F.unhex("text_sha256").alias("_sha"), "kept", F.col(id).eqNullSafe(F.col("keep_id")).alias("again"))
    return keep_rows(docs, decided, id, F.unhex(F.sha2(normalised(text), 256)))
