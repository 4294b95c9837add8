"""What the operators share: tables, checkpoints, words, connected components."""

from __future__ import annotations

import math
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Functions of this module travel to executors whole, so that a cluster need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` that the session's checkpoints go to."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="linkspan-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder of ``spark.checkpoint.dir`` and read from there, so that a lost executor costs no recomputation.

    Where the session names no folder, one is made on this machine, if all executors are on it too (master ``local``); on a cluster
    that raises. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes the files when they are no longer in use."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut, and what is read more than once is computed once.

    For rows that are mostly numbers or sorted ids this takes a fraction of a checkpoint's disk. The files lie beside the checkpoints
    and go with that folder."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows of a batch from Spark that Python holds as objects at once.
ROWS_AT_ONCE = 256


def small_batches(df: DataFrame, rows: int = 4 * ROWS_AT_ONCE) -> DataFrame:
    """``df``, whose session from now on hands Python workers batches of at most so many rows.

    The session's default, ten thousand, is meant for rows of numbers; of whole texts that is tens of megabytes, held several times over."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def slices(batches, rows: int = ROWS_AT_ONCE):
    """Record batches cut into small ones without copying, so that a worker's memory does not follow the size of Spark's batches."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: str | Column) -> Column:
    """Number of words (``WORD``); null counts as empty."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


#: A table of a few short columns may be broadcast with at most so many rows (some 10 MB); every use counts the rows first.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast when its counted rows are within BROADCAST_ROWS, else left for a shuffled join (AQE splits hot keys)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: Keys whose rows are joined by a broadcast, at most; below LEAST rows a key is none of them.
HUBS, LEAST = 50_000, 64


def hub_join(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (one row per key; its column ``n``, dropped, is the number of rows that have the key).

    Keys with a large share of the ``total`` rows, which cannot be more than HUBS, are joined by a broadcast where the rows are, so
    that no task gets all rows of a key; the others are shuffled. ``how``: inner, or left for rows without facts.
    """
    least = max(LEAST, math.ceil(total / HUBS))
    hubs, rest = facts.where(F.col(n) >= least).drop(n), facts.where(F.col(n) < least).drop(n)
    others = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(rest, key, how)
    return rows.join(F.broadcast(hubs), key).unionByName(others)


#: Edges read by a task of a round.
EDGES = 10_000


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges``.

    Alternating large-star and small-star rounds until nothing changes: every round joins and groups edges by one end, nothing is
    gathered on the driver but a count and a hash sum, and the rounds needed grow with the logarithm of the longest path. Edges meet the
    minimum of their end by a broadcast while there are at most BROADCAST_ROWS of them, else by ``hub_join``, for the centres of large
    stars. An empty edge table gives an empty result; self-edges and repeated edges change nothing.
    """

    def met(rows: DataFrame, low: DataFrame, edges: int, of: int) -> DataFrame:
        return rows.join(F.broadcast(low.drop("n")), "u") if edges <= BROADCAST_ROWS else hub_join(rows, low, "u", "n", of)

    kind = edges.schema[a].dataType
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v")).distinct()
    e = checkpoint(e)
    seen, now = None, _state(e)
    while now != seen:
        tasks = max(1, math.ceil(now[0] / EDGES))
        e = e.coalesce(tasks)  # few edges are few tasks and few files in every shuffle of a round
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # Each join reads its rows several times: what it gives is written down, or the plan of a round grows with their product.
        large = checkpoint(met(both.where(F.col("v") > F.col("u")), low, now[0], 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()).coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hooked = met(large, low, now[0], now[0]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(hooked.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        seen, now = now, _state(e)
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def named(members: DataFrame, name: str, total: int) -> DataFrame:
    """``members`` (component, ``name``, any others) with the column ``first``: the least ``name`` of the component."""
    least = members.groupBy("component").agg(F.min(name).alias("first"), F.count("*").alias("_n"))
    return hub_join(members, least, "component", "_n", total)


def keep_rows(docs: DataFrame, decided: DataFrame, id: str, digest: Column) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. ``decided``: _id, _sha, kept, again, one row per row of docs.

    Rows that go are taken out by id and digest of the text, so that texts need not be shuffled while few go (``small`` counts
    them). ``again`` marks rows that go and agree in both with the row that stays; those are settled by an aggregation with
    partial results, so that a row that is repeated very often never meets itself in one task.
    """
    gone = checkpoint(decided.where(~F.col("kept")).select("_id", "_sha", F.coalesce("again", F.lit(False)).alias("_again")))
    row = docs.select(F.struct("*").alias("_row"), F.col(id).alias("_i"), digest.alias("_s"))
    same = F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_s") == F.col("_sha"))
    kept = row.join(small(gone.drop("_again")), same, "left_anti").select("_row.*")
    again = gone.where("_again").select("_id", "_sha").distinct()
    if again.isEmpty():
        return kept
    once = row.join(small(again), same, "left_semi").groupBy("_i", "_s").agg(F.first("_row").alias("_row")).select("_row.*")
    return kept.unionByName(once)


by_value(__name__)
