"""Set operations over keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import first_per_key


def union_distinct(column: str, *frames: DataFrame) -> DataFrame:
    """Distinct values of a column over several frames, null and empty ones dropped."""
    rows = reduce(DataFrame.unionByName, [f.select(F.trim(column).alias(column)) for f in frames])
    return rows.where(F.col(column) != "").distinct()


def with_flag(name: str, **frames: DataFrame) -> DataFrame:
    """Frames one after another, each marked with the keyword it was passed by (``true`` and ``false`` as booleans)."""
    flag = {"true": True, "false": False}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(name, F.lit(flag.get(k, k))) for k, f in frames.items()])


def overlap_report(key: str, **sources: DataFrame) -> DataFrame:
    """Sources, n_keys: how many distinct keys occur in exactly which sources (their names sorted, joined by +)."""
    rows = reduce(DataFrame.unionByName, [f.select(F.col(key), F.lit(n).alias("source")).where(F.col(key).isNotNull()) for n, f in sources.items()])
    having = rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("source")), "+").alias("sources"))
    return having.groupBy("sources").agg(F.count("*").alias("n_keys"))


def common_keys(key: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys that both have."""
    return a.select(key).intersect(b.select(key))


def missing_from(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known yet."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def ordered_union(key: str, *frames: DataFrame, order: str = "_ord") -> DataFrame:
    """Distinct keys in the order of the frames and then of their rows: key, list_rank, order."""
    rows = reduce(DataFrame.unionByName, [f.select(key, F.lit(i).alias("list_rank"), order) for i, f in enumerate(frames)])
    return first_per_key(rows, [key], ["list_rank", order])


def id_set_union(df: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """The number of distinct ids under each key."""
    return df.groupBy(*keys).agg(F.count_distinct(ids).alias("n"))
