"""One row per key. All of them are aggregations with partial results, so a key with very many rows costs one row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _columns(order: str | list[str]) -> Column:
    return F.struct(*([order] if isinstance(order, str) else order))


def first_per_key(df: DataFrame, keys: list[str], order: str | list[str] = "_ord") -> DataFrame:
    """Of each key the row that comes first; the order has to be total for a result that reruns keep."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), _columns(order)).alias("_x")).select(*keys, "_x.*")


def last_per_key(df: DataFrame, keys: list[str], order: str | list[str] = "_ord") -> DataFrame:
    """Of each key the row that comes last."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), _columns(order)).alias("_x")).select(*keys, "_x.*")


def preferred_or_first(df: DataFrame, keys: list[str], value: str, preferred: Column, order: str | list[str] = "_ord") -> DataFrame:
    """The last value that is preferred, else the first of any."""
    at = _columns(order)
    pick = F.coalesce(F.max_by(value, F.when(preferred, at)), F.min_by(value, at))
    return df.groupBy(*keys).agg(pick.alias(value))


def earliest(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """The least date of each key."""
    return df.groupBy(*keys).agg(F.min(date).alias(date))


def highest_priority(df: DataFrame, keys: list[str], value: str, priority: Column, order: str | list[str] = "_ord") -> DataFrame:
    """The value of highest priority; of equals the first."""
    ranked = df.withColumn("_p", priority).groupBy(*keys, "_p").agg(F.min_by(value, _columns(order)).alias(value))
    return ranked.groupBy(*keys).agg(F.max_by(value, "_p").alias(value))


def forward_fill(df: DataFrame, value: str, order: list[str], within: list[str], name: str | None = None) -> DataFrame:
    """The last value that is not null so far, within the rows of a file, page or key."""
    frame = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name or value, F.last(value, ignorenulls=True).over(frame))


def first_match(df: DataFrame, keys: list[str], label: str, list_rank: str, order: str = "_ord") -> DataFrame:
    """The label of the first list that has one, in the order of that list."""
    return df.groupBy(*keys).agg(F.min_by(label, F.struct(list_rank, order)).alias(label))


def first_verdict(events: DataFrame, source: str = "source", status: str = "status", order: str = "_ord") -> DataFrame:
    """The first health verdict of each source stands."""
    return events.groupBy(source).agg(F.min_by(status, order).alias(status))


def claimed_once(df: DataFrame, item: str, claimant_order: list[str]) -> DataFrame:
    """Each item belongs to the first that claims it."""
    return first_per_key(df, [item], claimant_order)
