"""Search with facets, and counts by groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import text_contains_any_field
from ..functions.text import first_words, group_prefix_stripped, squeeze
from ..session import bounded
from .hierarchy import label

UNSTATED = "(unstated)"
SHAPE = ("source", "name", "condition", "concept", "stage", "type")


def unified(df: DataFrame, source: str, **columns: str) -> DataFrame:
    """Rows of one source in the common shape; columns it lacks are null, empty types are unstated."""
    has = lambda c: F.trim(F.col(columns[c])) if c in columns else F.lit(None).cast("string")
    type_ = F.when(F.coalesce(has("type"), F.lit("")) == "", UNSTATED).otherwise(has("type"))
    return df.select(F.lit(source).alias("source"), *[has(c).alias(c) for c in SHAPE[1:-1]], type_.alias("type"))


def all_sources(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def search(rows: DataFrame, query: str | None = None, stage: str | None = None, type: str | None = None, relations: DataFrame | None = None) -> DataFrame:
    """Rows that fit every facet given, with relation (child, parent, sibling, exact, or text).

    A stage leaves out sources without stages. A query that settled on a concept takes the rows whose condition is related to it
    (relations: condition, relation) and no others; without relations it takes those with the query anywhere in their fields."""
    out = rows
    if stage:
        out = out.where(F.lower("stage").contains(stage.lower()))
    if type:
        out = out.where(F.lower("type").contains(type.lower()))
    if query and relations is not None:
        named = relations.select("condition", label(F.col("relation")).alias("relation")).where("relation is not null").groupBy("condition").agg(F.min("relation").alias("relation"))
        return out.join(bounded(named), "condition")
    if query:
        return out.where(text_contains_any_field(F.lit(query), *[F.col(c) for c in SHAPE[1:]])).withColumn("relation", F.lit("text"))
    return out.withColumn("relation", F.lit(None).cast("string"))


def facet_counts(df: DataFrame, *facets: str) -> DataFrame:
    """Facet, value, n for several facets in one pass (grouping sets)."""
    id_ = F.grouping_id()
    sets = [[F.col(f)] for f in facets]
    rows = df.groupingSets(sets, *[F.col(f) for f in facets]).agg(id_.alias("g"), F.count("*").alias("n"))
    bit = {f: (1 << len(facets)) - 1 - (1 << (len(facets) - 1 - i)) for i, f in enumerate(facets)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in facets:
        name, value = F.when(F.col("g") == bit[f], f).otherwise(name), F.when(F.col("g") == bit[f], F.col(f).cast("string")).otherwise(value)
    return rows.select(name.alias("facet"), value.alias("value"), "n")


def histogram(df: DataFrame, column: str, total: DataFrame | None = None) -> DataFrame:
    """Value, n and whole percent of all."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast((total or df).agg(F.count("*").alias("of")))).select(column, "n", F.floor(100 * F.col("n") / F.col("of")).cast("long").alias("percent"))


def by_first_words(df: DataFrame, title: str, n: int, strip_prefixes: bool = False, members: bool = True) -> DataFrame:
    """A10: header (the first n words of the first member; case does not part groups), size and, if asked for, members (sorted, distinct).

    Without members nothing is gathered: a header that very many titles share is a count."""
    t = group_prefix_stripped(F.col(title), strip_prefixes)
    rows = df.select(t.alias("t")).where("t <> ''").distinct().groupBy(first_words(F.col("t"), n).alias("key"))
    rows = rows.agg(F.min("t").alias("first"), F.count("*").cast("int").alias("size"), *([F.sort_array(F.collect_list("t")).alias("members")] if members else []))
    header = F.array_join(F.slice(F.split(squeeze(F.col("first")), " "), 1, n), " ")
    return rows.select(header.alias("header"), *(["members"] if members else []), "size")


def collisions(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(value, n) and how many rows share a positive value with another."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return counts, counts.agg(F.coalesce(F.sum(F.when((F.col("n") > 1) & (F.col(value) > 0), F.col("n"))), F.lit(0)).alias("colliding"))


def hits(df: DataFrame, **patterns: Column) -> DataFrame:
    """Rows with the number of patterns that hit (n_hits) and one 0/1 column for each."""
    flags = {k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in patterns.items()}
    out = df.withColumns(flags)
    return out.withColumn("n_hits", sum((F.col(k) for k in flags), F.lit(0)))


def grouped(df: DataFrame, group: str, item: str) -> DataFrame:
    """Group, members (sorted, distinct), size and place (most members first, equal ones by name), in that order."""
    from pyspark.sql import Window as W

    each = df.select(group, item).distinct()
    sizes = each.groupBy(group).agg(F.count("*").alias("size"))
    # One short row per group is ranked, never its members.
    placed = sizes.withColumn("place", F.row_number().over(W.orderBy(F.desc("size"), group)).cast("long"))
    members = each.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("members"))
    return members.join(placed, group).orderBy("place")


def largest_groups(df: DataFrame, key: str, top: int) -> DataFrame:
    """The ``top`` most frequent values; equal counts by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(top)
