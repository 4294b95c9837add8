"""Names scored by what they share: words and three-letter pieces, each by how rare it is in the list.

The score of two names is 2 C / (A + B), the weights of what they share over the weights of both; it does not mind the order of words and little minds
a letter. Names meet only by a *prefix* of their features, the rarest first: to score at least ``s`` a name of weight A must share
C >= s A / (2 - s), so of two such names the rarest feature that they share lies in both prefixes. Nothing is missed, and frequent
features, which nearly all names have, are met by few. Weights are whole numbers, so that scores compare exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bounded, checkpoint

#: Least score in percent, names given for each text at most.
LEAST, BEST = 60, 3


def features(name: Column) -> Column:
    """Distinct words of a lower-case name, and three-letter pieces of ``^word$``."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    pieces = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(3)))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), F.flatten(F.transform(words, pieces))))


def _weighed(names: DataFrame, column: str, weights: DataFrame, unknown: Column, least: int) -> DataFrame:
    """column, f (weight and feature, rarest first), total, prefix."""
    each = names.select(column, F.explode(features(F.col(column))).alias("x")).join(bounded(weights), "x", "left")
    rows = each.groupBy(column).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("w", unknown).alias("w"), "x")), asc=False).alias("f"))  # a name's own features
    rows = rows.withColumn("total", F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x["w"]))
    step = lambda s, x: F.struct((s["left"] - x["w"]).alias("left"), F.when(s["left"] * (200 - least) >= F.col("total") * least, F.concat(s["p"], F.array(x["x"]))).otherwise(s["p"]).alias("p"))
    return rows.withColumn("prefix", F.aggregate("f", F.struct(F.col("total").alias("left"), F.array().cast("array<string>").alias("p")), step, lambda s: s["p"]))


def scored_names(texts: DataFrame, names: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """T, k, score (percent, rounded down), place: the first ``best`` names (k) of each text (t) that score at least ``least`` percent, ties by name.

    Cases do not matter; texts and names without a word are near nothing, repeated ones count once. A feature that no name has counts as one that a single name has."""
    low = lambda df, c: df.select(F.lower(F.trim(c)).alias(c)).where(F.col(c) != "").distinct()
    names = checkpoint(low(names, "k"))
    n = F.lit(names.count())
    weigh = lambda df: (F.floor(100 * F.log(n / df)) + 1).cast("long")
    weights = names.select(F.explode(features(F.col("k"))).alias("x")).groupBy("x").agg(weigh(F.count("*")).alias("w"))
    weights = checkpoint(weights)
    a, b = checkpoint(_weighed(low(texts, "t"), "t", weights, weigh(F.lit(1)), least)), checkpoint(_weighed(names, "k", weights, weigh(F.lit(1)), least))
    met = a.select("t", F.explode("prefix").alias("x")).join(b.select("k", F.explode("prefix").alias("x")), "x").select("t", "k").distinct()
    pairs = met.join(a.select("t", F.col("f").alias("fa"), F.col("total").alias("wa")), "t").join(b.select("k", F.col("f").alias("fb"), F.col("total").alias("wb")), "k")
    common = F.aggregate(F.array_intersect("fa", "fb"), F.lit(0).cast("long"), lambda s, x: s + x["w"])
    pairs = pairs.select("t", "k", common.alias("c"), (F.col("wa") + F.col("wb")).alias("both")).where(200 * F.col("c") >= least * F.col("both"))
    order = W.partitionBy("t").orderBy((F.col("c") / F.col("both")).desc(), "k")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best).select("t", "k", F.floor(200 * F.col("c") / F.col("both")).cast("int").alias("score"), "place")
