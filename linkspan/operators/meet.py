"""Texts and terms that meet where one contains the other, without holding every text against every term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded, checkpoint

#: So many terms are looked for in every text as it is read, which costs about what cutting it into grams does; beyond that they meet by grams.
FEW, GRAM = 64, 4


def _grams(c: Column, size: Column | int) -> Column:
    """Distinct pieces of ``size`` characters of a text that is at least as long."""
    n = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, n)))


def containing(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(key, term): the distinct terms that stand in a text of the key, letter by letter; empty terms stand in none.

    Few terms are broadcast. Many meet the texts by the piece of GRAM characters of a term that the fewest texts have (a shorter term
    is its own piece), and only pairs that share it are looked at; a term with a piece that no text has is in none.
    """
    t = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    w = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    few = bounded(w, FEW)
    if few is not w:
        return t.join(few, F.col("text").contains(F.col("term"))).select("key", "term").distinct()
    w = w.withColumn("size", F.least(F.length("term"), F.lit(GRAM)))
    pieces = checkpoint(w.select("term", F.explode(_grams(F.col("term"), F.col("size"))).alias("gram")))
    wanted = bounded(pieces.select("gram").distinct())
    sizes = sorted(r["size"] for r in w.select("size").distinct().collect())  # at most GRAM
    cut = F.array_distinct(F.flatten(F.array(*[F.when(F.length("text") >= n, _grams(F.col("text"), n)).otherwise(F.array().cast("array<string>")) for n in sizes])))
    grams = checkpoint(t.select("key", F.explode(cut).alias("gram")).join(wanted, "gram", "left_semi"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = pieces.join(often, "gram", "left").groupBy("term").agg(F.min_by("gram", "n").alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all")).where("all").select("term", "gram")
    pairs = grams.join(rarest, "gram").select("key", "term").distinct()
    return pairs.join(t, "key").where(F.col("text").contains(F.col("term"))).select("key", "term").distinct()
