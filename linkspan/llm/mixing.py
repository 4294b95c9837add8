"""Mixing sources to target weights (3): hash-threshold histograms.

Every document has a 60-bit hash of its id and text. A source that is to give ``r`` words more than whole passes over it takes
the documents whose hash lies below a threshold. The threshold comes from a histogram of words by source and leading 12 bits;
only documents of the bucket in which the budget ends are counted again by the next 12 bits, and so on until that bucket holds
one hash value. Nothing is sorted, thresholds of smaller budgets are nested in those of larger ones, and what travels is one
row per source and bucket (map-side sums first, so a source with a third of all rows costs no more than another). Rows that agree
in id and text share a hash; where a budget ends inside such rows they are numbered, and as many are taken as come nearest to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, n_words, small, text_or_empty

BITS, STEP = 60, 12
#: Weights of the sources in their order, repeating; words wanted as a share of all; passes over a source at most.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2


def _hash(text: str, id: str) -> Column:
    own = F.concat_ws("|", F.coalesce(F.col(id).cast("string"), F.lit("?")), F.md5(text_or_empty(text)))
    return F.conv(F.substring(F.md5(own), 1, BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id") -> DataFrame:
    """id, source, size in words and hash of every row. Rows that agree in id and text share a hash."""
    return docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("src"), n_words(text).alias("size"), _hash(text, id).alias("h"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running totals, each row included, in a global order, and the total of all rows as ``<name>_all``.

    Rows are sorted by range into partitions; only one row per partition is added up in one place.
    """
    part = checkpoint(rows.orderBy(*order)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    part = checkpoint(part)
    totals = part.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before, all_ = W.orderBy("_part"), W.partitionBy()
    totals = totals.select("_part", *[(F.sum(f"_{n}").over(before) - F.col(f"_{n}")).alias(f"_{n}") for n in sums], *[F.sum(f"_{n}").over(all_).alias(f"{n}_all") for n in sums])
    here = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    out = part.withColumns({n: F.sum(c).over(here) for n, c in sums.items()}).join(small(totals), "_part")
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", "_at", *[f"_{n}" for n in sums])


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(src, source_size, target): budgets by weight, none above ``passes`` times its source, the excess shared again by weight.

    Sources in order of cap over weight: the first that stays below its cap fixes the level of all after it. Ranks and sums over
    sources are running totals (``running``), so that there may be very many sources.
    """
    by = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    source = [F.col("src").asc_nulls_last()]
    by = running(by, source, {"rank": F.lit(1).cast("long")})
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))).drop("rank", "rank_all")
    by = by.withColumn("cap", passes * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    by = running(by, [F.col("ratio").asc(), *source], {"caps": F.col("cap"), "ws": F.col("w"), "sizes": F.col("source_size")})
    by = by.withColumn("level", (F.lit(float(share)) * F.col("sizes_all") - (F.col("caps") - F.col("cap"))) / (F.col("ws_all") - F.col("ws") + F.col("w")))
    by = checkpoint(by)
    open_ = by.where(F.col("cap") > F.col("level") * F.col("w"))
    first = open_.agg(F.min(F.struct("ratio", F.col("src").isNull().alias("no"), "src", "level"))["level"].alias("first"))
    by = by.join(F.broadcast(first))  # one row
    capped = F.col("first").isNull() | (F.col("cap") <= F.col("first") * F.col("w"))
    return by.select("src", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("first") * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """(src, source_size, target, passes, below, at, most): documents of a source are taken ``passes`` times, those with h < below once
    more, and so are ``most`` of those with h = at (which is null but where there are several)."""
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = checkpoint(goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    n = goal.count()
    edge = goal.select(F.col("src").alias("_src"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below_sum"))
    spread = rows
    for done in range(STEP, BITS + 1, STEP):
        bucket = F.shiftright("h", BITS - done)
        inside = spread.join(small(edge, n), F.col("src").eqNullSafe(F.col("_src")) & (F.shiftright("h", BITS - done + STEP) == F.col("prefix")))
        hist = inside.groupBy("src", bucket.alias("b")).agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("rest").alias("rest"), F.first("below_sum").alias("below_sum"))
        upto = F.col("below_sum") + F.sum("words").over(W.partitionBy("src").orderBy("b"))
        hist = hist.withColumn("upto", upto)
        at = hist.where(F.col("upto") >= F.col("rest")).groupBy("src").agg(F.min(F.struct("b", "upto", "words", "lo", "hi", "rest", "n")).alias("x"))
        edge = checkpoint(at.select(F.col("src").alias("_src"), "x.rest", F.col("x.b").alias("prefix"), (F.col("x.upto") - F.col("x.words")).alias("below_sum"), "x.words", "x.lo", "x.hi", "x.n"))
        if edge.where(F.col("lo") != F.col("hi")).isEmpty():
            break
    over, under = F.col("below_sum") + F.col("words") - F.col("rest"), F.col("rest") - F.col("below_sum")
    several = (F.col("lo") == F.col("hi")) & (F.col("n") > 1)
    most = F.ceil(F.try_divide(under * F.col("n"), F.col("words")) - 0.5).cast("long")  # equal rows are of one size
    edge = edge.select("_src", F.when(~several & (over < under), F.col("hi") + 1).otherwise(F.col("lo")).alias("below"), F.when(several, F.col("lo")).alias("at"), F.when(several, most).alias("most"))
    return goal.join(edge, F.col("src").eqNullSafe(F.col("_src")), "left").select("src", "source_size", "target", "passes", F.coalesce("below", F.lit(0)).cast("long").alias("below"), "at", "most")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (src, h, any others) with the columns of their source's plan and ``copies``."""
    met = rows.join(small(plan.withColumnRenamed("src", "_src")), F.col("src").eqNullSafe(F.col("_src"))).drop("_src")
    out = met.withColumn("copies", F.col("passes") + F.when(F.col("h") < F.col("below"), 1).otherwise(0))
    if plan.where("at is not null").isEmpty():
        return out
    # Equal rows have numbers by range, so that none of them need be in one task.
    edge = F.coalesce(F.col("h") == F.col("at"), F.lit(False))
    some = running(out.where(edge).withColumn("_row", F.monotonically_increasing_id()), [F.col("src").asc_nulls_last(), F.col("_row")], {"nth": F.lit(1).cast("long")}).drop("nth_all")
    some = checkpoint(some)
    least = some.groupBy(F.col("src").alias("_src")).agg(F.min("nth").alias("_first"))
    some = some.join(small(least), F.col("src").eqNullSafe(F.col("_src")))
    some = some.withColumn("copies", F.col("passes") + F.when(F.col("nth") - F.col("_first") < F.col("most"), 1).otherwise(0))
    return out.where(~edge).unionByName(some.select(*out.columns))


def _copies(rows: DataFrame, weights, share: float, passes: int) -> DataFrame:
    return _with_copies(rows, checkpoint(thresholds(rows, targets(rows, weights, share, passes))))


def mix(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (size times the number of copies the mix takes).

    A source gives its target to within half of the document at its threshold; of rows that agree in id and text, which are
    interchangeable, as many are taken as come nearest. Null texts have size 0; a null source is a source of its own and comes last; sources without words have target 0.
    The result depends on the rows alone, so reruns agree. Other columns are ignored; an empty table gives an empty result.
    """
    rows = _copies(checkpoint(sized(docs, text, source, id)), weights, share, passes)
    return rows.select(F.col("id").alias(id), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, columns unchanged. Only thresholds are joined to it."""
    rows = checkpoint(sized(docs, text, source, id))
    plan = checkpoint(thresholds(rows, targets(rows, weights, share, passes)))
    taken = _with_copies(docs.select(F.struct("*").alias("_doc"), _hash(text, id).alias("h"), F.col(source).cast("string").alias("src")), plan)
    return taken.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_doc.*")
