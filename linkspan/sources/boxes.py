"""Tables out of words with places, as a reader of pages gives them: doc, page, x0, x1, y (top, growing downwards), text.

Words become lines, lines rows, and white strips that no line of several cells crosses part the columns of a document. Windows hold a
page at most; columns are found from the distinct extents of cells on a grid of whole units, so a document's number of pages doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

PAGE = ["doc", "page"]


def segments(words: DataFrame, line_gap: float, word_gap: float, row_gap: float) -> DataFrame:
    """Doc, page, row, line, lo, hi, text, n_on_line: words of a line with no more than ``word_gap`` between them are one segment.

    A line goes on while the next word is at most ``line_gap`` lower, a row while the next line is at most ``row_gap`` lower. Words without
    text, page or place are none; words at one place are in order of their text.
    """
    w = words.select(*PAGE, *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y")], F.trim("text").alias("text"))
    w = w.where("doc IS NOT NULL AND page IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND y IS NOT NULL AND text <> ''")
    down = W.partitionBy(*PAGE).orderBy("y", "x0", "text")
    gap = F.col("y") - F.lag("y").over(down)
    w = w.withColumns({"_line": (gap > line_gap).cast("int"), "_row": (gap > row_gap).cast("int")})
    w = w.withColumns({"line": F.coalesce(F.sum("_line").over(down), F.lit(0)), "row": F.coalesce(F.sum("_row").over(down), F.lit(0))})
    along = W.partitionBy(*PAGE, "line").orderBy("x0", "y", "text")
    before = F.max("x1").over(along.rowsBetween(W.unboundedPreceding, -1))
    w = w.withColumn("_new", F.coalesce(F.col("x0") - before > word_gap, F.lit(False)).cast("int")).withColumn("_seg", F.sum("_new").over(along))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y", "text"))), lambda x: x["text"]), " ")
    out = w.groupBy(*PAGE, "line", "_seg").agg(F.min("row").alias("row"), F.min("x0").alias("lo"), F.max("x1").alias("hi"), said.alias("text"))
    return out.withColumn("n_on_line", F.count("*").over(W.partitionBy(*PAGE, "line"))).drop("_seg")


def columns(segs: DataFrame) -> DataFrame:
    """Doc, starts (left ends of the columns in order), of documents that have a line of several segments. Lines of one segment, as banners are, part nothing."""
    extents = segs.where("n_on_line > 1").select("doc", F.floor("lo").alias("lo"), F.ceil("hi").alias("hi")).groupBy("doc", "lo").agg(F.max("hi").alias("hi"))
    order = W.partitionBy("doc").orderBy("lo")
    reached = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    return extents.withColumn("first", F.coalesce(F.col("lo") > reached, F.lit(True))).where("first").groupBy("doc").agg(F.sort_array(F.collect_list("lo")).alias("starts"))


def extract(words: DataFrame, line_gap: float = 4, word_gap: float = 8, row_gap: float = 15) -> DataFrame:
    """Doc, page, row (by page, from 0), cells, header of every row but the header: the first row of a document, and rows that repeat it.

    A cell is all that a row has in a column, line by line; '' is an empty one. A segment belongs to the last column that starts at or before
    it; a document without a line of several segments has one column. An empty table gives none. Rows don't go on over the end of a page.
    """
    segs = segments(words, line_gap, word_gap, row_gap)
    placed = segs.join(columns(segs), "doc", "left").withColumn("starts", F.coalesce("starts", F.array(F.lit(0).cast("long"))))
    placed = placed.withColumn("col", F.greatest(F.size(F.filter("starts", lambda s: s <= F.floor("lo"))) - 1, F.lit(0)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "lo", "text"))), lambda x: x["text"]), " ")
    cells = placed.groupBy(*PAGE, "row", "col").agg(said.alias("text"), F.max(F.size("starts")).alias("n"))
    by = cells.groupBy(*PAGE, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"), F.max("n").alias("n"))
    by = by.select(*PAGE, "row", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.col("m")[i], F.lit(""))).alias("cells"))
    header = by.groupBy("doc").agg(F.min_by("cells", F.struct("page", "row")).alias("header"))
    return by.join(header, "doc").where("cells <> header")


def cell(name: str) -> Column:
    """The cell under a name of the header; of columns with one name the first, null where none has it."""
    at = F.array_position("header", name).cast("int")
    return F.when(at > 0, F.get("cells", at - 1))


def is_banner() -> Column:
    """A row that has nothing but its first cell, in a table of several columns."""
    return (F.size("cells") > 1) & F.forall(F.slice("cells", 2, F.size("cells")), lambda c: c == "")
