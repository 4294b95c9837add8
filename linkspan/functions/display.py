"""How results are shown, as native column expressions: tags and wrapped lists of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a drug that no vocabulary has, and the width of a line.
NOT_LISTED, WIDTH = " [not in RxNorm]", 72


def drug_tag(name: Column, in_vocabulary: Column) -> Column:
    """a drug's name, marked where no vocabulary has it; unknown counts as known."""
    return F.concat(name, F.when(F.coalesce(in_vocabulary, F.lit(True)), "").otherwise(NOT_LISTED))


def relation_tag(relation: Column) -> Column:
    """what a row is to the search; empty for what was searched itself, and without a relation."""
    silent = F.coalesce(relation, F.lit("")).isin("", "exact")
    return F.when(silent, "").otherwise(F.concat(F.lit("   ["), relation, F.lit(" of your search]")))


def wrapped(names: Column, indent: str, width: int = WIDTH) -> Column:
    """an array of names with commas between them, in lines of at most ``width``; later lines are indented by as many spaces as the first by ``indent``. No names give ''."""
    pieces = F.transform(names, lambda x, i: F.when(i < F.size(names) - 1, F.concat(x, F.lit(","))).otherwise(x))

    def step(s: Column, piece: Column) -> Column:
        start = s["line"].isNull()
        full = ~start & (F.length(s["line"]) + 1 + F.length(piece) > width)
        done = F.when(full, F.concat(s["done"], s["line"], F.lit("\n"))).otherwise(s["done"])
        line = F.when(start, F.concat(F.lit(indent), piece)).when(full, F.concat(F.lit(" " * len(indent)), piece)).otherwise(F.concat(s["line"], F.lit(" "), piece))
        return F.struct(done.alias("done"), line.alias("line"))

    empty = F.struct(F.lit("").alias("done"), F.lit(None).cast("string").alias("line"))
    return F.aggregate(F.coalesce(pieces, F.array().cast("array<string>")), empty, step, lambda s: F.concat(s["done"], F.coalesce(s["line"], F.lit(""))))
