"""Tables read back from words on pages."""

import random

from pyspark.sql import functions as F

from linkspan.sources import boxes

SCHEMA = "doc string, page int, x0 double, x1 double, y double, text string"
XS = (10, 130, 260)  # three words of five letters are 102 wide, so that columns stay further apart than words


def laid(doc, page, y, cells):
    """Words of a row, a cell being a list of lines."""
    out = []
    for x, lines in zip(XS, cells):
        for i, line in enumerate(lines):
            at = x
            for n, word in enumerate(line.split()):
                out.append((doc, page, float(at), float(at + 6 * len(word)), float(y + 10 * i + n % 3), word))
                at += 6 * (len(word) + 1)
    return out


def read(spark, words):
    return sorted(map(tuple, boxes.extract(spark.createDataFrame(words, SCHEMA)).select("doc", "page", "cells", "header").collect()))


def test_round_trip(spark):
    rng = random.Random(5)
    head = [["Condition"], ["Concept of", "interest"], ["Notes"]]
    words, want = [], []
    for doc in ("a", "b"):
        for page in (1, 2, 3):
            words += laid(doc, page, 10, head)
            for r in range(6):
                cells = [[" ".join(rng.choice("red blue hot small of".split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))] for _ in XS]
                if r % 3 == 1:
                    cells[rng.randrange(3)] = []
                if page == 2:  # a column that a whole page leaves empty keeps its place
                    cells[1] = []
                cells[0] = cells[0] or ["x"]
                words += laid(doc, page, 60 + 60 * r, cells)
                want.append((doc, page, [" ".join(c) for c in cells], ["Condition", "Concept of interest", "Notes"]))
    rng.shuffle(words)
    assert read(spark, words) == sorted(want)


def test_edges(spark):
    assert read(spark, []) == []
    nothing = [("a", 1, None, 5.0, 1.0, "x"), ("a", 1, 1.0, 5.0, None, "x"), (None, 1, 1.0, 5.0, 1.0, "x"), ("a", 1, 1.0, 5.0, 1.0, "  "), ("a", 1, 1.0, 5.0, 1.0, None)]
    assert read(spark, nothing) == []
    # One column only: the first line is the header, a word that is there twice stays twice, a long one stays whole.
    long = "w" * 5000
    words = [("c", 1, 10.0, 40.0, 10.0, "Name"), ("c", 1, 10.0, 30.0, 50.0, "ab"), ("c", 1, 10.0, 30.0, 50.0, "ab"), ("c", 1, 10.0, 30000.0, 90.0, long)]
    assert read(spark, words) == [("c", 1, ["ab ab"], ["Name"]), ("c", 1, [long], ["Name"])]


def test_banners_and_names(spark):
    words = laid("a", 1, 10, [["Key"], ["Name"], ["Key"]]) + [("a", 1, 10.0, 290.0, 40.0, "Division of all that is wide")] + laid("a", 1, 70, [["1"], ["x"], ["2"]])
    out = boxes.extract(spark.createDataFrame(words, SCHEMA))
    got = out.select(boxes.is_banner().alias("b"), boxes.cell("Key").alias("k"), boxes.cell("none").alias("n"), F.col("cells")[2].alias("c")).orderBy("row").collect()
    assert [tuple(r) for r in got] == [(True, "Division of all that is wide", None, ""), (False, "1", None, "2")]
