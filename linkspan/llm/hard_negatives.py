"""Hard-negative mining (12): inner products bracketed by a pivot table.

With M no smaller than any vector's length, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) turn the inner product into a Euclidean
distance: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. The table of pivots holds the distance of every row to a few pivots. By the triangle
inequality |d(q', p) - d(x', p)| <= d(q', x') <= d(q', p) + d(x', p) for each pivot p, which brackets the score of a row; only rows
whose bracket reaches what is asked for are scored, exactly.

Anchors are a stated set and meet all rows in blocks, in two passes. First the best rows of the anchor's own label: rows and
anchors are dealt by label and number of block. Then the rows of other labels whose score lies in a band below a positive's:
rows are dealt by their nearest pivot and number of block, and an anchor goes only to pivots whose rows' distances leave room for
its bands. A block holds at most BLOCK rows and at most ANCHORS anchors and returns a few rows for each anchor, so that memory is
bounded, and a label or pivot with a third of all rows is many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_value, checkpoint, hub_join

by_value(__name__)

PIVOTS = 16
#: Rows (by hash) of which pivots are chosen, rows and anchors of a block, anchors scored at once. Pivots decide speed, never results.
SAMPLE, BLOCK, ANCHORS, AT_ONCE = 2000, 8192, 2048, 64
NO_ID, LONG = np.iinfo(np.int64).max, (1 - 2**63, 2**63 - 1)


def finite(vector: str | Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows of whole numbers in double precision."""
    return np.array([np.asarray(v, np.float64) for v in column], np.float64).reshape(len(column), -1)


def _scores(rows: np.ndarray, raw, at: np.ndarray, anchor: np.ndarray, own) -> np.ndarray:
    """Inner products of the rows ``at`` with an anchor: in doubles while these hold every sum, else in Python's whole numbers."""
    if rows.shape[1] * np.abs(rows[at]).max(initial=0) * np.abs(anchor).max(initial=0) < 2**53:
        return (rows[at] @ anchor).astype(np.int64)
    exact = [sum(int(x) * int(y) for x, y in zip(raw[i], own, strict=True)) for i in at]
    return np.array([min(max(s, LONG[0]), LONG[1]) for s in exact], np.int64)


def _lengths(v: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that gives all the length M."""
    return np.sqrt(np.maximum(most**2 - (v * v).sum(1), 0.0))


class Pivots:
    """Pivots in the space with one more dimension; vectors of another length meet them cut or filled with zeros."""

    def __init__(self, sample: list[np.ndarray], most: float, n: int = PIVOTS):
        self.most, width = most, max((len(v) for v in sample), default=0)
        v = np.zeros((len(sample), width))
        for i, x in enumerate(sample):
            v[i, : len(x)] = x
        self.points = np.concatenate([v, _lengths(v, most)[:, None]], 1)
        chosen = [0] if len(sample) else []
        near = np.full(len(sample), np.inf)
        while chosen and len(chosen) < min(n, len(sample)):  # the farthest point next
            near = np.minimum(near, ((self.points - self.points[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(near.argmax()))
        self.points = self.points[chosen]

    def distances(self, v: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Distance of each row (or anchor, whose last component is 0) to each pivot."""
        width = self.points.shape[1] - 1
        own, p = v[:, :width], self.points[:, : min(width, v.shape[1])]
        last = np.zeros(len(v)) if anchors else _lengths(v, self.most)
        # Components beyond the pivots' own count in full, as do those that a shorter vector lacks.
        square = (v * v).sum(1)[:, None] - 2 * own @ p.T + (self.points[:, :width] ** 2).sum(1) + (last[:, None] - self.points[:, width]) ** 2
        return np.sqrt(np.maximum(square, 0.0))


def bracket(pivots_x: np.ndarray, pivots_q: np.ndarray, square_q: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of each pair (anchor, row) by their distances to the pivots, with room for rounding."""
    low, high = np.zeros((len(pivots_q), len(pivots_x))), np.full((len(pivots_q), len(pivots_x)), np.inf)
    for p in range(pivots_x.shape[1]):
        x, q = pivots_x[:, p][None, :], pivots_q[:, p][:, None]
        np.maximum(low, np.abs(x - q), out=low)
        np.minimum(high, x + q, out=high)
    room = 1e-6 * (square_q[:, None] + most**2) + 1e-6
    base = square_q[:, None] + most**2
    return (base - high**2) / 2 - room, (base - low**2) / 2 + room


def _best(frame: pd.DataFrame, anchors: pd.DataFrame, most: float, k: int):
    """Per anchor the first k other rows of the block, by score and id."""
    rows, ids, rids = _matrix(frame["v"]), frame["key"].to_numpy(np.int64), frame["rid"].to_numpy(np.int64)
    table, out = np.stack(frame["pd"]), []
    for at in range(0, len(anchors), AT_ONCE):
        part = anchors.iloc[at : at + AT_ONCE]
        q = _matrix(part["v"])
        low, high = bracket(table, np.stack(part["qd"]), (q * q).sum(1), most)
        for i, (rid, own) in enumerate(zip(part["rid"], part["v"], strict=True)):
            others = rids != rid
            sure = low[i][others]
            need = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) > k else -np.inf  # k rows score at least so much
            left = np.nonzero(others & (high[i] >= need))[0]
            score = _scores(rows, frame["v"].to_numpy(), left, q[i], own)
            first = np.lexsort((ids[left], -score))[:k]
            out += [(rid, ids[j], s) for j, s in zip(left[first], score[first], strict=True)]
    return pd.DataFrame(out, columns=["rid", "key", "score"])


def _banded(frame: pd.DataFrame, anchors: pd.DataFrame, most: float, k: int, low_pc: int, high_pc: int):
    """Per anchor and positive the first k rows of the block that have another label and a score in the band."""
    rows, ids, labels = _matrix(frame["v"]), frame["key"].to_numpy(np.int64), frame["lab"].to_numpy()
    table, out = np.stack(frame["pd"]), []
    for at in range(0, len(anchors), AT_ONCE):
        part = anchors.iloc[at : at + AT_ONCE]
        q = _matrix(part["v"])
        low, high = bracket(table, np.stack(part["qd"]), (q * q).sum(1), most)
        for i, (rid, label, own, scores) in enumerate(zip(part["rid"], part["lab"], part["v"], part["scores"], strict=True)):
            bands = [(n, -(-low_pc * int(s) // 100), high_pc * int(s) // 100) for n, s in enumerate(scores)]
            bands = [(n, a, b) for n, a, b in bands if a <= b]
            if not bands:
                continue
            least, largest = min(a for _, a, _ in bands), max(b for _, _, b in bands)
            left = np.nonzero((labels != label) & (high[i] >= least) & (low[i] <= largest))[0]
            score = _scores(rows, frame["v"].to_numpy(), left, q[i], own)
            order = np.lexsort((ids[left], -score))
            left, score = left[order], score[order]
            for n, a, b in bands:
                j = np.searchsorted(-score, -b)
                out += [(rid, n, ids[x], s) for x, s in zip(left[j : j + k], score[j : j + k], strict=True) if s >= a]
    return pd.DataFrame(out, columns=["rid", "nth", "key", "score"])


def _dealt(rows: DataFrame, anchors: DataFrame, by: list[str], total: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of their blocks: within a value of ``by`` every row block meets every anchor block.

    ``anchors`` has the columns ``by`` too, a row for each value that an anchor goes to."""
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    n = n.join(anchors.groupBy(*by).agg(F.count("*").alias("_a")), by)
    n = checkpoint(n.select(*by, "_n", F.ceil(F.col("_n") / BLOCK).cast("int").alias("rb"), F.ceil(F.col("_a") / ANCHORS).cast("int").alias("ab")))
    key, as_key = "_by", lambda df: df.withColumn("_by", F.struct(*by))
    n = as_key(n).drop(*by)
    number = lambda of: F.pmod(F.xxhash64("rid"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of).cast("long") - 1))
    left = hub_join(as_key(rows), n, key, "_n", total).withColumn("block", number("rb")).withColumn("other", every("ab"))
    right = hub_join(as_key(anchors), n, key, "_n", total).withColumn("other", number("ab")).withColumn("block", every("rb"))
    left, right = (x.drop("rb", "ab") for x in (left, right))
    return left, right.toDF(*right.columns)  # columns of its own, as both sides come from one table


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of what the blocks found, ranked from 1."""
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low_pc: int = 50, high_pc: int = 95,
         id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that ``anchor`` marks.

    Vectors hold whole numbers; the score is the inner product with the anchor, higher first, ties by smaller id. An anchor's positives
    are its first ``positives`` other rows of the same label; a positive's negatives are the first ``negatives`` rows of another label
    with low_pc * p <= 100 * s <= high_pc * p for its score p. Rows with a null label, vector or component take no part; vectors of
    different lengths never meet; scores beyond a long are cut to it. Repeated rows are rows of their own. A row without an id is never an
    anchor, and comes last among equals. Other columns are ignored; an empty table gives an empty result.
    """
    kind = rows.schema[id].dataType
    base = rows.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("key"), F.col(label).alias("lab"), F.col(vector).cast("array<bigint>").alias("v"), (anchor & F.col(id).isNotNull()).alias("is_anchor"))
    base = base.where(F.col("lab").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    base = checkpoint(base.select(F.monotonically_increasing_id().alias("rid"), "key", "lab", F.size("v").alias("dim"), "v", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most, large = base.agg(F.count("*"), F.max(square), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    if not n:  # no row takes part
        return base.select(*[F.lit(None).cast(t).alias(c) for c, t in (("anchor_id", kind), ("positive_id", kind), ("rank", "int"), ("negative_id", kind), ("positive_score", "long"), ("negative_score", "long"))])
    most, travels = (most or 0.0) ** 0.5 * (1 + 1e-9), "array<smallint>" if (large or 0) < 2**15 else "array<bigint>"
    sample = base.select("v", F.xxhash64("key", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").collect()  # at most SAMPLE vectors, for any table
    pivots = Pivots([np.array(r["v"], np.float64) for r in sample], most)

    def measured(batches):
        for f in batches:
            for _, part in f.groupby("dim", sort=False):
                v = _matrix(part["v"])
                d = pivots.distances(v)
                part = part.assign(pd=list(d), qd=[x if a else None for x, a in zip(pivots.distances(v, True), part["is_anchor"], strict=True)], cell=d.argmin(1) if d.size else 0)
                yield part[["rid", "key", "lab", "dim", "v", "is_anchor", "pd", "qd", "cell"]]

    lab = base.schema["lab"].dataType.simpleString()
    shape = f"rid long, key long, lab {lab}, dim int, v {travels}, is_anchor boolean, pd array<double>, qd array<double>, cell int"
    held = checkpoint(base.withColumn("v", F.col("v").cast(travels)).mapInPandas(measured, shape))
    asked = held.where("is_anchor").select("rid", "key", "lab", "dim", "v", "qd")
    stored = held.select("rid", "key", "lab", "dim", "v", "pd", "cell")

    left, right = _dealt(stored.drop("cell"), asked.drop("key"), ["dim", "lab"], n)
    best = lambda a, b: _best(a, b, most, positives)
    met = left.groupBy("_by", "block", "other").cogroup(right.groupBy("_by", "block", "other")).applyInPandas(lambda a, b: best(a, b) if len(a) and len(b) else pd.DataFrame(columns=["rid", "key", "score"]), "rid long, key long, score long")
    first = checkpoint(_first(met, ["rid"], positives).select("rid", (F.col("rank") - 1).alias("nth"), "key", "score"))

    # An anchor visits the pivots whose rows may reach one of its bands: PIVOTS rows with the range of their distances.
    ranges = stored.groupBy("cell").agg(*[f(F.col("pd")[p]).alias(f"{t}{p}") for p in range(len(pivots.points)) for t, f in (("lo", F.min), ("hi", F.max))]).collect()
    cells = [(r["cell"], *(np.array([r[f"{t}{p}"] for p in range(len(pivots.points))]) for t in ("lo", "hi"))) for r in ranges]
    wanted = asked.join(first.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "score"))), lambda x: x["score"]).alias("scores")), "rid").drop("key")

    def visits(batches):
        for f in batches:
            out = []
            for own, qd, scores in zip(f["v"], f["qd"], f["scores"], strict=True):
                q = np.asarray(own, np.float64)
                bands = [(low_pc * float(s) / 100, high_pc * float(s) / 100) for s in scores if s >= 0]
                base_, room = q @ q + most**2, 1e-6 * (q @ q + most**2) + 1e-6
                may = []
                for cell, lo, hi in cells if bands else ():
                    near, far = np.maximum(np.maximum(lo - qd, qd - hi), 0).max(), (qd + hi).min()
                    if (base_ - near**2) / 2 + room >= min(a for a, _ in bands) and (base_ - far**2) / 2 - room <= max(b for _, b in bands):
                        may.append(cell)
                out.append(may)
            yield f.assign(cells=out)[["rid", "lab", "dim", "v", "qd", "scores", "cells"]]

    visiting = wanted.mapInPandas(visits, f"rid long, lab {lab}, dim int, v {travels}, qd array<double>, scores array<long>, cells array<int>")
    visiting = checkpoint(visiting.withColumn("cell", F.explode("cells")).drop("cells"))
    left, right = _dealt(stored, visiting, ["dim", "cell"], n)
    banded = lambda a, b: _banded(a, b, most, negatives, low_pc, high_pc)
    met = left.groupBy("_by", "block", "other").cogroup(right.groupBy("_by", "block", "other")).applyInPandas(lambda a, b: banded(a, b) if len(a) and len(b) else pd.DataFrame(columns=["rid", "nth", "key", "score"]), "rid long, nth int, key long, score long")
    found = _first(met, ["rid", "nth"], negatives)
    known = first.select("rid", "nth", F.col("key").alias("positive"), F.col("score").alias("positive_score")).join(asked.select("rid", F.col("key").alias("anchor")), "rid")
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(kind)
    return found.join(known, ["rid", "nth"]).select(F.col("anchor").cast(kind).alias("anchor_id"), given("positive").alias("positive_id"), "rank", given("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_embeddings(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The stated task over a table of vectors of fractions: components become floor(256 * x) in doubles; where id is divisible by 7 the
    label first becomes (label + 1) % 10; anchors are rows whose id is divisible by 50. Rows with non-finite components take no part."""
    rows = rows.where(finite(vector)).select(
        F.col(id).alias("vec_id"), F.when(F.col(id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label)).alias("label"),
        F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256)).alias("embedding"),
    )
    return mine(rows, F.col("vec_id") % 50 == 0)
