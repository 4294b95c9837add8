"""Embedding near-dedup (1): an inverted multi-index.

Unit vectors are cut in halves, each half has a codebook of its own, and a pair of codewords is a cell of the product grid.
A vector is stored in its own cell and looks for partners in the cells that the multi-sequence traversal names next: cells in
order of the sum of the two half distances, until that sum exceeds the one of its own cell by ``reach``. The reach is set before:
for sampled vectors a partner at exactly the wanted cosine in a random direction is made, and the reach is the least at which
``recall`` of those partners' cells are visited. A vector in the middle of its cell so visits few others, one at a border many.
Of two vectors in different cells only the one in the higher cell visits, so a pair is met once. Candidates are verified by their
cosine in double precision. Vectors of each length have an index of their own; all of them are worked on in one pass.

Equal vectors are one representative with a weight. Members and visitors of a cell are cut into blocks and every pair of
blocks is a task of its own, so that a cell with a third of all vectors is many tasks; a block pair returns one row for each
vector that has a link (its weighted number of links and a partner to be connected with), never pairs. Vectors travel in the
type they came in, ids and labels not at all.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, checkpoint, components, hub_join, named, slices, small

by_value(__name__)

COSINE, RECALL = 0.95, 0.999
#: Vectors from which codebooks and reach are learned (at most, and at most so many bytes), vectors wanted in a cell, codewords of a half at most.
SAMPLE, SAMPLE_BYTES, PER_CELL, MOST_WORDS = 20_000, 64_000_000, 4096, 4096
#: Vectors of a block at most, and their bytes; rows of a matrix of cosines.
BLOCK, BLOCK_BYTES, STRIPE = 8192, 32_000_000, 256
#: A block is no more than one of so many shares of the vectors either, so that the few cells of a small table are even tasks too; from so many vectors on.
SHARES, SHARE_FROM = 8, 1024


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled by the largest component first, so that no square overflows."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances (n, words)."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1)[None], 0)


def codebook(x: np.ndarray, words: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means on rows of x; an empty codeword is put on the row farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(words, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = nearest(x, c)
        own, far = d.argmin(1), d.min(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        for k in range(len(c)):
            if n[k]:
                c[k] = total[k] / n[k]
            else:
                c[k] = x[i := far.argmax()]
                far[i] = 0
    return c


def multi_sequence(d1: np.ndarray, d2: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells in order of d1[i] + d2[j], row by row, up to the least sum and ``reach``.

    Only the leading parts of the two sorted lists can take part: an entry that is itself more than reach above the first of its list can not."""
    k2 = d2.shape[1]
    o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    s1, s2 = s1 - s1[:, :1], s2 - s2[:, :1]
    w1, w2 = int((s1 <= reach).sum(1).max(initial=1)), int((s2 <= reach).sum(1).max(initial=1))
    rows, cells = [], []
    step = max(1, 4_000_000 // (w1 * w2))
    for i in range(0, len(d1), step):
        total = s1[i : i + step, :w1, None] + s2[i : i + step, None, :w2]
        r, a, b = np.nonzero(total <= reach)
        order = np.lexsort((total[r, a, b], r))
        r, a, b = r[order] + i, a[order], b[order]
        rows.append(r)
        cells.append(o1[r, a] * k2 + o2[r, b])
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cells or [np.zeros(0, int)])


def fit(sample: np.ndarray, n: int, cosine: float = COSINE, recall: float = RECALL, per_cell: int = PER_CELL, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(codebook of the first half, of the second, reach) for n vectors, from unit vectors ``sample``."""
    half = sample.shape[1] // 2
    k = int(min(MOST_WORDS, max(1, math.ceil(math.sqrt(n / per_cell))), len(sample)))
    c1, c2 = codebook(sample[:, :half], k, seed), codebook(sample[:, half:], k, seed + 1)
    rng = np.random.default_rng(seed)
    x = sample[rng.choice(len(sample), min(len(sample), 4000), replace=False)]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    length = np.linalg.norm(noise, axis=1, keepdims=True)
    y = cosine * x + math.sqrt(1 - cosine**2) * noise / np.where(length > 0, length, 1)
    d1, d2 = nearest(x[:, :half], c1), nearest(x[:, half:], c2)
    rows = np.arange(len(x))
    to = d1[rows, nearest(y[:, :half], c1).argmin(1)] + d2[rows, nearest(y[:, half:], c2).argmin(1)]
    return c1, c2, float(np.quantile(to - d1.min(1) - d2.min(1), recall, method="higher"))


def hooked(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``root`` (every thing to the least of its class) after the classes of p and q are joined pairwise."""
    while len(p):
        p, q = root[p], root[q]
        apart = p != q
        p, q = p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return root


def links_in_block(a: dict, b: dict, inside: bool, cosine: float) -> pd.DataFrame:
    """Links between members ``a`` and visitors (or other members) ``b``, and with ``inside`` also between members: node, links (weighted), partner.

    Cosines are first taken in single precision; what comes near the threshold is taken again in double."""
    na = len(a["x"])
    x, node, weight = np.concatenate([a["x"], b["x"]]), np.concatenate([a["node"], b["node"]]), np.concatenate([a["weight"], b["weight"]])
    rough = x.astype(np.float32)
    slack = 1e-5 + 1e-7 * x.shape[1]
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    for i in range(0, na, STRIPE):
        first = i if inside else na
        p, q = np.nonzero(rough[i : min(i + STRIPE, na)] @ rough[first:].T >= cosine - slack)
        p, q = p + i, q + first
        some = p < q
        p, q = p[some], q[some]
        if len(p):
            exact = np.concatenate([(x[p[j : j + 65536]] * x[q[j : j + 65536]]).sum(1) >= cosine for j in range(0, len(p), 65536)])
            p, q = p[exact], q[exact]
            links += np.bincount(p, weight[q], len(x)).astype(np.int64) + np.bincount(q, weight[p], len(x)).astype(np.int64)
            root = hooked(root, p, q)
    some = np.nonzero(links)[0]
    return pd.DataFrame({"node": node[some], "links": links[some], "partner": node[root[some]]})


def prints(vectors: DataFrame, embedding: str, id: str) -> DataFrame:
    """id, node (unique), dims, key and e (components as bytes) of every row; dims, key and e are null for vectors that link with nothing."""
    kind = vectors.schema[embedding].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("node"), F.col(embedding).cast(f"array<{'float' if single else 'double'}>").alias("e"))

    def run(batches):
        for batch in slices(batches, 1024):
            col = batch.column(2)
            ends, values = col.offsets.to_numpy(), col.values
            there = values.is_valid().to_numpy(zero_copy_only=False)
            flat = np.where(there, values.fill_null(0).to_numpy(zero_copy_only=False), np.nan).astype(np.float32 if single else np.float64) + 0  # -0.0 becomes 0.0
            bad, some = np.concatenate([[0], np.cumsum(~np.isfinite(flat))]), np.concatenate([[0], np.cumsum(flat != 0)])
            a, b = ends[:-1], ends[1:]
            sound = col.is_valid().to_numpy(zero_copy_only=False) & (bad[b] == bad[a]) & (some[b] > some[a])
            raw = [flat[i:j].tobytes() if ok else None for i, j, ok in zip(a, b, sound, strict=True)]
            dims = [int(j - i) if ok else None for i, j, ok in zip(a, b, sound, strict=True)]
            keys = [r if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["id", "node", "dims", "key", "e"])

    kind = vectors.schema[id].dataType.simpleString()
    return checkpoint(rows.mapInArrow(run, f"id {kind}, node long, dims int, key binary, e binary"))


def near_duplicates(
    vectors: DataFrame, embedding: str = "embedding", id: str = "vec_id", cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK, per_cell: int = PER_CELL
) -> DataFrame:
    """One row per input row: id, n_links, component_id (smallest id reachable by links), kept (id = component_id).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths do not
    link with each other. Equal vectors link, repeated ids included. A null id never names a component unless all ids of it are
    null. Other columns (labels too) are ignored; an empty table gives an empty result.
    """
    single = isinstance(vectors.schema[embedding].dataType, T.ArrayType) and isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)
    kind = np.float32 if single else np.float64
    rows = prints(vectors, embedding, id)
    own = F.struct(F.col("id").isNull().alias("no"), F.col("id"))
    sound = rows.where(F.col("key").isNotNull())
    groups = checkpoint(sound.groupBy("dims", "key").agg(F.count("*").alias("weight"), F.min("node").alias("stands"), F.min(own).alias("low")))
    # Vectors that occur once need no partner: only repeated ones travel.
    again = small(groups.where("weight > 1").select("key", "weight", "stands"))
    nodes = sound.join(again, "key", "left").where(F.coalesce("stands", "node") == F.col("node")).select("node", "dims", "e", F.coalesce("weight", F.lit(1)).alias("weight"))
    # One row per length of vectors; only lengths with more vectors than a cell holds need a codebook.
    models = {}
    for r in groups.groupBy("dims").count().where(F.col("count") > per_cell).collect():
        few = min(sample, max(1, SAMPLE_BYTES // (r["dims"] * np.dtype(kind).itemsize)))
        drawn = sound.where(F.col("dims") == r["dims"]).orderBy("key", "node").select("e").limit(few).collect()
        models[r["dims"]] = fit(unit(np.frombuffer(b"".join(bytes(d["e"]) for d in drawn), kind).reshape(len(drawn), -1)), r["count"], cosine, recall, per_cell)
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def visits(x: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own cells; rows and cells of the visits to lower cells."""
        if dims not in sent.value:
            return np.zeros(len(x), int), np.zeros(0, int), np.zeros(0, int)
        c1, c2, reach = sent.value[dims]
        d1, d2 = nearest(x[:, : dims // 2], c1), nearest(x[:, dims // 2 :], c2)
        home = d1.argmin(1) * len(c2) + d2.argmin(1)
        row, cell = multi_sequence(d1, d2, reach)
        lower = cell < home[row]
        return home, row[lower], cell[lower]

    def parts(df: pd.DataFrame):
        for dims, d in df.groupby("dims"):
            yield int(dims), d, unit(np.frombuffer(b"".join(d["e"]), kind).reshape(len(d), -1))

    def count(frames):
        for df in frames:
            for dims, _, x in parts(df):
                home, _, cell = visits(x, dims)
                for side, c in ((0, home), (1, cell)):
                    which, n = np.unique(c, return_counts=True)
                    yield pd.DataFrame({"dims": dims, "side": side, "cell": which, "n": n})

    # At most per length so many cells as its codebooks have pairs; their numbers of blocks go to the tasks that deal vectors out.
    sizes = nodes.mapInPandas(count, "dims int, side int, cell int, n long").groupBy("dims", "side", "cell").agg(F.sum("n").alias("n")).collect()
    total: dict[int, int] = {}
    for r in sizes:
        total[r["dims"]] = total.get(r["dims"], 0) + (r["n"] if r["side"] == 0 else 0)
    room = {d: max(1, min(block, max(SHARE_FROM, n // SHARES), BLOCK_BYTES // (d * np.dtype(kind).itemsize))) for d, n in total.items()}
    blocks = [{(r["dims"], r["cell"]): math.ceil(r["n"] / room[r["dims"]]) for r in sizes if r["side"] == s} for s in (0, 1)]
    plan = rows.sparkSession.sparkContext.broadcast(blocks)

    def deal(frames):
        """Units of work of a cell: (a, b) with a < b < na two blocks of members; (a, na + j) block a and the j-th of visitors, with the pairs inside a for j = 0."""
        members, visitors = plan.value
        for df in frames:
            for dims, d, x in parts(df):
                home, row, cell = visits(x, dims)
                node = d["node"].to_numpy()
                spread = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                out = []
                for i, (c, s) in enumerate(zip(home.tolist(), spread.tolist(), strict=True)):
                    na, nb = members.get((dims, c), 1), visitors.get((dims, c), 0)
                    mine = s % na
                    out += [(i, c, min(mine, o), max(mine, o), int(mine > o), False) for o in range(na) if o != mine]
                    out += [(i, c, mine, na + j, 0, j == 0) for j in range(max(nb, 1))]
                for i, c in zip(row.tolist(), cell.tolist(), strict=True):
                    na = members.get((dims, c), 0)
                    j = int(spread[i]) % visitors.get((dims, c), 1)
                    out += [(i, c, a, na + j, 1, j == 0) for a in range(na)]
                i, c, a, b, side, inside = zip(*out, strict=True)
                at = np.array(i)
                yield pd.DataFrame({"dims": dims, "cell": c, "a": a, "b": b, "side": side, "inside": inside, "node": node[at], "weight": d["weight"].to_numpy()[at], "e": d["e"].to_numpy()[at]})

    work = nodes.mapInPandas(deal, "dims int, cell int, a int, b int, side int, inside boolean, node long, weight long, e binary")

    def verify(df: pd.DataFrame) -> pd.DataFrame:
        def part(d: pd.DataFrame) -> dict:
            x = np.frombuffer(b"".join(d["e"]), kind).reshape(len(d), int(df["dims"].iloc[0]))
            return {"x": unit(x) if len(d) else x.astype(np.float64), "node": d["node"].to_numpy(), "weight": d["weight"].to_numpy()}

        return links_in_block(part(df[df["side"] == 0]), part(df[df["side"] == 1]), bool(df["inside"].iloc[0]), cosine)

    found = checkpoint(work.groupBy("dims", "cell", "a", "b").applyInPandas(verify, "node long, links long, partner long"))
    joined = components(found, "node", "partner")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # Only vectors that have a link or are repeated travel to the rows.
    shared = groups.withColumnRenamed("stands", "node").join(links, "node", "left").where("weight > 1 or links is not null").join(joined, "node", "left")
    shared = checkpoint(shared.withColumns({"component": F.coalesce("component", "node"), "n_links": F.coalesce("links", F.lit(0)) + F.col("weight") - 1}))
    label = checkpoint(named(shared.select("component", "key", "low", "n_links", "weight"), "low", shared.count())).select("key", "n_links", F.col("first.id").alias("component_id"), "weight")
    silent = rows.where(F.col("key").isNull()).select("key", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = hub_join(sound.select("key", "id"), label, "key", "weight", rows.count(), "left").unionByName(silent)
    alone = F.col("n_links").isNull()
    out = out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
