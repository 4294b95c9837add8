"""N-gram Jaccard join (9): MinHash banding, then verification on full n-gram sets.

A text is the set of its runs of ``n`` words, as 64-bit hashes. Texts with equal sets are one node. Bands and rows are chosen
for the recall wanted at the threshold; nodes that share a band are candidates. Every bucket is worked on by itself: its
members are cut into blocks and each pair of blocks is one piece of work, so that a bucket with thousands of near copies is
many tasks. A pair belongs to the first band in which its signatures agree, so it is met once; blocks whose pairs all belong to an
earlier band are never dealt out. The first pass compares
signatures only and names the nodes that a bucket needs; the second brings their full sets, and a pair is a link when the
Jaccard similarity of the sets reaches the threshold. Passes return a row per node and piece of work (number of links and a partner
to be connected with), never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, checkpoint, components, hub_join, keep_rows, named, slices, small, small_batches, text_or_empty

by_value(__name__)

WORDS, SIMILARITY, RECALL, HASHES, BLOCK = 5, 0.8, 0.9995, 128, 256
#: Signatures are so much smaller than sets that blocks of them are larger, unless that is more than one of so many shares of all nodes.
SIGNATURES, SHARES = 4, 256
#: Earlier bands by which the members of a large bucket are sorted; blocks of a class at most (numbers, not rows).
OWNERS, BLOCKS = 6, 2**24
#: Hashes of words kept by a task.
KNOWN = 250_000


def bands_for(threshold: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, and with them the fewest bands, that meet pairs at the threshold with this probability within so many hashes."""
    for rows in range(32, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no bands within so many hashes reach this recall")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingler(n: int = WORDS) -> Callable[[str], np.ndarray]:
    """Text to the sorted hashes of its distinct runs of n words (of all its words if it has fewer; none if it has none)."""
    import re

    import xxhash

    words = re.compile(r"[^\x20\x09-\x0D]+").findall
    known: dict[str, int] = {}

    def of(w: str) -> int:
        if (h := known.get(w)) is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def shingles(text: str) -> np.ndarray:
        if len(known) > KNOWN:
            known.clear()
        h = np.array([of(w) for w in words(text)], np.uint64)
        if not len(h):
            return h
        k = min(n, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out * np.uint64(31) + h[i : len(h) - k + 1 + i])
        return np.unique(out)

    return shingles


def multipliers(hashes: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Least of the upper halves of the products with each multiplier."""
    out = np.full(len(by), 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096, None]
        for j in range(0, len(by), 16):
            low = ((part * by[None, j : j + 16]) >> np.uint64(32)).min(0).astype(np.uint32)
            out[j : j + 16] = np.minimum(out[j : j + 16], low)
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(nodes, bands) hashes of the rows of each band and its number."""
    s = signatures[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2])
    for r in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return out.view(np.int64)


def prints(docs: DataFrame, bands: int, rows: int, n: int, text: str, id: str) -> DataFrame:
    """row, id, sha (of the text), digest of the n-gram set (null without words), size of the set and signature, for every row."""
    by = multipliers(bands * rows)
    kind = docs.schema[id].dataType.simpleString()
    inner = docs.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(text_or_empty(text), 256)).alias("sha"), text_or_empty(text).alias("t"))

    def run(batches):
        shingles = shingler(n)
        for batch in slices(batches):
            digests, sizes, signs = [], [], []
            for t in batch.column(3).to_pylist():
                s = shingles(t)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sizes.append(len(s))
                signs.append(signature(s, by).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary())], ["id", "row", "sha", "digest", "size", "sign"])

    return checkpoint(small_batches(inner).mapInArrow(run, f"id {kind}, row long, sha binary, digest binary, size int, sign binary"))


def _pieces(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of equal keys from frames sorted by them; a piece of work is bounded, and so is what is carried over."""
    rest = None
    for df in frames:
        if rest is not None:
            df = pd.concat([rest, df], ignore_index=True)
        if not len(df):
            continue
        k = df[keys].to_numpy()
        cuts = np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=False):
            yield df.iloc[a:b]
        rest = df.iloc[cuts[-1] if len(cuts) else 0 :]
    if rest is not None and len(rest):
        yield rest


def _owned(df: pd.DataFrame, bands: int, rows: int, threshold: float) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Positions (p, q) of the pairs of a piece of work that belong to its band and may be links by size and signature."""
    band, a, b = int(df["band"].iloc[0]), int(df["a"].iloc[0]), int(df["b"].iloc[0])
    left, right = np.nonzero((df["own"] == a).to_numpy())[0], np.nonzero((df["own"] == b).to_numpy())[0]
    if not len(left) or not len(right) or (a == b and len(left) < 2):
        return np.zeros(0, int), np.zeros(0, int), df
    sign = np.frombuffer(b"".join(df["sign"]), np.uint32).reshape(len(df), -1)
    hashed = band_hashes(sign, bands, rows)
    size = df["size"].to_numpy()
    big, small_ = np.maximum(size[left][:, None], size[right][None]), np.minimum(size[left][:, None], size[right][None])
    ok = (small_ >= threshold * big - 1e-9) & (hashed[left, band][:, None] == hashed[right, band][None])
    for k in range(band):
        ok &= hashed[left, k][:, None] != hashed[right, k][None]
    if a == b:
        ok &= np.arange(len(left))[:, None] < np.arange(len(left))[None]
    p, q = np.nonzero(ok)
    p, q = left[p], right[q]
    slack = 5 * math.sqrt(threshold * (1 - threshold) / sign.shape[1])
    like = np.concatenate([(sign[p[i : i + 20000]] == sign[q[i : i + 20000]]).mean(1) for i in range(0, len(p), 20000)]) if len(p) else np.zeros(0)
    good = like >= threshold - slack
    return p[good], q[good], df


def _verify(p: np.ndarray, q: np.ndarray, df: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """node, links (weighted), partner of the nodes of a piece of work that have a link."""
    sets = [np.frombuffer(s, np.uint64) for s in df["shingles"]]
    flat = np.concatenate(sets)
    _, code = np.unique(flat, return_inverse=True)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    mark = np.zeros(int(code.max()) + 1, bool)
    size, weight, node = np.diff(ends), df["weight"].to_numpy(), df["node"].to_numpy()
    links, root = np.zeros(len(df), np.int64), list(range(len(df)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = np.argsort(p, kind="stable")
    p, q = p[order], q[order]
    heads, starts = np.unique(p, return_index=True)
    for x, ys in zip(heads.tolist(), np.split(q, starts[1:]), strict=True):
        mine = code[ends[x] : ends[x + 1]]
        mark[mine] = True
        for i in range(0, len(ys), 64):
            part = ys[i : i + 64]
            hit = mark[np.concatenate([code[ends[y] : ends[y + 1]] for y in part])]
            both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(size[part])[:-1]]))
            # Jaccard >= threshold without a division, so that ties at the threshold count.
            for y in part[both >= threshold * (size[x] + size[part] - both) - 1e-9].tolist():
                links[x] += weight[y]
                links[y] += weight[x]
                u, v = find(x), find(y)
                if u != v:
                    root[max(u, v)] = min(u, v)
        mark[mine] = False
    some = np.nonzero(links)[0]
    return pd.DataFrame({"node": node[some], "links": links[some], "partner": node[[find(int(i)) for i in some]]})


def _in_blocks(members: DataFrame, block: int, priors: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """members (band, bucket, node) of buckets with two or more, with the block that each is of (own), once for every pair of blocks (a, b) it is part of.

    A bucket of at most ``block`` members is one block. In a larger one members are sorted first: of the first earlier
    bands (OWNERS, or as many as give no more classes than blocks) the bucket's most frequent value is found, and a member's class says in which of them it has that value. Two members that
    share one are a pair of that earlier band, so no blocks of two such classes meet, and a bucket of near copies, most of which agree
    in most bands, is not replicated again in every band. ``priors`` gives (node, prior: values of the first OWNERS bands).
    """
    key = ["band", "bucket"]
    counts = checkpoint(members.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1))
    none = F.lit(0).alias
    cool = members.join(counts.where(F.col("n") <= block).select(*key), key).select(*key, "node", none("own"), none("a"), none("b"))
    hot = counts.where(F.col("n") > block).select(*key, F.least(F.col("band").cast("int"), F.lit(OWNERS), F.ceil(F.log2(F.col("n") / block)).cast("int")).alias("owners"))
    if hot.isEmpty():
        return cool
    at = checkpoint(members.join(small(hot), key))
    at = checkpoint(at.join(priors(at.select("node").distinct()), "node").withColumn("prior", F.slice("prior", F.lit(1), F.col("owners"))))
    each = at.select(*key, F.posexplode("prior").alias("j", "value")).groupBy(*key, "j", "value").agg(F.count("*").alias("n"))
    usual = each.groupBy(*key, "j").agg(F.max(F.struct("n", "value"))["value"].alias("value")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("j", "value")))["value"].alias("usual"))
    shared = F.transform(F.sequence(F.lit(0), F.lit(OWNERS - 1)), lambda j: F.when(F.get("prior", j) == F.get("usual", j), F.call_function("shiftleft", F.lit(1), j)).otherwise(0))
    at = at.join(small(usual), key, "left").select(*key, "node", F.aggregate(shared, F.lit(0), lambda x, y: x + y).alias("mine"))
    # At most 2 ** OWNERS classes a bucket.
    classes = at.groupBy(*key, "mine").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).groupBy(*key).agg(F.collect_list(F.struct("mine", "blocks")).alias("classes"))
    at = at.join(small(classes), key)
    number = lambda c, i: c * BLOCKS + i
    of = lambda c: F.filter("classes", lambda x: x["mine"] == c)[0]["blocks"]
    meets = F.filter("classes", lambda x: x["mine"].bitwiseAND(F.col("mine")) == 0)
    others = F.flatten(F.transform(meets, lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda i: number(x["mine"], i))))
    at = at.withColumn("own", number(F.col("mine"), F.pmod(F.xxhash64("node", "bucket"), of(F.col("mine"))).cast("int")))
    at = at.select(*key, "node", "own", F.explode(others).alias("with"))
    return cool.unionByName(at.select(*key, "node", "own", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b")))


def _work(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    keys = ["band", "bucket", "a", "b"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def linked(docs: DataFrame, text: str = "text", id: str = "doc_id", n: int = WORDS, threshold: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """id, row, sha, n_links, component_id, kept, again for every row; see ``jaccard_join``."""
    bands, rows_ = bands_for(threshold, recall)
    seen = prints(docs, bands, rows_, n, text, id)
    own = F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col("row"), F.col("sha"))
    nodes = seen.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count("*").alias("weight"), F.min(F.struct(*[own[c].alias(c) for c in ("no", "id", "row", "sha")], "size", "sign")).alias("x"))
    nodes = checkpoint(nodes.select("digest", "weight", F.struct("x.no", "x.id", "x.row", "x.sha").alias("low"), "x.size", "x.sign", F.monotonically_increasing_id().alias("node")))

    def cut(frames):
        for df in frames:
            if len(df):
                h = band_hashes(np.frombuffer(b"".join(df["sign"]), np.uint32).reshape(len(df), -1), bands, rows_)
                yield pd.DataFrame({"node": np.repeat(df["node"].to_numpy(), bands), "band": np.tile(np.arange(bands, dtype=np.int16), len(df)), "bucket": h.ravel()})

    members = checkpoint(nodes.select("node", "sign").mapInPandas(cut, "node long, band short, bucket long"))
    facts = nodes.select("node", "size", "weight", "sign")

    def first_bands(frames):
        for df in frames:
            if len(df):
                h = band_hashes(np.frombuffer(b"".join(df["sign"]), np.uint32).reshape(len(df), -1), bands, rows_)
                yield pd.DataFrame({"node": df["node"], "prior": list(h[:, :OWNERS])})

    def priors(some: DataFrame) -> DataFrame:
        return nodes.select("node", "sign").join(small(some), "node", "left_semi").mapInPandas(first_bands, "node long, prior array<long>")

    def meet(frames):
        for df in _pieces(frames, ["band", "bucket", "a", "b"]):
            p, q, df = _owned(df, bands, rows_, threshold)
            if len(p):
                yield df.iloc[np.unique(np.concatenate([p, q]))][["band", "bucket", "node"]]

    need = checkpoint(_work(_in_blocks(members, max(block, min(SIGNATURES * block, nodes.count() // SHARES)), priors).join(facts, "node"), meet, "band short, bucket long, node long").distinct())

    # Texts are met again by id and digest, so that null and repeated ids do not pile up, and stay where they are while few are wanted.
    wanted = checkpoint(need.select("node").distinct().join(nodes, "node").select("digest", "node", F.col("low.id").alias("_id"), F.col("low.sha").alias("_s")))
    again = docs.select(F.col(id).alias("_i"), text_or_empty(text).alias("t")).withColumn("_h", F.unhex(F.sha2("t", 256)))
    again = again.join(small(wanted.select("_id", "_s").distinct()), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_s")), "left_semi").select("t")

    def full(batches):
        shingles = shingler(n)
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "shingles"])

    sets = small_batches(again).mapInArrow(full, "digest binary, shingles binary").join(small(wanted.select("digest", "node")), "digest").groupBy("node").agg(F.first("shingles").alias("shingles"))

    def check(frames):
        for df in _pieces(frames, ["band", "bucket", "a", "b"]):
            p, q, df = _owned(df, bands, rows_, threshold)
            if len(p):
                yield _verify(p, q, df, threshold)

    found = checkpoint(_work(_in_blocks(need, block, priors).join(facts.join(sets, "node"), "node"), check, "node long, links long, partner long"))
    joined = components(found, "node", "partner").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    # Only nodes that stand for more than one row or have links travel to the rows.
    shared = nodes.select("node", "digest", "weight", "low").join(small(checkpoint(joined)), "node", "left").where("weight > 1 or component is not null")
    shared = checkpoint(shared.select("digest", "weight", "low", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    shared = checkpoint(named(shared, "low", shared.count())).select("digest", "weight", "n_links", "first")
    plain = seen.select("digest", "id", "row", "sha")
    silent = plain.where(F.col("digest").isNull()).select("*", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast(shared.schema["first"].dataType).alias("first"))
    out = hub_join(plain.where(F.col("digest").isNotNull()), shared, "digest", "weight", seen.count(), "left").unionByName(silent)
    alone = F.col("n_links").isNull()
    return out.select(
        "id", "row", "sha", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"), F.when(~alone, F.col("id").eqNullSafe(F.col("first.id")) & (F.col("sha") == F.col("first.sha"))).alias("again"),
    )


def jaccard_join(docs: DataFrame, text: str = "text", id: str = "doc_id", n: int = WORDS, threshold: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_links (other rows whose similarity reaches the threshold), component_id (smallest id reachable by links), kept.

    Words are runs of anything but white space, case and punctuation included. A text with fewer than n words has one run, of all
    its words; a null, empty or blank text has none and links with nothing. Rows with equal sets (repeated rows too) link with
    each other. Exactly one row of a component is kept: the one with the smallest id, null ids last. Other columns are ignored;
    an empty table gives an empty result.
    """
    return linked(docs, text, id, n, threshold, recall, block).select(F.col("id").alias(id), "n_links", "component_id", "kept")


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that ``jaccard_join`` keeps, with all their columns."""
    decided = linked(docs, text, id, **options).select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), "kept", "again")
    return keep_rows(docs, decided, id, F.unhex(F.sha2(text_or_empty(text), 256)))
