"""Suffix-array dedup (11): maximal repeats from the interval tree of a sparse suffix array.

A string of LEAST bytes holds LEAST - GRAM + 1 grams of GRAM bytes; the one of least hash (the first of several) is its *anchor*. It
depends on the string alone, so wherever the string occurs again the same anchor lies at the same place in it. Only suffixes that
begin at anchors, one byte in seventy, need to be sorted. All a string of LEAST bytes around an anchor can reach is the anchor's
*context*, LEAST - GRAM bytes before it and LEAST after its start.

1. Every text gives its anchors with a hash of their contexts. Anchors that occur once in the corpus go; equal contexts are one.
2. A context that occurs twice is a repeat as a whole. Contexts of one anchor that differ are fetched from one text each, dealt by
   anchor and sorted: a suffix array with its common prefixes. A stack scan over these gives the tree of common-prefix intervals. The
   members of an interval, sorted by what lies before the anchor, are scanned the same way: an interval of that scan, whose
   members differ in the byte before their common text (left-diverse) and lie in two children of the first (right-diverse), is a
   maximal repeat, with all its occurrences and not only neighbours.
3. Anchors with more than MANY contexts are never gathered: their strings of LEAST bytes are counted by hash instead.
4. Facts about contexts go back to the texts that have them; texts find their anchors again and know where they repeat.

Repeats are maximal within the context of an anchor; a longer one is a chain of overlapping groups, which add up to all of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HUBS, by_value, hub_join, slices, small, small_batches, text_or_empty, written
from .common import LEAST as LEAST_ROWS

by_value(__name__)

LEAST, GRAM = 200, 64
#: Contexts of one anchor that a task takes at most; bytes of a text worked on at once.
MANY, AT_ONCE = 512, 1 << 20
#: Odd numbers by which the eight-byte words of a gram are multiplied, from a fixed seed.
FACTORS = np.random.default_rng(11).integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def grams(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a multiple of eight) that start at each place."""
    raw = np.ascontiguousarray(raw)
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)).astype(np.uint64)
    n = len(raw) - gram + 1
    h, part = words[:n] * FACTORS[0], np.empty(n, np.uint64)
    for i in range(1, gram // 8):
        h += np.multiply(words[8 * i : 8 * i + n], FACTORS[i], out=part)
    h ^= np.right_shift(h, np.uint64(32), out=part)
    h *= FACTORS[-1]
    h ^= np.right_shift(h, np.uint64(29), out=part)
    return h


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the least value, the first of several, of every run of ``width`` values."""
    place = np.uint64(AT_ONCE * 2 - 1)
    low, has = (h & ~place) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * has <= width:  # the least of runs twice as long
        low = np.minimum(low[:-has], low[has:])
        has *= 2
    if has < width:
        low = np.minimum(low[: has - width], low[width - has :])
    low &= place
    return low[np.append(True, low[1:] != low[:-1])].astype(np.int64)


def anchors(raw: bytes, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of a text, hashes of the anchors and of their contexts (int64)."""
    places, hashes, n = [], [], len(raw)
    whole = np.frombuffer(raw, np.uint8)
    for start in range(0, max(0, n - least + 1), AT_ONCE - least):
        h = grams(whole[start : start + AT_ONCE - 1], gram)
        at = _lowest(h, least - gram + 1)
        places.append(at + start)
        hashes.append(h[at])
    if not places:
        return (np.zeros(0, np.int64),) * 3
    at, h, reach = places[0], hashes[0], least - gram
    if len(places) > 1:
        at, first = np.unique(np.concatenate(places), return_index=True)
        h = np.concatenate(hashes)[first]
    contexts = [xxhash.xxh3_64_intdigest(raw[max(0, p - reach) : p + least], min(p, reach)) for p in at.tolist()]
    return at, h.view(np.int64), np.array(contexts, np.uint64).view(np.int64)


def intervals(common: np.ndarray, least: int):
    """(depth, first, last) of every interval of neighbours that have ``depth`` >= least in common, by a stack scan; inner ones first."""
    stack = []
    for i, depth in enumerate([*common.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _common(rows: list[bytes], width: int) -> np.ndarray:
    """Bytes that each row has in common with the next."""
    if len(rows) < 2:
        return np.zeros(0, np.int64)
    m = np.frombuffer(b"".join(r[:width].ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
    differ = m[1:] != m[:-1]
    n = np.array([min(len(r), width) for r in rows])
    return np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(n[1:], n[:-1]))


def maximal(befores: list[bytes], afters: list[bytes], common: np.ndarray, least: int, reach: int):
    """(left, right, members) of the maximal repeats of at least ``least`` bytes around one anchor.

    ``afters`` from the anchor on, sorted; ``common`` what neighbours of them have in common; ``befores`` the bytes before the anchor, reversed."""
    for right, first, last in intervals(common, least - reach):
        members = sorted(range(first, last + 1), key=befores.__getitem__)
        child = np.concatenate([[0], np.cumsum(common[first:last] == right)])  # of each member, in the order of what follows
        lefts = _common([befores[i] for i in members], reach)
        for left, a, b in intervals(lefts, max(least - right, 1)) if right < least else _with_root(lefts, len(members)):
            if len({int(child[i - first]) for i in members[a : b + 1]}) > 1:
                yield left, right, members[a : b + 1]


def _with_root(lefts: np.ndarray, n: int):
    """Intervals of any depth, the whole among them: nothing need be common before the anchor."""
    yield from intervals(lefts, 1)
    if not (lefts > 0).all():
        yield 0, 0, n - 1


def _rows(docs: DataFrame, text: str, id: str) -> DataFrame:
    raw = text_or_empty(text)
    return docs.select(F.col(id).alias("_id"), raw.alias("_text"), F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias("key"))


def _found(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(key, h, c, m): the contexts of every row's text, once each, and how often the text has them."""

    def run(batches):
        for batch in slices(batches):
            hs, cs, ms = [], [], []
            for text in batch.column(1):
                _, h, c = anchors(text.as_py().encode(), least, gram)
                c, first, m = np.unique(c, return_index=True, return_counts=True)
                hs.append(h[first])
                cs.append(c)
                ms.append(m)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), [len(c) for c in cs])))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(np.concatenate(x).astype(np.int64)) for x in (hs, cs, ms))], ["key", "h", "c", "m"])

    return written(small_batches(docs.select("key", "_text")).mapInArrow(run, "key binary, h long, c long, m long"))


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """Texts compressed, to be shuffled."""
    def run(batches):
        press = zstandard.ZstdCompressor(1)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([press.compress(t.as_py().encode()) for t in batch.column(0)], pa.binary()), *batch.columns[1:]], ["z", *columns])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return small_batches(docs.select("_text", *columns)).mapInArrow(run, f"z binary, {kinds}")


def _fetched(docs: DataFrame, wanted: DataFrame, least: int, gram: int) -> DataFrame:
    """(h, c, before, after) of the contexts ``wanted`` (h, c, key: a text that has it), each once; ``before`` reversed."""
    lists = wanted.groupBy("key").agg(F.collect_list("c").alias("cs"))  # no more than a text has anchors
    keys = written(wanted.select("key").distinct())
    n = keys.count()
    have = docs.join(small(keys, n), "key", "left_semi") if n <= BROADCAST_ROWS else docs  # texts travel only compressed
    own = _packed(have, "key").groupBy("key").agg(F.first("z").alias("z"))  # copies of a text are one before the shuffle
    reach = least - gram

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            out = []
            for z, cs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = open_.decompress(z)
                at, h, c = anchors(raw, least, gram)
                _, first = np.unique(c, return_index=True)
                first = first[np.isin(c[first], cs.values.to_numpy())]
                out += [(x, y, raw[max(0, p - reach) : p][::-1], raw[p : p + least]) for p, x, y in zip(at[first].tolist(), h[first].tolist(), c[first].tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["h", "c", "before", "after"])

    return own.join(lists, "key").select("z", "cs").mapInArrow(run, "h long, c long, before binary, after binary")


SPANS = "array<struct<l:int,r:int,g:string>>"


def widest(spans: list[tuple]) -> list[tuple]:
    """Of (left, right, ...) those that lie in no other."""
    out = []
    for s in sorted(spans, key=lambda s: (-s[0], -s[1])):
        if not out or s[1] > out[-1][1]:
            out.append(s)
    return out


def _scanned(contexts: DataFrame, least: int, gram: int, named: bool) -> DataFrame:
    """(h, c, spans) of contexts that are sorted by h and after within their tasks. Not ``named``: only spans that lie in no other."""
    reach = least - gram

    def of(hs, cs, befores, afters):
        common = _common(afters, least)
        common[hs[1:] != hs[:-1]] = 0
        edges = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1], [True]]))
        out = [[] for _ in cs]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                for left, right, members in maximal(befores[a:b], afters[a:b], common[a : b - 1], least, reach):
                    i = a + members[0]  # they have these bytes in common
                    name = hashlib.sha256(befores[i][:left][::-1] + afters[i][:right]).hexdigest()[:32] if named else None
                    for i in members:
                        out[a + i].append((left, right, name))
        return out if named else [widest(s) for s in out]

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), [], []]
        names = ["h", "c", "spans"]
        kind = pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32()), ("g", pa.string())]))

        def told(hs, cs, befores, afters):
            spans = of(hs, cs, befores, afters)
            keep = [i for i, s in enumerate(spans) if s]
            return pa.RecordBatch.from_arrays([pa.array(hs[keep]), pa.array(cs[keep]), pa.array([[dict(zip("lrg", x, strict=True)) for x in spans[i]] for i in keep], kind)], names)

        for batch in batches:
            h, c, before, after = (batch.column(i) for i in range(4))
            held = [np.concatenate([held[0], h.to_numpy()]), np.concatenate([held[1], c.to_numpy()]), held[2] + before.to_pylist(), held[3] + after.to_pylist()]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last anchor may go on in the next batch
            if cut:
                yield told(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield told(*held)

    return contexts.mapInArrow(run, f"h long, c long, spans {SPANS}")


def _counted(contexts: DataFrame, least: int, named: bool) -> DataFrame:
    """(h, c, spans) of contexts of anchors that have very many: their strings of ``least`` bytes, counted by hash over all of them.

    A string is counted by its anchor and the anchor's place in it, so that no occurrence is met through two anchors."""

    def run(batches):
        for batch in slices(batches):
            hs, cs, ls, ws = [], [], [], []
            for h, c, before, after in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                raw, at = before[::-1] + after, len(before)
                for i in range(len(raw) - least + 1):
                    hs.append(h)
                    cs.append(c)
                    ls.append(at - i)
                    ws.append(xxhash.xxh3_128_digest(raw[i : i + least], (h + (at - i) * int(FACTORS[0])) % 2**64))
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(cs, pa.int64()), pa.array(ls, pa.int32()), pa.array(ws, pa.binary())], ["h", "c", "l", "w"])

    each = written(contexts.mapInArrow(run, "h long, c long, l int, w binary"))
    often = written(each.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"))
    total = often.agg(F.sum("n")).first()[0] or 0
    met = hub_join(each, often, "w", "n", total)
    return met.groupBy("h", "c").agg(F.collect_list(F.struct("l", (F.lit(least) - F.col("l")).cast("int").alias("r"), (F.hex("w") if named else F.lit(None)).alias("g"))).cast(SPANS).alias("spans"))


def _facts(docs: DataFrame, least: int, gram: int, named: bool) -> DataFrame:
    """(key, cs, parts): for each text the contexts that repeat as a whole, and the repeats within others."""
    found = _found(docs, least, gram)
    often = written(found.groupBy("h").agg(F.sum("m").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1").select("h", "n", (F.col("lo") != F.col("hi")).alias("mixed")))
    total = often.agg(F.sum("n")).first()[0] or 0
    again = written(hub_join(found.select("key", "h", "c", "m"), often, "h", "n", total))
    each = written(again.where("mixed").groupBy("h", "c").agg(F.sum("m").alias("n"), F.min("key").alias("key")))
    kinds = written(each.groupBy("h").agg(F.count("*").alias("n"), F.min("n").alias("least")).where("least = 1").select("h", "n", (F.col("n") > MANY).alias("many")))
    rows = each.count()
    wanted = written(hub_join(each.select("h", "c", "key"), kinds, "h", "n", rows))
    contexts = written(_fetched(docs, wanted.select("h", "c", "key"), least, gram))
    # Few anchors have very many contexts: no more than all contexts by MANY.
    many = kinds.where("many").select("h", "n")
    none = many.isEmpty()
    inside = _scanned((contexts if none else contexts.join(kinds.where("not many").select("h"), "h", "left_semi")).select("h", "c", "before", "after").repartition("h").sortWithinPartitions("h", "after"), least, gram, named)
    if not none:
        inside = inside.unionByName(_counted(hub_join(contexts, many, "h", "n", rows).select("h", "c", "before", "after"), least, named))
    if not named:  # a context that repeats as a whole needs no more
        inside = inside.join(each.where("n = 1").select("h", "c"), ["h", "c"], "left_semi")
    inside = written(inside)
    fact = each.select("h", "c", "n", (F.col("n") > 1).alias("whole")).join(inside, ["h", "c"], "left").where("whole or spans is not null")
    fact = fact.select(F.struct("h", "c").alias("x"), "n", "whole", "spans")
    mixed = hub_join(again.where("mixed").select("key", F.struct("h", "c").alias("x")), fact, "x", "n", total).select("key", "x.c", "whole", "spans")
    facts = again.where("not mixed").select("key", "c", F.lit(True).alias("whole"), F.lit(None).cast(SPANS).alias("spans")).unionByName(mixed)
    part = F.when(F.col("spans").isNotNull(), F.struct("c", "spans"))
    return facts.groupBy("key").agg(F.collect_set(F.when(F.col("whole"), F.col("c"))).alias("cs"), F.collect_list(part).alias("parts"))


def _met(docs: DataFrame, least: int, gram: int, named: bool = False) -> DataFrame:
    """(z, _id, cs, parts): every row's text, compressed, with what is known of it. Facts about texts that a large share of all rows have go to the rows."""
    facts = written(_facts(docs, least, gram, named))
    sizes = docs.groupBy("key").agg(F.count("*").alias("n"))
    hubs = written(sizes.where(F.col("n") >= max(LEAST_ROWS, docs.count() // HUBS)).select("key"))
    keys = F.broadcast(hubs)  # no more than HUBS
    hot = _packed(docs.join(F.broadcast(facts.join(keys, "key").unionByName(hubs.join(facts, "key", "left_anti"), allowMissingColumns=True)), "key"), "_id", "cs", "parts")
    rest = _packed(docs.join(keys, "key", "left_anti"), "_id", "key").join(facts, "key", "left")
    return rest.select("z", "_id", "cs", "parts").unionByName(hot)


def _spans(raw: bytes, cs, parts, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Starts, ends and names of the repeats of a text."""
    at, _, c = anchors(raw, least, gram)
    whole = np.isin(c, np.array(cs or [], np.int64))
    starts, ends = np.maximum(at[whole] - (least - gram), 0), np.minimum(at[whole] + least, len(raw))
    names = [None] * len(starts)
    inner = {p["c"]: p["spans"] for p in parts or ()}
    more = [(p - s["l"], p + s["r"], s["g"]) for p, x in zip(at.tolist(), c.tolist(), strict=True) for s in inner.get(x, ())]
    if more:
        a, b, g = zip(*more, strict=True)
        starts, ends, names = np.append(starts, a), np.append(ends, b), names + list(g)
    return starts, ends, names


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a span."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def repeat_digests(docs: DataFrame, text: str = "text", id: str = "doc_id", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, once every byte of a repeat of ``least`` bytes is removed.

    A repeat starts at another place of the same text, of another one or of a copy; all its occurrences go. Null texts count as empty, which
    have nothing to remove; texts shorter than ``least`` bytes stay. Repeated rows are copies. Other columns are ignored; an empty table gives
    an empty result."""
    rows = _rows(docs, text, id)

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            out = []
            for z, cs, parts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = open_.decompress(z)
                if not cs and not parts:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                starts, ends, _ = _spans(raw, cs, parts, least, gram)
                gone = covered(len(raw), starts, ends)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), len(raw) - len(kept), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, zip(*out, strict=True))], [id, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id].dataType.simpleString()
    return _met(rows, least, gram).mapInArrow(run, f"`{id}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(repeat, id, start, length): every occurrence, in bytes, of every maximal repeat, named by a hash of its bytes.

    Rows as for ``repeat_digests``. A repeat that reaches beyond an anchor's context occurs as several that overlap."""
    rows = _rows(docs, text, id)

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            out = []
            for z, own, cs, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = open_.decompress(z)
                spans = zip(*(x if isinstance(x, list) else x.tolist() for x in _spans(raw, cs, parts, least, gram)), strict=True)
                out += {(name or hashlib.sha256(raw[a:b]).hexdigest()[:32], own, a, b - a) for a, b, name in spans if b - a >= least}
            if out:
                name, own, start, length = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(own, batch.column(1).type), pa.array(start, pa.int64()), pa.array(length, pa.int64())], ["repeat", id, "start", "length"])

    kind = docs.schema[id].dataType.simpleString()
    return _met(rows, least, gram, named=True).mapInArrow(run, f"repeat string, `{id}` {kind}, start long, length long")


def without_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(id, text) once repeats are removed; where a cut goes through a letter, what is left of it becomes U+FFFD."""
    rows = _rows(docs, text, id)

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            out = []
            for z, cs, parts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = open_.decompress(z)
                starts, ends, _ = _spans(raw, cs, parts, least, gram)
                out.append(np.frombuffer(raw, np.uint8)[~covered(len(raw), starts, ends)].tobytes().decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.string())], [id, text])

    return _met(rows, least, gram).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, `{text}` string")
