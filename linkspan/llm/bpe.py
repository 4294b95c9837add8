"""Byte-level BPE encoding and decoding (8): corpus-level merge replay.

Text is cut into words by the tokenizer's pattern, and merges never cross words, so each distinct word is encoded once for all
its places. The distinct words of a block of the corpus are laid out end to end as bytes; an inverted index leads from each
mergeable pair to its positions, and merges are replayed in rank order: all positions of the lowest rank are merged at once, and
only the pairs they touch left and right enter the index anew. Encoded words are kept (up to ``KNOWN``) for the next blocks of the
same task. Blocks are replayed where they are read: texts are never shuffled, and the replay over blocks gives exactly what
the replay over the whole corpus would.

The rank file and pattern are parameters; the file is read on the driver and sent to executors once (its size is fixed).
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_value, slices, small_batches, text_or_empty

by_value(__name__)

#: Characters of a block, encoded words kept by a task, characters of words replayed at once.
BLOCK, KNOWN, AT_ONCE = 2_000_000, 250_000, 1_000_000


#: Code points that Unicode made letters or numbers after version 16, whose classes the tiktoken library has.
#: The regex module may be newer; words with these are cut again without them.
NEWER = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb "
    "\U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 "
    "\U00016ebb-\U00016ed3 \U00016ff2-\U00016ff3 \U00016ff4-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda "
    "\U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 "
    "\U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de "
    "\U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff "
    "\U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (= id) from a file of base64 tokens and ranks; a short, repeated or incomplete file raises ValueError."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    if len(set(ranks.values())) != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: every byte needs a token and every token a rank of its own")
    return ranks


def pair_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, ranks): the rank of the token that a pair of tokens makes, for every pair that makes one; a key is left << 20 | right."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                out[left << 20 | right] = rank
    keys = np.fromiter(out, np.int64, len(out))
    order = keys.argsort()
    return keys[order], np.fromiter(out.values(), np.int32, len(out))[order]


#: Stands for the end of a word on either side; no token has this id, as ids have 20 bits in a pair.
_END = 2**20 - 1


def replayer(ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray]) -> Callable[[list[bytes]], list[list[int]]]:
    """A function that encodes distinct words by replaying merges over all of them at once."""
    keys, values = pairs
    top = len(keys) - 1

    def made(left, right) -> np.ndarray:
        """Ranks of the tokens that pairs make, -1 where they make none."""
        k = np.asarray(left, np.int64) << 20 | right
        if top < 0:
            return np.full(k.shape, -1, np.int32)
        i = np.minimum(np.searchsorted(keys, k), top)
        return np.where(keys[i] == k, values[i], -1)

    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    first_pairs = made(single[:, None], single[None])

    def replay(words: list[bytes]) -> list[list[int]]:
        whole = [ranks.get(w) for w in words]
        todo = [w for w, r in zip(words, whole, strict=True) if r is None]
        raw = np.frombuffer(b"".join(todo), np.uint8)
        lengths = np.array([len(w) for w in todo], np.int64)
        owner = np.repeat(np.arange(len(todo), dtype=np.int32), lengths)
        n = len(raw)
        # Words end to end: symbols, neighbours and the rank of the pair that starts at a place (-1: none); place n is the end of every word.
        inner = owner[1:] == owner[:-1]
        sym, pair = np.append(single[raw], np.int32(_END)), np.full(n + 1, -1, np.int32)
        place = np.arange(n, dtype=np.int32)
        after, before = np.full(n + 1, n, np.int32), np.full(n + 1, n, np.int32)
        if n:
            pair[: n - 1] = np.where(inner, first_pairs[raw[:-1], raw[1:]], -1)
            after[: n - 1], before[1:n] = np.where(inner, place[1:], n), np.where(inner, place[:-1], n)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, of: np.ndarray) -> None:
            """Places (in order) into the index under their ranks."""
            some = of >= 0
            places, of = places[some], of[some]
            if not len(of):
                return
            by = of.argsort(kind="stable")
            places, of = places[by], of[by]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for r, part in zip(of[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heappush(heap, r)

        enter(place, pair[:n])
        while heap:
            r = heappop(heap)
            parts = index.pop(r)
            p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            p = p[pair[p] == r]
            if not len(p):
                continue
            q = after[p]
            # Of overlapping places (a a a) every second one merges, from the left.
            chain = q[:-1] == p[1:]
            if chain.any():
                at = np.arange(len(p))
                first = np.maximum.accumulate(np.where(np.append(False, chain), 0, at))
                p = p[(at - first) % 2 == 0]
                q = after[p]
            nxt, prv = after[q], before[p]
            x, y = made(r, sym[nxt]), made(sym[prv], r)
            lower = ((x >= 0) & (x < r)) | ((y >= 0) & (y < r))
            side = np.flatnonzero(nxt[:-1] == p[1:])  # both merge: their new tokens are neighbours
            if len(side):
                twice = int(made(r, r))
                x[side], y[side + 1] = twice, twice
                lower[side] |= 0 <= twice < r
            if lower.any():
                # A merge makes a pair of lower rank, which comes before the other merges of its word: those words merge one place only for now.
                held = np.isin(owner[p], owner[p[lower]])
                leads = np.append(True, owner[p[1:]] != owner[p[:-1]])
                late = p[held & ~leads]
                index[r] = [late]
                heappush(heap, r)
                p = p[~held | leads]
                q = after[p]
                nxt, prv = after[q], before[p]
            sym[p], sym[q], pair[q], after[p], before[nxt] = r, -1, -1, nxt, p
            x, y = made(r, sym[nxt]), made(sym[prv], r)
            pair[p], pair[prv] = x, y
            pair[n], before[n] = -1, n
            enter(p, x)
            enter(prv, y)
        alive = sym[:n] >= 0
        flat = sym[:n][alive].tolist()
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[alive], minlength=len(todo)))]).tolist()
        done = (flat[a:b] for a, b in zip(ends, ends[1:], strict=False))
        return [[r] if r is not None else next(done) for r in whole]

    return replay


def coder(ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray], pattern: str, keep: Callable = lambda ids: ids) -> Callable[[list[str]], Iterator[list]]:
    """A function from a block of texts to, for each, the list of what ``keep`` makes of the ids of its words. Each distinct word is encoded once."""
    import regex

    find = regex.compile(pattern).findall
    newer = "".join(NEWER.split())
    strict = regex.compile(pattern.replace(r"\p{L}", rf"[\p{{L}}--[{newer}]]").replace(r"\p{N}", rf"[\p{{N}}--[{newer}]]"), regex.V1).findall
    has_newer = regex.compile(f"[{newer}]").search
    may_have = re.compile(f"[{newer[0]}-\U0010ffff]").search  # far cheaper, and false for most texts
    replay = replayer(ranks, pairs)
    known: dict[str, object] = {}

    def words_of(texts: list[str]) -> Iterator[list]:
        if len(known) > KNOWN:
            known.clear()
        cut = [strict(t) if may_have(t) and has_newer(t) else find(t) for t in texts]
        new = [w for w in set().union(*cut) if w not in known]
        new.sort()  # words that begin alike lie together, and so do the places of a pair
        for part in _batches(new):
            known.update(zip(part, map(keep, replay([w.encode() for w in part])), strict=True))
        for words in cut:
            yield list(map(known.__getitem__, words))

    return words_of


def _batches(words: list[str]) -> Iterator[list[str]]:
    """Words replayed at once: AT_ONCE characters, or one longer word."""
    size, first = 0, 0
    for i, w in enumerate(words):
        if size and size + len(w) > AT_ONCE:
            yield words[first:i]
            size, first = 0, i
        size += len(w)
    if first < len(words):
        yield words[first:]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _mapped(docs: DataFrame, text: str, id: str, path: str, pattern: str, keep: Callable, row: Callable, fields: dict[str, str]) -> DataFrame:
    """``keep(ids, spelled)`` is what is kept of a word, ``row(kept)`` the fields of a text."""
    ranks = load_ranks(path)
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pair_ranks(ranks)))
    rows = docs.select(id, text_or_empty(text).alias("_text"))
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        spelled = {r: b for b, r in sent.value[0].items()}
        words_of = coder(*sent.value, pattern, lambda ids: keep(ids, spelled))
        gc.disable()  # nothing here is cyclic, and the words kept would be walked again and again
        try:
            for batch in slices(batches, 1024):
                out = [row(kept) for block in _blocks(batch.column(1).to_pylist()) for kept in words_of(block)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in zip(*out, strict=True)]], [id, *fields])
        finally:
            gc.enable()  # the worker goes on to other tasks

    return small_batches(rows).mapInArrow(run, f"`{id}` {kind}, " + ", ".join(f"{k} {v}" for k, v in fields.items()))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: id, ids (array<int>). Null texts count as empty and give no ids; other columns are ignored."""
    return _mapped(docs, text, id, path, pattern, lambda ids, _: ids, lambda kept: (np.fromiter(chain.from_iterable(kept), np.int32),), {"ids": "array<int>"})


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the ids decoded again).

    Digests are taken where texts are encoded, so that ids need not travel; the ids of each distinct word are written out and
    decoded once, with the ids themselves as the only source. Null texts count as empty."""

    def keep(ids, spelled):
        return "".join(f" {i}" for i in ids), len(ids), b"".join([spelled[i] for i in ids])

    def row(kept):
        told, counts, raw = zip(*kept, strict=True) if kept else ((), (), ())
        return sum(counts), hashlib.sha256("".join(told)[1:].encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()

    return _mapped(docs, text, id, path, pattern, keep, row, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})


def decode(encoded: DataFrame, path: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """One row per input row: id, text. Null lists decode to empty text; bytes that are not UTF-8 (an incomplete list) become U+FFFD; an unknown id raises KeyError."""
    sent = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))
    kind = encoded.schema[id].dataType.simpleString()

    def run(batches):
        spelled = {r: b for b, r in sent.value.items()}
        for batch in slices(batches):
            texts = [b"".join(map(spelled.__getitem__, x or ())).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id, "text"])

    return encoded.select(id, ids).mapInArrow(run, f"`{id}` {kind}, text string")
