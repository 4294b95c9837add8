"""Cross-tokenizer alignment (13): where the tokens of two tokenizers end at the same byte, and which ids meet there.

Both tokenizers write a text as bytes; running sums of token lengths are where tokens end (``cumsum``), ends that both have are
cuts (``intersect1d``), the cut at or after a token's end is its group (``searchsorted``), and tokens that end at the same cut are
linked, all with all (``repeat``). Pairs of ids are added up over the corpus in two shuffles, first by pair and salt, then by pair.

Neither tokenizer merges across a place where a blank follows something that is no white space, so a text is a row of *units*
that are encoded apart: every unit ends in a cut, and what is known of a distinct unit (ids, groups, links) is worked out once in
a task for all new units together. That is checked against the vocabulary of the second tokenizer; with one that has pieces
across such places, or that changes texts, and for texts with a unit whose bytes differ, whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, hub_join, slices, small_batches, text_or_empty, written

by_value(__name__)

#: Units that a task remembers at most before it begins anew, bytes of texts worked on at once, shares of a pair in the first shuffle.
UNITS, AT_ONCE, SALTS = 400_000, 4_000_000, 16
#: A blank after something that is no white space; the blank belongs to what follows.
UNIT = re.compile(r"(?<=\S) ")
COLUMNS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pairs": "array<long>", "times": "array<int>"}


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next one from 256 on."""
    shows = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shows]
    return {chr(b): b for b in shows} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """The first tokenizer: byte-level BPE of a ``tokenizers`` file, special tokens read as plain text.

    Where the file's merges are in the order of their ids the ids are ranks, and ``tiktoken`` gives the same ids several times faster."""

    def __init__(self, raw: bytes, pattern: str):
        told = json.loads(raw)
        letters, special = byte_letters(), {t["content"] for t in told["added_tokens"]}
        vocab = {w: i for w, i in told["model"]["vocab"].items() if w not in special}
        spelled = {i: bytes(letters[c] for c in w) for w, i in vocab.items()}
        self.spelled = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        made = [told["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in told["model"]["merges"]]
        before = told.get("pre_tokenizer") or {}
        if made == sorted(made) and told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"):
            import tiktoken

            self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={b: i for i, b in spelled.items()}, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(raw.decode())
            own.encode_special_tokens = True
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids


class Pieces:
    """The second tokenizer: a SentencePiece model, which sets a blank before every text."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.blank = self.model.piece_to_id("▁")
        plain = [p.replace("▁", " ") for i, p in enumerate(names) if not self.model.is_byte(i) and not self.model.is_control(i)]
        probe = "a  b\n c　 ﬁ é "
        self.apart = not any(UNIT.search(p) for p in plain) and self.model.encode(probe) == [i for unit in self.encode(UNIT.split(probe)) for i in unit]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, the blank before it included; of an empty text the blank alone."""
        return [ids or [self.blank] for ids in self.model.encode(texts, num_threads=1)]


def align(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple:
    """Cuts, the group of every token, and the links (places in ``a``, places in ``b``) of two encodings of the same bytes.

    ``a``, ``b``: ids; ``size_a``, ``size_b``: bytes of each id. Tokens of no bytes end where the one before them ends."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=bool(size_a[a].all() and size_b[b].all()))
    first_a, first_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
    n_a, n_b = np.searchsorted(end_a, cuts, "right") - first_a, np.searchsorted(end_b, cuts, "right") - first_b
    n = n_a * n_b
    at = np.repeat(np.arange(len(cuts)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return cuts, np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), first_a[at] + nth // n_b[at], first_b[at] + nth % n_b[at], at


class Aligner:
    """What a task knows: both tokenizers and the units met so far."""

    def __init__(self, a: ByteLevel, b: Pieces, many: int):
        self.a, self.b, self.many = a, b, many
        self.size_a, self.size_b = (np.array([len(x) for x in t.spelled], np.int64) for t in (a, b))
        told = lambda spelled, ends: np.array([f"{i}{e}" for i in range(len(spelled)) for e in ends], object)
        self.told_a, self.told_b = told(a.spelled, ",|"), told(b.spelled, ",;")
        self.forget()

    def forget(self) -> None:
        self.known, self.rows, self.told = {}, np.zeros((0, 6), np.int64), []
        self.pairs = np.zeros(0, np.int64)

    @staticmethod
    def spell(side, ids: list[list[int]], raw: list[bytes]) -> np.ndarray:
        """Whether each list of ids gives its bytes back."""
        flat = [*map(side.spelled.__getitem__, chain.from_iterable(ids))]
        ends = np.cumsum([0, *map(len, flat)])[np.cumsum([len(x) for x in ids])]
        if (ends == np.cumsum([len(r) for r in raw])).all() and b"".join(flat) == b"".join(raw):
            return np.ones(len(raw), bool)
        return np.array([b"".join(map(side.spelled.__getitem__, x)) == r for x, r in zip(ids, raw, strict=True)])

    def learn(self, units: list[str]) -> None:
        """Adds to what is known: per unit its numbers of tokens, groups and links, where its links begin, whether its bytes agree, and its groups as text."""
        ids_a, ids_b = [self.a.encode(" " + u) for u in units], self.b.encode(units)
        raw = [b" " + u.encode() for u in units]
        same = self.spell(self.a, ids_a, raw) & self.spell(self.b, ids_b, raw)
        if not same.all():
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, same, strict=True)] for ids in (ids_a, ids_b))
        a, b = (np.array(list(chain.from_iterable(ids)), np.int64) for ids in (ids_a, ids_b))
        cuts, group_a, group_b, link_a, link_b, at = align(a, b, self.size_a, self.size_b)
        whole = np.cumsum([len(r) if ok else 0 for r, ok in zip(raw, same, strict=True)])
        owner = np.searchsorted(whole, cuts)
        n_groups, n_links = (np.bincount(x, minlength=len(units)) for x in (owner, owner[at]))
        # The groups as text: tokens of both sides in the order of their groups, each with the sign that follows it.
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(a)], np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        in_a, in_b = (np.bincount(g, minlength=len(cuts)) for g in (group_a, group_b))
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = self.told_a[2 * a + last_a]
        out[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = self.told_b[2 * b + last_b]
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        ends = np.cumsum(n_a + n_b)
        out = out.tolist()
        self.told += ["".join(out[e - n : e]) for e, n in zip(ends.tolist(), (n_a + n_b).tolist(), strict=True)]
        begins = len(self.pairs) + np.cumsum(n_links) - n_links
        self.known |= {u: len(self.rows) + i for i, u in enumerate(units)}
        self.rows = np.concatenate([self.rows, np.stack([n_a, n_b, n_groups, n_links, begins, same], 1)])
        self.pairs = np.concatenate([self.pairs, a[link_a] * self.many + b[link_b]])

    def texts(self, texts: list[str]):
        """For each text the values of COLUMNS."""
        parts = [(UNIT.split(t) if self.b.apart else [t]) if t else [] for t in texts]
        if len(self.known) > UNITS:
            self.forget()
        new = list(dict.fromkeys(u for p in parts for u in p if u not in self.known))
        if new:
            self.learn(new)
        for text, units in zip(texts, parts, strict=True):
            at = np.array([*map(self.known.__getitem__, units)], np.int64)
            if not self.rows[at, 5].all():
                yield self.whole(text)
                continue
            own, often = np.unique(at, return_counts=True)
            n = self.rows[own, 3]
            where = np.repeat(self.rows[own, 4] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs, place = np.unique(self.pairs[where], return_inverse=True)
            times = np.bincount(place, np.repeat(often, n), len(pairs)).astype(np.int32)
            told = "".join(map(self.told.__getitem__, at.tolist()))
            yield *self.rows[at, :4].sum(0).tolist(), hashlib.sha256(told[:-1].encode()).hexdigest() if told else "", pairs, times

    def whole(self, text: str) -> tuple:
        """The same of a text some unit of which does not agree, taken in one piece."""
        a, b = np.array(self.a.encode(" " + text), np.int64), np.array(self.b.encode([text])[0], np.int64)
        raw = b" " + text.encode()
        if b"".join(self.a.spelled[i] for i in a) != raw or b"".join(self.b.spelled[i] for i in b) != raw:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)
        cuts, group_a, group_b, link_a, link_b, _ = align(a, b, self.size_a, self.size_b)
        side = lambda ids, group, g: ",".join(map(str, ids[np.searchsorted(group, g) : np.searchsorted(group, g, "right")]))
        told = ";".join(f"{side(a, group_a, g)}|{side(b, group_b, g)}" for g in range(len(cuts)))
        pairs, times = np.unique(a[link_a] * self.many + b[link_b], return_counts=True)
        return len(a), len(b), len(cuts), len(link_a), hashlib.sha256(told.encode()).hexdigest(), pairs, times.astype(np.int32)


def _blocks(texts: list[str]):
    """Runs of texts of some AT_ONCE letters."""
    block, n = [], 0
    for t in texts:
        block.append(t)
        n += len(t)
        if n >= AT_ONCE:
            yield block
            block, n = [], 0
    if block:
        yield block


def aligned(docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: _row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a * |B| + b), times; written to the shared folder."""
    with open(path_a, "rb") as f, open(path_b, "rb") as g:  # vocabularies of the driver's machine
        files = f.read(), g.read()
    many = len(Pieces(files[1]).spelled)
    sent = docs.sparkSession.sparkContext.broadcast(files)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id).alias("_id"), text_or_empty(text).alias("_text"))
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        own = Aligner(ByteLevel(sent.value[0], pattern), Pieces(sent.value[1]), many)
        for batch in slices(batches, 1024):
            out = [row for block in _blocks(batch.column(2).to_pylist()) for row in own.texts(block)]
            *cols, pairs, times = zip(*out, strict=True)
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, np.concatenate(x)) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, cols), *lists], ["_row", "_id", *COLUMNS])

    return written(small_batches(rows).mapInArrow(run, f"_row long, _id {kind}, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))), many


def links(rows: DataFrame, many: int) -> DataFrame:
    """(pair, a, b, count, best): how often two ids are linked in the corpus, and whether no other id is linked with ``b`` more often.

    Sums are made by pair and salt, then by pair, each with partial sums before the shuffle; a pair that every document has is a
    few rows. ``b`` has as many values as the second vocabulary, which bounds the broadcast."""
    each = rows.select(F.pmod(F.xxhash64("_row"), F.lit(SALTS)).alias("salt"), F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    each = each.groupBy(F.col("x.pairs").alias("pair"), "salt").agg(F.sum("x.times").alias("count"))
    pairs = each.groupBy("pair").agg(F.sum("count").alias("count")).withColumn("b", F.pmod("pair", F.lit(many)))
    pairs = written(pairs)
    top = pairs.groupBy("b").agg(F.max("count").alias("top"))
    return pairs.join(F.broadcast(top), "b").select("pair", F.expr(f"pair div {many}").alias("a"), "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align_digests(docs: DataFrame, path_a: str, path_b: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, or whose bytes either tokenizer does not give back (the second one writes U+2581 as a blank), have
    no tokens: zeros and ''. Repeated rows count as often as they occur; other columns are ignored; an empty table gives an empty result.
    Documents meet the counts of their pairs by the pair: pairs with a large share of all links by a broadcast of at most 50,000 of
    them, the others by a shuffle."""
    rows, many = aligned(docs, path_a, path_b, pattern, text, id)
    facts = written(links(rows, many).select("pair", "count", "best", F.col("count").alias("n")))
    total = facts.agg(F.sum("count")).first()[0] or 0
    each = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    told = hub_join(each, facts, "pair", "n", total).groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(told, "_row", "left").select(F.col("_id").alias(id), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
