"""Operators 11 to 13 against brute force, and mixing of repeated rows."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkspan.llm import alignment, hard_negatives, mixing, queries, repeats


def removed(rows, least=200):
    """doc_id to (n_bytes, n_removed, n_spans, kept_sha256) of its rows, by looking every string up."""
    times, out = Counter(), defaultdict(list)
    for r in rows:
        raw = (r[1] or "").encode()
        times.update(raw[i : i + least] for i in range(len(raw) - least + 1))
    for r in rows:
        raw = (r[1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - least + 1):
            if times[raw[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[r[0]].append((len(raw), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def told(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r[0]].append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


def passages(rng):
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 7))) for _ in range(n))
    known = [words(rng.randrange(30, 120)) for _ in range(12)]
    rows = [(i, " ".join([words(rng.randrange(1, 60)), rng.choice(known)[rng.randrange(0, 30) :], words(rng.randrange(1, 40)), rng.choice(known)])) for i in range(200)]
    odd = ["a" * 5000, "ab" * 700, "a" * 199, "a" * 200, None, "", rows[5][1], rows[5][1], rows[7][1][:150], "ä漢" * 300, known[0] * 2, "a line of text that is repeated\n" * 50]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, rows[6][1]), rows[8]]


def test_repeats(spark, docs, rows, empty, monkeypatch):
    """Passages that begin and end anywhere, runs of one letter, copies, nulls; also when most anchors have too many contexts for one task."""
    made = passages(random.Random(3))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    want = removed(made)
    assert told(repeats.repeat_digests(df)) == want and sum(x[1] for v in want.values() for x in v) > 50_000
    monkeypatch.setattr(repeats, "MANY", 8)
    assert told(repeats.repeat_digests(df)) == want
    assert told(repeats.repeat_digests(docs)) == removed(rows)
    assert repeats.repeat_digests(empty).count() == 0 and repeats.repeats(empty).count() == 0 and repeats.without_repeats(empty).count() == 0


def test_repeats_of_long_texts(spark, monkeypatch):
    """Texts worked on in pieces; a repeat lies across their border."""
    rng = random.Random(4)
    part = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = part(700)
    made = [(0, part(3000) + shared + part(3000)), (1, part(7000) + shared), (2, shared[100:450] + part(100))]
    monkeypatch.setattr(repeats, "AT_ONCE", 1 << 10)
    assert told(repeats.repeat_digests(spark.createDataFrame(made, "doc_id long, text string"))) == removed(made)


def test_repeat_groups(spark):
    """Every occurrence of every group has the group's bytes, every repeated string lies in a group, and groups cannot be longer on both sides."""
    made = passages(random.Random(6))[:120]
    df = spark.createDataFrame(made, "doc_id long, text string")
    raw = {i: t.encode() for i, t in made}
    groups = defaultdict(set)
    for r in repeats.repeats(df).collect():
        assert r["length"] >= 200
        groups[r["repeat"]].add((r["doc_id"], r["start"], r["length"]))
    gone = {i: np.zeros(len(t), bool) for i, t in raw.items()}
    inside = repeats.LEAST - repeats.GRAM
    for name, places in groups.items():
        strings = {raw[i][a : a + n] for i, a, n in places}
        assert len(strings) == 1 and hashlib.sha256(strings.pop()).hexdigest()[:32] == name and len(places) > 1
        n = next(iter(places))[2]
        if n < 2 * inside:  # not cut by the reach of an anchor
            assert len({raw[i][a - 1 : a] if a else i for i, a, _ in places}) > 1 or n >= inside + repeats.GRAM
        for i, a, n in places:
            gone[i][a : a + n] = True
    assert {i: int(g.sum()) for i, g in gone.items()} == {i: v[0][1] for i, v in removed(made).items()}
    kept = {r[0]: r[1] for r in repeats.without_repeats(df).collect()}
    assert all(kept[i] == np.frombuffer(raw[i], np.uint8)[~gone[i]].tobytes().decode() for i in raw)


def test_intervals():
    """The tree of common prefixes of a suffix array, against every run of neighbours."""
    rng = random.Random(1)
    for _ in range(50):
        common = np.array([rng.randrange(5) for _ in range(rng.randrange(0, 12))], np.int64)
        want = set()
        for a in range(len(common)):
            for b in range(a, len(common)):
                d = common[a : b + 1].min()
                if d >= 1 and (a == 0 or common[a - 1] < d) and (b + 1 == len(common) or common[b + 1] < d):
                    want.add((int(d), a, b + 1))
        assert set(repeats.intervals(common, 1)) == want


def negatives(rows):
    """What op12 asks for, by comparing everything with whole numbers."""
    good = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (anchor, lab, q) in enumerate(good):
        if anchor is None or anchor % 50:
            continue
        score = [(m, i, other, sum(a * b for a, b in zip(q, v, strict=True))) for m, (i, other, v) in enumerate(good) if m != n and len(v) == len(q)]
        first = sorted((x for x in score if x[2] == lab), key=lambda x: (-x[3], last(x[1])))[:5]
        for _, pos, _, p in first:
            fit = sorted((x for x in score if x[2] != lab and 50 * p <= 100 * x[3] <= 95 * p), key=lambda x: (-x[3], last(x[1])))[:3]
            out += [(anchor, pos, k + 1, x[1], p, x[3]) for k, x in enumerate(fit)]
    return sorted(out, key=str)


def test_hard_negatives(spark, monkeypatch):
    """Nulls, not finite and zero vectors, lengths that differ, ties, repeated rows, a label with a third of all rows, huge components; one block or many."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(700):
        lab = 3 if rng.random() < 0.35 else int(rng.integers(0, 10))
        rows.append((i, [float(x) for x in rng.integers(-3, 6, 6) / 4], lab))
    rows += [(700, None, 1), (750, [0.5] * 6, None), (800, [0.5, None, 1.0, 1.0, 1.0, 1.0], 2), (850, [float("nan")] + [1.0] * 5, 2), (900, [float("inf")] + [1.0] * 5, 2), (950, [0.0] * 6, 4), (1000, [], 3), (1001, [], 3), (1050, [1.0, 2.0], 5), (1051, [2.0, 2.0], 5), (1052, [1.0, 1.0], 6)]
    rows += [rows[100], rows[100], rows[101], (None, [1.0] * 6, 3), (None, [1.0] * 6, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"rid": F.lit(1), "score": F.lit(2), "cell": F.lit("x"), "key": F.lit("k")}).repartition(4)
    got = lambda: sorted((tuple(r) for r in hard_negatives.mine_embeddings(df).collect()), key=str)
    want = negatives(rows)
    assert got() == want and len(want) > 100
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    assert got() == want
    large = [(i, [float(x) * 2.0**19 + float(y) for x, y in zip(rng.integers(1, 9, 4), rng.integers(0, 9, 4), strict=True)], int(i % 2)) for i in range(60)]  # sums beyond what doubles hold
    exact = sorted((tuple(r) for r in hard_negatives.mine_embeddings(spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert exact == negatives(large) and any(r[4] > 2**53 for r in exact)
    assert hard_negatives.mine_embeddings(df.where("false")).count() == 0 and hard_negatives.mine_embeddings(df.withColumn("label", F.lit(None).cast("int"))).count() == 0


def test_brackets():
    """Scores lie within the bounds that the pivots give."""
    rng = np.random.default_rng(3)
    v, q = rng.integers(-200, 200, (300, 12)).astype(float), rng.integers(-200, 200, (20, 12)).astype(float)
    most = float(np.sqrt((v * v).sum(1).max()) * (1 + 1e-9))
    for sample in (list(v[:50]), list(v[:50, :5]), [np.append(x, [3.0, 4.0]) * 0.5 for x in v[:50]]):
        pivots = hard_negatives.Pivots(sample, most)
        low, high = hard_negatives.bracket(pivots.distances(v), pivots.distances(q, True), (q * q).sum(1), most)
        assert (low <= q @ v.T).all() and (q @ v.T <= high).all() and (high - low).mean() < 4 * most**2


def aligned(rows):
    """What op13 asks for, by the two libraries themselves, token by token."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = alignment.byte_letters()
    spelled = {i: bytes(letters[c] for c in w) for w, i in t.get_vocab(False).items() if i < 50256}
    own = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    each, count = [], Counter()
    for r in rows:
        text = r[1] or ""
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        x, y = [spelled[i] for i in a], [own(i) for i in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            each.append(None)
            continue
        ends = [{int(e): i for i, e in enumerate(np.cumsum([len(p) for p in z]))} for z in (x, y)]
        cuts, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for c in cuts:
            groups.append(",".join(map(str, a[i : ends[0][c] + 1])) + "|" + ",".join(map(str, b[j : ends[1][c] + 1])))
            i, j = ends[0][c] + 1, ends[1][c] + 1
        links = [(a[ends[0][c]], b[ends[1][c]]) for c in cuts]
        count.update(links)
        each.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = defaultdict(list)
    for r, w in zip(rows, each, strict=True):
        out[r[0]].append((0, 0, 0, 0, 0, 0, "") if w is None else (w[0], w[1], w[2], len(w[3]), sum(count[x] == best[x[1]] for x in w[3]), sum(count[x] for x in w[3]), w[4]))
    return {k: sorted(v) for k, v in out.items()}


ODD = ["<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b and words after", "▁", " ", "  ", "a  b ", "tail \n\n", "　x \x85y \xa0z", "\x00 \x1c a", "漢字かな交じり文 ﬁ ½ Ａ é ́", "it's we'll DON'T", "x" * 5000, "🙂🙂 👩‍👩‍👧", " " * 3000 + "end", "a\t\tb\r\nc"]


def test_alignment(spark, docs, rows, empty, monkeypatch):
    files = queries.two_tokenizers()
    made = [(r[0], r[1]) for r in rows] + [(5000 + i, t) for i, t in enumerate(ODD)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made[len(rows) :], "doc_id long, text string")).withColumns({"pairs": F.lit(1), "n_a": F.lit("x"), "salt": F.lit(2)}).repartition(3)
    want = aligned(made)
    assert told(alignment.align_digests(df, **files)) == want and sum(v == [(0, 0, 0, 0, 0, 0, "")] for v in want.values()) >= 4
    monkeypatch.setattr(alignment, "UNITS", 10)
    monkeypatch.setattr(alignment, "AT_ONCE", 500)
    assert told(alignment.align_digests(df, **files)) == want
    assert alignment.align_digests(empty, **files).count() == 0


def test_alignment_in_one_piece():
    """Whole texts give what their units give; tokens without bytes link with all that end where they do."""
    files = queries.two_tokenizers()
    with open(files["path_a"], "rb") as f, open(files["path_b"], "rb") as g:
        own = alignment.Aligner(alignment.ByteLevel(f.read(), files["pattern"]), alignment.Pieces(g.read()), 32000)
    assert own.b.apart
    for text in ["some words, and more  words", "x", *ODD]:
        apart, whole = next(iter(own.texts([text]))), own.whole(text)
        assert apart[:5] == whole[:5] and list(apart[5]) == list(whole[5]) and list(apart[6]) == list(whole[6])
    cuts, ga, gb, la, lb, _ = alignment.align(np.array([0, 1, 2]), np.array([1, 0, 2]), np.array([2, 0, 1]), np.array([0, 2, 1]))
    assert cuts.tolist() == [2, 3] and ga.tolist() == [0, 0, 1] and gb.tolist() == [0, 0, 1]
    assert sorted(zip(la.tolist(), lb.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]


def test_mixing_of_repeated_rows(spark):
    """A source whose rows are all equal comes as near its target as one of rows that differ."""
    for n, size in ((1000, 4), (300, 5)):
        equal = [(1, "w " * size, "a", i % 2) for i in range(n)]
        others = [(10 + i, f"t{i} " * size, s, 0) for i in range(n) for s in "bc"]
        df = spark.createDataFrame(equal + others, "doc_id long, text string, source string, n_chars int").repartition(7)
        out = mixing.mix(df).groupBy("target", F.col("doc_id") == 1).agg(F.sum("taken").alias("taken")).collect()
        assert len(out) == 3 and all(abs(r["taken"] - r["target"]) <= size for r in out)
        whole = mixing.mixed(df)
        assert whole.columns == df.columns and whole.where("doc_id = 1").count() * size == next(r["taken"] for r in out if r[1])
        assert mixing.mix(df).groupBy("doc_id", "taken").count().exceptAll(mixing.mix(df.repartition(3)).groupBy("doc_id", "taken").count()).count() == 0


def tree(paths, support=20, differ=1.96):
    """Templates of the paths (segments, y) of one root, node by node and level by level."""
    out, nodes = [None] * len(paths), [("", 0, list(range(len(paths))))]
    while nodes:
        name, level, members = nodes.pop()
        on = [i for i in members if len(paths[i][0]) > level]
        if len(on) < support:
            on = []
        for i in set(members) - set(on):
            out[i] = name + "/*" * (len(paths[i][0]) - level)
        branch = defaultdict(list)
        for i in on:
            branch[paths[i][0][level]].append(i)
        count = lambda s: (sum(paths[i][1] is not None for i in branch[s]), sum(paths[i][1] or 0 for i in branch[s]))  # noqa: B023, E731
        wide = {s: count(s) for s in branch if len(branch[s]) >= support}
        parts, before = [], None
        for k, b in sorted(set(wide.values()), key=lambda c: (c[0] == 0, c[1] / c[0] if c[0] else 0.5, c[0])):
            new = before is None
            if not new:
                k0, b0 = before
                p = (b + b0 + 1) / (k + k0 + 2)
                new = abs((b + 0.5) / (k + 1) - (b0 + 0.5) / (k0 + 1)) / (p * (1 - p) * (1 / (k + 1) + 1 / (k0 + 1))) ** 0.5 >= differ or (k == 0) != (k0 == 0)
            if new:
                parts.append([])
            parts[-1] += [s for s in wide if wide[s] == (k, b)]
            before = k, b
        names = {}
        for part in parts:
            k, b = sum(wide[s][0] for s in part), sum(wide[s][1] for s in part)
            rate = b / k if k else 0
            spread = sum(wide[s][1] ** 2 / wide[s][0] for s in part) - b * rate if k else 0
            uneven = spread / (rate * (1 - rate)) if k and 0 < rate < 1 else 0
            free = len(part) - 1
            for group in [sorted(part)] if k and uneven <= free + differ * (2 * free) ** 0.5 else [[s] for s in part]:
                label = group[0] if len(group) == 1 else "|".join(group) if len(group) == 2 else f"{group[0]}|{group[-1]}|+{len(group) - 2}"
                names |= dict.fromkeys(group, label)
        below = defaultdict(list)
        for s, ids in branch.items():
            below[names.get(s, "*")] += ids
        nodes += [(f"{name}/{n}", level + 1, ids) for n, ids in below.items()]
    return out


def test_path_templates(spark):
    """The same templates as a plain tree gives: branches alike and not, chains with paths that end inside them, deep paths that occur often, many partitions."""
    from linkspan.llm import url_filter

    rng = random.Random(8)
    rows = []
    for _ in range(900):
        a = rng.choice("abcdef")
        bad = {"a": 0.05, "b": 0.08, "c": 0.9, "d": 0.85, "e": 0.5}.get(a, 0)
        segments = [a, *(["x", "y"][: rng.randrange(3)]), f"n{rng.randrange(40)}", *([f"p{rng.randrange(500)}"] if rng.random() < 0.5 else [])]
        rows.append((f"h{rng.randrange(4)}", segments, int(rng.random() < bad) if rng.random() < 0.6 else None))
    rows += [("deep", [f"s{i}" for i in range(1000)], 1)] * 25 + [("chain", ["s"] * n, 0) for n in range(40)] + [("", [], None)] * 3
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rid long, host string, segments array<string>, y int").withColumn("all", F.lit("")).repartition(200)
    out = url_filter.templates(df, ("host", "all"))
    got = {(r["rid"], r["tree"]): r["template"] for r in out.collect()}
    assert len(got) == 2 * len(rows) and out.rdd.getNumPartitions() <= 200
    for host in {r[0] for r in rows}:
        ids = [i for i, r in enumerate(rows) if r[0] == host]
        assert [got[i, 0] for i in ids] == tree([rows[i][1:] for i in ids]), host
    assert [got[i, 1] for i in range(len(rows))] == tree([r[1:] for r in rows])


def test_grams_make_few_arrays():
    """Hashing is most of op11's work: the same hashes as from a sum that copies its words and makes an array for each, in less time."""
    raw = np.random.default_rng(1).integers(97, 123, 3400).astype(np.uint8)

    def plain():
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel()
        n = len(raw) - 63
        h = np.zeros(n, np.uint64)
        for i in range(8):
            h += words[8 * i : 8 * i + n] * repeats.FACTORS[i]
        h ^= h >> np.uint64(32)
        h *= repeats.FACTORS[-1]
        h ^= h >> np.uint64(29)
        return h

    def least(f):
        times = []
        for _ in range(300):
            t = time.thread_time_ns()
            f()
            times.append(time.thread_time_ns() - t)
        return min(times)

    assert (repeats.grams(raw, 64) == plain()).all() and least(lambda: repeats.grams(raw, 64)) < 0.85 * least(plain)


@pytest.mark.parametrize("gram", [8, 24, 64])
def test_grams_and_least_places_against_plain_loops(gram):
    raw = np.random.default_rng(gram).integers(0, 4, 1500).astype(np.uint8)
    raw[900:1400] = raw[100:600]
    h = repeats.grams(raw, gram)
    of = {}
    assert len(h) == 1500 - gram + 1 and all(of.setdefault(raw[i : i + gram].tobytes(), x) == x for i, x in enumerate(h.tolist())) and len(set(of.values())) == len(of)
    high = h & ~np.uint64(repeats.AT_ONCE * 2 - 1)
    for width in (1, 2, 5, 137):
        assert repeats._lowest(h, width).tolist() == sorted({i + int(np.argmin(high[i : i + width])) for i in range(len(h) - width + 1)})
