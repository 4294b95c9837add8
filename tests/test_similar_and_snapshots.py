"""Scored names against comparing all with all; indexes in versions while they are replaced."""

import math
import random
from collections import Counter

import pytest

from linkspan.operators import similar
from linkspan.sources import snapshots


def shares(name):
    words = name.split()
    return {f"w:{w}" for w in words} | {f"^{w}$"[i : i + 3] for w in words for i in range(len(w))}


def best(texts, names, least, k):
    names = sorted({n.strip().lower() for n in names if n and n.strip()})
    df = Counter(x for n in names for x in shares(n))
    weight = lambda xs: sum(math.floor(100 * math.log(len(names) / df.get(x, 1))) + 1 for x in xs)
    out = set()
    for t in {t.strip().lower() for t in texts if t and t.strip()}:
        scored = [(200 * weight(shares(t) & shares(n)), weight(shares(t)) + weight(shares(n)), n) for n in names]
        for place, (c, both, n) in enumerate(sorted((x for x in scored if x[0] >= least * x[1]), key=lambda x: (-(x[0] / 200) / x[1], x[2]))[:k], 1):
            out.add((t, n, c // both, place))
    return out


@pytest.mark.parametrize("least", [30, 60, 90])
def test_scored_names(spark, least):
    rng = random.Random(least)
    words = ["acid", "salt", "sodium", "chloride", "beta", "alpha", "hydro", "oxide", "vitamin", "complex", "extract", "of", "and"]
    names = [" ".join(rng.choice(words) + rng.choice(["", "", "s", "ine"]) for _ in range(rng.randrange(1, 5))) for _ in range(150)] + ["", "  ", None, "Acid  SALT", "acid salt"]
    texts = [" ".join(rng.sample(n.split(), len(n.split()))) for n in names[:60]] + [n[1:] + "x" for n in names[60:100]] + [None, "", "zzz qqq", "ACID salt"]
    frame = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = similar.scored_names(frame(texts, "t"), frame(names, "k"), least, 3)
    want = best(texts, names, least, 3)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50
    assert similar.scored_names(frame(texts, "t"), frame([], "k")).isEmpty() and similar.scored_names(frame([], "t"), frame(names, "k")).isEmpty()


def test_reordered_words_are_found(spark):
    """Words in another order share all but nothing less: full score, whatever the edit distance."""
    names = spark.createDataFrame([("alpha beta gamma",), ("beta delta",), ("omega",)], "k string")
    out = similar.scored_names(spark.createDataFrame([("Gamma Alpha  beta",)], "t string"), names, 60, 1).collect()
    assert [tuple(r) for r in out] == [("gamma alpha  beta", "alpha beta gamma", 100, 1)]


def test_snapshots(spark, tmp_path):
    path, schema = str(tmp_path / "index"), "id long"
    assert snapshots.read(spark, path, schema).isEmpty() and snapshots.versions(spark, path).isEmpty()
    assert snapshots.write(spark.range(10), path) == 1
    reader = snapshots.read(spark, path, schema)
    folder = snapshots.stage(spark.range(100, 130), path)  # under way
    assert reader.count() == 10 and snapshots.read(spark, path, schema).count() == 10
    assert snapshots.commit(spark, path, folder, "`id` bigint") == 2
    assert reader.count() == 10 and snapshots.read(spark, path, schema).count() == 30 and snapshots.read(spark, path, schema, 1).count() == 10
    assert {(r["version"], r["n_rows"]) for r in snapshots.versions(spark, path).collect()} == {(1, 10), (2, 30)}
    with pytest.raises(ValueError, match="no version 7"):
        snapshots.read(spark, path, schema, 7)
    assert snapshots.write(spark.range(0), path) == 3 and snapshots.read(spark, path, schema).isEmpty()


def test_two_writers(spark, tmp_path, monkeypatch):
    """Both see the same newest version; the second to commit raises and the first one's rows stay."""
    path = str(tmp_path / "index")
    one, two = snapshots.stage(spark.range(5), path), snapshots.stage(spark.range(7), path)
    seen = snapshots.versions(spark, path)
    assert snapshots.commit(spark, path, one, "`id` bigint") == 1
    monkeypatch.setattr(snapshots, "versions", lambda *_: seen)
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        snapshots.commit(spark, path, two, "`id` bigint")
    monkeypatch.undo()
    assert snapshots.read(spark, path, "id long").count() == 5
    assert snapshots.commit(spark, path, two, "`id` bigint") == 2 and snapshots.read(spark, path, "id long").count() == 7
