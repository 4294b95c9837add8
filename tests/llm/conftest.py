import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, key string, size int, node int, t string, h long, e double"


def sentence(rng, n, words=None):
    words = words or ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "paper", "green", "seven", "under", "light", "north", "music"]
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty, blank and very long texts, copies that differ in white space, near copies, ties and repeated rows."""
    rng = random.Random(1)
    base = sentence(rng, 80)
    words = base.split()
    texts = [None, "", " \t\n", "one", "one", "two words", base, base.replace(" ", "\n", 3), base.replace(" ", "  "), " ".join(words[:79] + ["changed"]), " ".join(words[:60]), "contact a.b@c.de or +1 (234) 567-8901, card 4111111111111111 at 10.0.0.1",
             "x" * 30_000, sentence(rng, 20_000), "ä ß 漢字 \U0001f600 'tis don't  3.14", "12345 !!! ...", "password=3f9a1b77c0de99ab"]
    texts += [sentence(rng, rng.randrange(1, 120)) for _ in range(40)]
    out = []
    for i, t in enumerate(texts):
        source = None if i % 11 == 0 else f"src{i % 4}"
        out.append((i, t, None if i % 7 == 0 else "en", source, None, "x", 1, "k", 2, 3, "t", 4, 0.5))
    out += [out[6], out[6], out[9]]
    out.append((None, base, "en", "src1", 1, None, None, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
