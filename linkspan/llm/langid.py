"""Language ID (4): a byte convolutional network over fixed-length windows.

Bytes are embedded, filters of several widths run over a window, each filter keeps its largest response, and a softmax layer
names the language. The network is trained in numpy on a bounded sample of windows (``PER_LANGUAGE`` texts of each of at most
``LANGUAGES`` languages; drawn by hash, so that reruns agree). A trained filter is a table of responses by pairs of bytes, so that applying it is
a few lookups and additions. Every window of every text is scored; a text takes the language with the largest mean
log-probability over its windows, weighted by their bytes. Texts are read once and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, slices, small_batches, text_or_empty

by_value(__name__)

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
#: Texts of each language from which the network learns, windows from each of them, languages at most (the most frequent).
PER_LANGUAGE, PER_TEXT, LANGUAGES = 800, 3, 200
EPOCHS, BATCH, RATE = 6, 64, 0.004
PAD = 256
#: Windows scored at once.
AT_ONCE = 256


def windows(raw: bytes, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, one after another, the last filled with PAD; at least one."""
    n = max(1, -(-len(raw) // length))
    out = np.full(n * length, PAD, np.int32)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, length)


def train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """Weights of the network after Adam on windows x (n, WINDOW) with classes y."""
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.3, (PAD + 1, EMBED)), "v": np.zeros((FILTERS * len(WIDTHS), classes)), "c": np.zeros(classes)}
    for w in WIDTHS:
        p[f"k{w}"], p[f"b{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)), np.zeros(FILTERS)
    p["v"] = rng.normal(0, 0.1, p["v"].shape)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        rate = RATE * (1 - 0.9 * epoch / epochs)
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            xb, yb, n = x[at], y[at], len(at)
            emb = p["e"][xb]
            parts, keep = [], {}
            for w in WIDTHS:
                span = WINDOW - w + 1
                cols = np.concatenate([emb[:, o : o + span] for o in range(w)], 2)
                z = cols.reshape(-1, w * EMBED) @ p[f"k{w}"] + p[f"b{w}"]
                z = z.reshape(n, span, FILTERS)
                best = z.argmax(1)
                top = np.take_along_axis(z, best[:, None, :], 1)[:, 0]
                keep[w] = (cols, best, top)
                parts.append(np.maximum(top, 0))
            h = np.concatenate(parts, 1)
            logit = h @ p["v"] + p["c"]
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            d = prob
            d[np.arange(n), yb] -= 1
            d /= n
            g = {"v": h.T @ d, "c": d.sum(0), "e": np.zeros_like(p["e"])}
            dh = d @ p["v"].T
            rows = np.arange(n)[:, None]
            for i, w in enumerate(WIDTHS):
                cols, best, top = keep[w]
                dz = dh[:, i * FILTERS : (i + 1) * FILTERS] * (top > 0)
                seen = cols[rows, best]  # (n, FILTERS, w * EMBED): only where a filter was largest
                g[f"k{w}"], g[f"b{w}"] = np.einsum("nfk,nf->kf", seen, dz), dz.sum(0)
                back = dz[:, :, None] * p[f"k{w}"].T[None]
                for o in range(w):
                    np.add.at(g["e"], xb[rows, best + o], back[:, :, o * EMBED : (o + 1) * EMBED])
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def tables(p: dict) -> dict:
    """Responses of all filters by pairs of bytes and single bytes: width 2 is one lookup, width 3 a pair and a byte, width 4 two pairs."""
    by = lambda w, o: p["e"] @ p[f"k{w}"][o * EMBED : (o + 1) * EMBED]
    pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
    return {
        "w2": pair(by(2, 0), by(2, 1)) + p["b2"], "w3": pair(by(3, 0), by(3, 1)) + p["b3"], "w3last": by(3, 2),
        "w4": pair(by(4, 0), by(4, 1)) + p["b4"], "w4last": pair(by(4, 2), by(4, 3)), "v": p["v"], "c": p["c"],
    }


def log_probabilities(x: np.ndarray, t: dict) -> np.ndarray:
    """(windows, classes) log-probabilities of windows x."""
    out = []
    for i in range(0, len(x), AT_ONCE):
        w = x[i : i + AT_ONCE]
        two = w[:, :-1] * (PAD + 1) + w[:, 1:]
        h = np.concatenate([
            t["w2"][two].max(1),
            (t["w3"][two[:, :-1]] + t["w3last"][w[:, 2:]]).max(1),
            (t["w4"][two[:, :-2]] + t["w4last"][two[:, 2:]]).max(1),
        ], 1)
        logit = np.maximum(h, 0) @ t["v"] + t["c"]
        logit -= logit.max(1, keepdims=True)
        out.append(logit - np.log(np.exp(logit).sum(1, keepdims=True)))
    return np.concatenate(out)


def held_out(id: str = "doc_id") -> Column:
    """Whether the remainder of crc32 of the id as text by 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = PER_LANGUAGE) -> tuple[list[str], dict] | None:
    """(languages, tables) learned from rows that have an id, a text with letters and a language and are not held out; None without such rows.

    The sample is bounded: ``per_language`` texts of each language, chosen by hash of id and text, and PER_TEXT windows at hashed places
    of each. It is drawn by a threshold on the hash, from counts by language, so that no language is sorted.
    """
    known = docs.where(~held_out(id) & F.col(id).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"), F.xxhash64(id, text).alias("h"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    names = sorted(r["lang"] for r in counts)
    share = F.element_at(F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 1.5 * per_language / r["count"]))]), F.col("lang"))
    spread = F.pmod("h", F.lit(1_000_003)) / 1_000_003
    drawn = known.where(F.col("lang").isin(names) & (spread < share))
    size = F.octet_length("t")
    places = F.transform(F.sequence(F.lit(0), F.lit(PER_TEXT - 1)), lambda k: F.pmod(F.xxhash64("h", k), F.greatest(F.lit(1), size - WINDOW)).cast("int") + 1)
    cut = F.transform(places, lambda at: F.substring(F.lower("t").cast("binary"), at, F.lit(WINDOW)))
    rows = drawn.select("lang", "h", F.array_distinct(cut).alias("cut")).orderBy("h", "lang").limit(2 * per_language * len(names)).collect()
    taken: dict[str, int] = {}
    x, y = [], []
    for r in rows:
        if taken.get(r["lang"], 0) < per_language:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            for raw in r["cut"]:
                if raw:
                    x.append(windows(bytes(raw)[:WINDOW]))
                    y.append(names.index(r["lang"]))
    if not x:
        return None
    return names, tables(train(np.concatenate(x), np.array(y), len(names)))


def lettered(text: str) -> Column:
    """The bytes that are scored: the text in lower case; null for texts without letters."""
    return F.when(F.col(text).rlike(r"\p{L}"), F.lower(text_or_empty(text)).cast("binary"))


def scores(raws: list[bytes | None], model: tuple[list[str], dict] | None) -> tuple[list[str], list[float]]:
    """Language and score of each text: the softmax of the mean log-probabilities of its windows, weighted by their bytes; und and 0 for None or without a model."""
    langs, sure = ["und"] * len(raws), [0.0] * len(raws)
    at = 0
    while model is not None and at < len(raws):
        names, t = model
        part, size = [], 0
        while at < len(raws) and size < 4_000_000:
            if raws[at]:
                part.append(at)
                size += len(raws[at])
            at += 1
        if not part:
            continue
        xs = [windows(raws[i]) for i in part]
        logs = log_probabilities(np.concatenate(xs), t)
        weight = np.concatenate([np.minimum(WINDOW, len(raws[i]) - WINDOW * np.arange(len(x))) for i, x in zip(part, xs, strict=True)]).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in xs])[:-1]])
        mean = np.add.reduceat(logs * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        prob = np.exp(mean - mean.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        for i, best, p in zip(part, prob.argmax(1), prob.max(1), strict=True):
            langs[i], sure[i] = names[best], float(p)
    return langs, sure


def identify(docs: DataFrame, model: tuple[list[str], dict] | None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    ``lang_pred`` is ``und`` with score 0 for null texts, texts without letters, and all texts when there is no model; else one of
    the model's languages (see ``scores``). Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("_id"), held_out(id).alias("_held"), lettered(text).alias("_raw"))

    def run(batches):
        for batch in slices(batches):
            langs, sure = scores(batch.column(2).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs), pa.array(sure)], [id, "held_out", "lang_pred", "score"])

    return small_batches(rows).mapInArrow(run, f"`{id}` {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> DataFrame:
    """``fit`` on the rows that are not held out, then ``identify`` every row."""
    return identify(docs, fit(docs, text, lang, id), text, id)


#: A document stays in the pipeline when it has letters and its language is at least so sure.
SURE = 0.3


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", sure: float = SURE) -> DataFrame:
    """The rows of ``docs`` whose language the network can tell, with all their columns and nothing else.

    Whole rows pass through the scoring (no join by id), so repeated ids and clashing column names do no harm."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, text, lang, id))
    marked = docs.withColumn("__raw__", lettered(text))

    def run(batches):
        for batch in slices(batches):
            _, sure_ = scores(batch.column(batch.num_columns - 1).to_pylist(), sent.value)
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            yield rest.filter(pa.array([s >= sure and s > 0 for s in sure_], pa.bool_()))

    return small_batches(marked).mapInArrow(run, docs.schema)
