"""Matches of a pattern with their places and the text around them, by JVM-side expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points before and after a match that are given with it; matches per chunk of the running sum.
NEAR, CHUNK = 48, 256
FOUND = "array<struct<start:int,match:string,before:string,after:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def matches(text: Column, pattern: str, least: int = 5) -> Column:
    """array<struct<start, match, before, after>> of the leftmost non-overlapping matches; start counts code points from 0.

    ``before`` and ``after`` are up to NEAR code points on either side, whatever other matches lie in them. Two extractions give the
    text between matches and the matches; their lengths add up to places (in chunks, so that a text with very many matches is not
    summed quadratically), and the text around a match is put together from the pieces next to it. A match has at least ``least``
    code points. The pattern must not contain groups that capture; in it ``\\G`` is the end of the last match.
    """
    whole = rf"(?s)\G(.*?)({pattern})"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(whole), 1).alias("g"), F.regexp_extract_all(text, F.lit(whole), 2).alias("m"))
    return let(pairs, lambda p: _placed(text, p, math.ceil(NEAR / least)).cast(FOUND))


def _placed(text: Column, pairs: Column, k: int) -> Column:
    def length(p: Column) -> Column:
        return F.length(p["g"]) + F.length(p["m"])

    def upto(part: Column, base: Column) -> Column:
        return F.aggregate(part, base, lambda a, p: a + length(p))

    def run(chunk: Column, base: Column) -> Column:
        """Starts of the matches of a chunk."""
        def step(a: Column, p: Column) -> Column:
            return F.struct((a["at"] + length(p)).alias("at"), F.concat(a["out"], F.array(a["at"] + F.length(p["g"]))).alias("out"))

        return F.aggregate(chunk, F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])

    chunks = F.sequence(F.lit(0), F.ceil(F.size(pairs) / CHUNK).cast("int"))
    bases = lambda c: upto(F.slice(pairs, F.greatest(c - 1, F.lit(0)) * CHUNK + 1, F.when(c > 0, CHUNK).otherwise(0)), F.lit(0))
    sums = F.aggregate(F.transform(chunks, bases), F.array().cast("array<int>"), lambda out, n: F.concat(out, F.array(n + F.coalesce(F.get(out, F.size(out) - 1), F.lit(0)))))
    starts = let(sums, lambda b: F.flatten(F.transform(chunks, lambda c: run(F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)), F.get(b, c)))))
    rest = F.substring(text, upto(pairs, F.lit(1)), F.lit(NEAR))
    join = lambda parts, f: F.array_join(F.transform(parts, lambda p: F.concat(f(p["g"], F.lit(NEAR)), f(p["m"], F.lit(NEAR)))), "")

    def one(p: Column, i: Column, x: Column) -> Column:
        earlier = F.slice(pairs, F.greatest(i - k, F.lit(0)) + 1, F.least(i, F.lit(k)))
        before = F.right(F.concat(join(earlier, F.right), F.right(p["g"], F.lit(NEAR))), F.lit(NEAR))
        after = F.left(F.concat(join(F.slice(pairs, i + 2, F.lit(k)), F.left), F.when(i + k + 1 >= F.size(pairs), x["rest"]).otherwise("")), F.lit(NEAR))
        return F.struct(F.get(x["starts"], i).alias("start"), p["m"].alias("match"), before.alias("before"), after.alias("after"))

    return let(F.struct(starts.alias("starts"), rest.alias("rest")), lambda x: F.transform(pairs, lambda p, i: one(p, i, x)))
