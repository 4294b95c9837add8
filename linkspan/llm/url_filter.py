"""URL filters (5): rules first, then a path-template tree for each host.

Step by step the segments of the paths of a host become branches; segments that all paths of a node have in common are one step. A segment with enough pages stays a literal branch, however
many pages its node has, all others become the wildcard ``*``; literal branches whose labelled block rates do not differ
significantly are merged into one. A second tree is grown in the same way over the paths of all hosts together, so that what a
path says elsewhere is known to hosts that have few labels or none; both trees are grown in the same steps. A template is judged by its labelled purity, smoothed towards a
mean of what its host and what its path on all hosts say (each counting by its labels, up to a bound, and the rate of all pages as a
few more). Labels are the verdicts of rules where a rule fits and, without one, words of host names that tell a bad host, unless a
column of labels is named. Only ids, hosts, segments and labels travel; the pages' contents are never read. Counts are summed
map-side, so a host with a third of all pages is one row per segment and task.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, small, written


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str


#: A literal branch needs so many pages, whatever its node has; branches differ from this z value on.
SUPPORT, DIFFER = 20, 1.96
#: Labelled pages that a prior counts for, those that a host or a path on all hosts counts for in it at most, and the purity from which a template is blocked.
PRIOR, MOST, BLOCK_FROM = 5.0, 50.0, 0.5
#: Words of host names, labels of bad hosts by hand.
TELLING = ("ads", "adult", "bets", "betting", "casino", "escort", "gambling", "malware", "phishing", "pills", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")
#: Finished steps that are kept apart before they are written as one; rows of a task of a step, in the mean.
PIECES, ROWS = 16, 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to ``?``, ``#`` or the end. Empty without ``://`` or url."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null. A rule fits its host and all subdomains of it where the path starts with its path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def alike(branch: DataFrame, node: list[str]) -> DataFrame:
    """(node, known, blocked, part, same): which branches of a node are merged, told by their counts.

    Neighbours in the order of block rates that do not differ form a part; ``same`` is false where the part as a whole is not of one
    rate (chi-square), so that a chain of small steps does not join clean branches with bad ones. Of unlabelled branches nothing is
    known, so none is merged. A window is over the different counts of a node, which are far fewer than its branches.
    """
    order = W.partitionBy(*node).orderBy(F.col("known") == 0, F.coalesce(F.try_divide("blocked", "known"), F.lit(0.5)), "known")
    n1, n0, b1, b0 = F.col("known"), F.lag("known").over(order), F.col("blocked"), F.lag("blocked").over(order)
    pooled = (b1 + b0 + 1) / (n1 + n0 + 2)
    z = F.abs((b1 + 0.5) / (n1 + 1) - (b0 + 0.5) / (n0 + 1)) / F.sqrt(pooled * (1 - pooled) * (1 / (n1 + 1) + 1 / (n0 + 1)))
    new = F.coalesce(((z >= DIFFER) | ((n1 == 0) != (n0 == 0))).cast("int"), F.lit(1))
    counts = branch.groupBy(*node, "known", "blocked").agg(F.count("*").alias("times"))
    counts = counts.withColumn("new", new).withColumn("part", F.sum("new").over(order)).drop("new")
    k, b, square = F.sum(n1 * F.col("times")), F.sum(b1 * F.col("times")), F.sum(F.col("times") * b1 * b1 / F.nullif(n1, F.lit(0)))
    free, rate = F.sum("times") - 1, b / F.nullif(k, F.lit(0))
    uneven = F.coalesce((square - b * rate) / F.nullif(rate * (1 - rate), F.lit(0.0)), F.lit(0.0))
    parts = counts.groupBy(*node, "part").agg(((k > 0) & (uneven <= free + DIFFER * F.sqrt(2 * free))).alias("same"))
    return checkpoint(counts.join(parts, [*node, "part"]).select(*node, "known", "blocked", "part", "same"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than its rows need, so that steps over few rows are few tasks."""
    return df.coalesce(max(1, math.ceil(rows / ROWS)))


def templates(pages: DataFrame, trees: tuple[str, ...] = ("host",)) -> DataFrame:
    """pages (rid, segments, y: 1 block, 0 allow, null unknown, and a column for each tree: the name of its root) to (rid, tree, template).

    A node with enough pages that go on is looked at again: what the paths that go on all have next is taken at once (the common
    prefix of the least and the greatest of them), and where they differ they branch. Below nodes with fewer, every further segment
    is a wildcard, which is written at once. So steps follow the number of branchings on a path, not its length. Steps end in
    written tables: a checkpoint hands on what is known of its columns, which would grow with each step."""
    rows = pages.select("rid", "segments", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("tree"), F.coalesce(F.col(t), F.lit("")).alias("root")) for i, t in enumerate(trees)])).alias("t"))
    at = written(rows.select("rid", "t.tree", "t.root", "segments", "y", F.lit(0).alias("level"), F.lit("").alias("template")))
    node, done, total = ["tree", "root", "template"], [], 0
    ends = lambda df, n: _few(df.select("rid", "tree", F.concat("template", F.repeat(F.lit("/*"), F.greatest(F.size("segments") - F.col("level"), F.lit(0)))).alias("template")), n)
    n_rows = at.count()
    while True:
        rest = at.withColumn("rest", F.slice("segments", F.col("level") + 1, F.greatest(F.size("segments"), F.lit(1))))
        on = rest.where(F.size("rest") > 0).groupBy(*node).agg(F.count("*").alias("n"), F.min("rest").alias("a"), F.max("rest").alias("b")).where(F.col("n") >= SUPPORT)
        # Places where the two differ; with none the shorter one is the common part.
        same = F.aggregate(F.arrays_zip("a", "b"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda x, p: F.when(x["on"] & p["a"].eqNullSafe(p["b"]), F.struct((x["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(x["n"].alias("n"), F.lit(False).alias("on"))), lambda x: x["n"])
        on = checkpoint(on.select(*node, "n", F.slice("a", F.lit(1), same).alias("chain")))
        facts = on.agg(F.count("*").alias("nodes"), F.sum("n").alias("pages"), F.count_if(F.size("chain") == 0).alias("forks")).first()
        rest = rest.join(small(on.select(*node, "chain"), facts["nodes"]), node, "left")
        goes = F.col("chain").isNotNull() & (F.size("rest") > 0)
        done.append(ends(rest.where(~goes), n_rows - (facts["pages"] or 0)))
        if len(done) == PIECES:
            done = [_few(checkpoint(reduce(DataFrame.unionByName, done)), total + n_rows)]
        total, n_rows = total + n_rows - (facts["pages"] or 0), facts["pages"] or 0
        if not n_rows:
            return checkpoint(_few(reduce(DataFrame.unionByName, done), total))
        rest = _few(rest.where(goes), n_rows)
        chained = rest.where(F.size("chain") > 0).select("rid", "tree", "root", "segments", "y", (F.col("level") + F.size("chain")).alias("level"), F.concat("template", F.lit("/"), F.array_join("chain", "/")).alias("template"))
        if not facts["forks"]:
            at = written(chained)
            continue
        forks = rest.where(F.size("chain") == 0).withColumn("segment", F.get("rest", F.lit(0))).drop("rest", "chain")
        counts = checkpoint(forks.groupBy(*node, "segment").agg(F.count("*").alias("n"), F.count("y").alias("known"), F.coalesce(F.sum("y"), F.lit(0)).alias("blocked")).where(F.col("n") >= SUPPORT))
        literal = counts.join(small(alike(counts, node)), [*node, "known", "blocked"]).withColumn("own", F.when(~F.col("same"), F.col("segment")))
        group = [*node, "part", "own"]
        first, last, size = F.min("segment"), F.max("segment"), F.count("*")
        # A name of bounded length; the least segment of a group is no other group's.
        names = literal.groupBy(*group).agg(F.when(size == 1, first).when(size == 2, F.concat_ws("|", first, last)).otherwise(F.concat(first, F.lit("|"), last, F.lit("|+"), size - 2)).alias("branch"))
        literal = literal.withColumn("own", F.coalesce("own", F.lit(""))).join(small(checkpoint(names.fillna("", "own"))), group).select(*node, "segment", "branch")
        forked = forks.join(small(checkpoint(literal)), [*node, "segment"], "left")
        forked = forked.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("branch", F.lit("*")))).withColumn("level", F.col("level") + 1)
        at = written(_few(chained.unionByName(forked.select(*chained.columns)), n_rows))


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", id: str = "page_id", label: str | None = None, block_from: float = BLOCK_FROM, telling: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, template, purity.

    ``rule`` is null where no rule fits; the verdict is then the template's. ``label`` names a column of known verdicts (1 block, 0
    allow) to learn from instead of the rules' and of ``telling``, words that label a page as one to block where the name of its host
    has one of them and no rule fits. Null and malformed urls have an empty host and path and share one template. Repeated rows and
    ties count as often as they are there. Other columns are ignored; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path"), *([F.col(label).cast("int").alias("y")] if label else []))
    rows = rows.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    if not label:
        told = F.when(F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, telling))), 1) if telling else F.lit(None).cast("int")
        rows = rows.withColumn("y", F.when(F.col("fit").isNotNull(), (F.col("fit.verdict") == "block").cast("int")).otherwise(told))
    rows = rows.withColumn("segments", F.filter(F.split("path", "/"), lambda x: x != ""))
    rows = checkpoint(rows.select(F.monotonically_increasing_id().alias("rid"), "id", "host", "path", "fit.rule", "fit.verdict", "y", "segments"))
    grown = templates(rows.withColumn("all", F.lit("")), ("host", "all"))
    of = lambda tree, name: F.max(F.when(F.col("tree") == tree, F.col("template"))).alias(name)
    rows = checkpoint(rows.drop("segments").join(grown.groupBy("rid").agg(of(0, "template"), of(1, "anywhere")), "rid").drop("rid"))
    known = lambda k, b: [F.count("y").alias(k), F.coalesce(F.sum("y"), F.lit(0)).alias(b)]
    whole = rows.agg(*known("k", "b")).first()
    base = (whole["b"] + 1) / (whole["k"] + 2)
    by_host = checkpoint(rows.groupBy("host").agg(*known("hk", "hb")))
    by_path = checkpoint(rows.groupBy("anywhere").agg(*known("pk", "pb")))
    by_template = checkpoint(rows.groupBy("host", "template").agg(*known("known", "blocked")))
    kinds = checkpoint(rows.groupBy("host", "template", "anywhere").agg(F.count("*").alias("n")).drop("n"))
    facts = kinds.join(small(by_template), ["host", "template"]).join(small(by_host), "host").join(small(by_path), "anywhere")
    # A rate counts by its labels, MOST at most.
    part = lambda k, b: F.least(k, F.lit(MOST)) * F.coalesce(b / F.nullif(k, F.lit(0)), F.lit(0.0))
    hk, hb, pk, pb = map(F.col, ("hk", "hb", "pk", "pb"))
    prior = (part(hk, hb) + part(pk, pb) + PRIOR * base) / (F.least(hk, F.lit(MOST)) + F.least(pk, F.lit(MOST)) + PRIOR)
    purity = F.round((F.col("blocked") + PRIOR * prior) / (F.col("known") + PRIOR), 6)
    out = rows.join(small(checkpoint(facts.select("host", "template", "anywhere", purity.alias("purity")))), ["host", "template", "anywhere"], "left")
    judged = F.coalesce("verdict", F.when(F.col("purity") >= block_from, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id), "host", "path", "rule", judged.alias("verdict"), "template", "purity")
