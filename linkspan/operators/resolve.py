"""Settling mentions on concepts: exact normal forms, typed gates, votes of sources, and authorities where votes do not decide.

A batch of mentions is one frame and every step one plan over it. Nothing is truncated: all concepts with an atom equal to the
mention are candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import ACCEPTED_TYPES, plainly_no_drug
from ..functions.text import clean_drug, in_parentheses, normalize, split_names
from ..session import bounded

RESOLVED, CONFLICT, NOT_A_CONDITION, UNRESOLVED, LOOKUP_FAILED = "RESOLVED", "CONFLICT_DETECTED", "NOT_A_CONDITION", "UNRESOLVED", "LOOKUP_FAILED"
REGISTRY = "CLINICALTRIALS.GOV"
POPULATION, GUIDANCE, MULTINAME = "RESOLVED_AS_TRIAL_POPULATION", "RESOLVED_BY_GUIDANCE", "RESOLVED_FROM_MULTINAME"


@dataclass(frozen=True)
class Rules:
    """What decides: accepted types, sources needed, sources that speak for lay usage and the narrower of them, mentions a registry needs."""

    accepted_types: tuple[str, ...] = ACCEPTED_TYPES
    min_support: int = 2
    consumer: tuple[str, ...] = ("MEDLINEPLUS", "CHV")
    narrower: tuple[str, ...] = ("MEDLINEPLUS",)
    min_registry: int = 2
    #: Emit UNRESOLVED instead of NOT_A_CONDITION where nothing has the name at all.
    unresolved_when_absent: bool = False


def candidates(mentions: DataFrame, atoms: DataFrame, concepts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """query_id, cui, name, support (distinct sources whose atom is the mention), n_support, typed, consumer, narrower.

    Atoms are cut to the mentions' normal forms before they are grouped."""
    asked = mentions.select("query_id", normalize(F.col("query")).alias("norm")).where(F.col("norm") != "")
    named = atoms.select("cui", "sab", normalize(F.col("str")).alias("norm")).join(asked.select("norm").distinct(), "norm", "left_semi")
    votes = named.groupBy("norm", "cui").agg(F.sort_array(F.collect_set("sab")).alias("support"))
    typed = F.coalesce(F.arrays_overlap("semantic_types", F.array(*map(F.lit, rules.accepted_types))), F.lit(False))
    has = lambda names: F.coalesce(F.arrays_overlap("support", F.array(*map(F.lit, names))), F.lit(False))
    return asked.join(votes, "norm").join(concepts.select("cui", "name", "semantic_types", "atom_count"), "cui", "left").select(
        "query_id", "cui", "name", "semantic_types", "atom_count", "support", F.size("support").alias("n_support"), typed.alias("typed"),
        has(rules.consumer).alias("consumer"), has(rules.narrower).alias("narrower"),
    )


def decide(mentions: DataFrame, found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per mention: query_id, norm, status (FALLBACK where the ladder goes on), cui, label, support, contest, authority.

    Of several supported candidates the one that alone has a consumer source is meant; else the one that alone has the narrower."""
    standing = F.col("typed") & (F.col("n_support") >= rules.min_support)
    one = F.struct("cui", "name", "support", "n_support", "semantic_types", "atom_count")
    # The order of a contest: most sources first, then the concept.
    entry = F.struct((-F.col("n_support")).alias("rank"), F.col("cui").alias("by"), "name", "n_support", "support")
    per = found.groupBy("query_id").agg(
        F.count("*").alias("n_found"), F.count_if("typed").alias("n_typed"), F.count_if(standing).alias("n_standing"),
        F.count_if(standing & F.col("consumer")).alias("n_consumer"), F.count_if(standing & F.col("consumer") & F.col("narrower")).alias("n_narrower"),
        F.min(F.when(standing, one)).alias("any"), F.min(F.when(standing & F.col("consumer"), one)).alias("by_consumer"),
        F.min(F.when(standing & F.col("consumer") & F.col("narrower"), one)).alias("by_narrower"),
        F.sort_array(F.collect_list(F.when(standing, entry))).alias("contest"),
    )
    rows = mentions.select("query_id", "query", normalize(F.col("query")).alias("norm")).join(per, "query_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    chosen = F.when(n("n_standing") == 1, F.col("any")).when((n("n_standing") > 1) & (n("n_consumer") == 1), F.col("by_consumer")).when((n("n_standing") > 1) & (n("n_consumer") > 1) & (n("n_narrower") == 1), F.col("by_narrower"))
    status = (
        F.when(F.col("norm") == "", UNRESOLVED)
        .when(n("n_found") == 0, "FALLBACK")
        .when(n("n_typed") == 0, NOT_A_CONDITION)
        .when(n("n_standing") == 0, "FALLBACK")
        .when(F.col("pick").isNotNull(), RESOLVED)
        .otherwise(CONFLICT)
    )
    authority = F.when(n("n_standing") > 1, F.when(n("n_consumer") == 1, "consumer").when((n("n_consumer") > 1) & (n("n_narrower") == 1), "narrower"))
    rows = rows.withColumn("pick", chosen).withColumn("status", status)
    return rows.select("query_id", "query", "norm", "status", F.col("pick.cui").alias("cui"), F.col("pick.name").alias("label"), F.col("pick.semantic_types").alias("semantic_types"), F.col("pick.support").alias("sources"), F.col("pick.atom_count").alias("atom_count"), F.when(n("n_standing") > 1, F.col("contest")).alias("contest"), authority.alias("authority"))


def registry_population(norms: DataFrame, trials: DataFrame, least: int) -> DataFrame:
    """Norm, label (least spelling), n_mentions of normal forms that at least so many condition mentions of trials equal."""
    said = trials.select(F.explode("conditions").alias("spelling")).select("spelling", normalize(F.col("spelling")).alias("norm"))
    return said.join(norms.select("norm").distinct(), "norm", "left_semi").groupBy("norm").agg(F.min("spelling").alias("population"), F.count("*").alias("n_mentions")).where(F.col("n_mentions") >= least)


def resolve(mentions: DataFrame, atoms: DataFrame, concepts: DataFrame, trials: DataFrame | None = None, guidance: DataFrame | None = None, hierarchy_names: DataFrame | None = None, unchecked: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """One row per mention (query_id, query) with a status that is never null.

    ``trials`` (conditions) is the registry, ``guidance`` (name, label, citation) the cited exceptions, ``hierarchy_names`` (norm,
    mondo_id, _ord) the names whose first id is attached, ``unchecked`` (norm) mentions whose lookup failed: they are
    LOOKUP_FAILED, never "not a condition". Only mentions that the votes leave open reach the ladder below.
    """
    settled = decide(mentions, candidates(mentions, atoms, concepts, rules), rules)
    open_ = settled.where(F.col("status") == "FALLBACK").select("query_id", "query", "norm")

    units = open_.select("query_id", F.explode(split_names(F.col("query"))).alias("unit")).withColumn("unit_id", F.struct("query_id", "unit"))
    asked = units.select(F.col("unit_id").alias("query_id"), F.col("unit").alias("query")).distinct()
    each = decide(asked, candidates(asked, atoms, concepts, rules), rules).where(F.col("status") == RESOLVED)
    several = each.groupBy(F.col("query_id.query_id").alias("query_id")).agg(F.count_distinct("cui").alias("n_units"), F.min(F.struct("cui", "label", "semantic_types", "sources")).alias("unit"), F.sort_array(F.collect_set("query")).alias("multiname_units"))

    rows = settled.join(several, "query_id", "left")
    population = registry_population(open_, trials, rules.min_registry) if trials is not None else None
    rows = rows.join(population, "norm", "left") if population is not None else rows.withColumns({"population": F.lit(None).cast("string"), "n_mentions": F.lit(None).cast("long")})
    if guidance is not None:
        cited = guidance.select(normalize(F.col("name")).alias("norm"), F.col("label").alias("cited"), "citation").dropDuplicates(["norm"])
        rows = rows.join(bounded(cited), "norm", "left")
    else:
        rows = rows.withColumns({"cited": F.lit(None).cast("string"), "citation": F.lit(None).cast("string")})
    failed = F.lit(False)
    if unchecked is not None:
        rows = rows.join(unchecked.select("norm", F.lit(True).alias("unchecked")).distinct(), "norm", "left")
        failed = F.coalesce("unchecked", F.lit(False))
    absent = UNRESOLVED if rules.unresolved_when_absent else NOT_A_CONDITION
    many = F.coalesce("n_units", F.lit(0))
    ladder = F.when(F.col("n_mentions").isNotNull(), POPULATION).when(many == 1, MULTINAME).when(many > 1, CONFLICT).when(F.col("cited").isNotNull(), GUIDANCE).otherwise(absent)
    status = F.when(failed & (F.col("norm") != ""), LOOKUP_FAILED).when(F.col("status") == "FALLBACK", ladder).otherwise(F.col("status"))
    rows = rows.withColumn("final", status)
    by_unit = F.col("final") == MULTINAME
    out = rows.select(
        "query_id", "query", F.col("norm").alias("normalized"), F.col("final").alias("status"),
        F.when(F.col("final") == RESOLVED, F.col("cui")).when(by_unit, F.col("unit.cui")).alias("cui"),
        F.when(F.col("final") == RESOLVED, F.col("label")).when(by_unit, F.col("unit.label")).when(F.col("final") == POPULATION, F.col("population")).when(F.col("final") == GUIDANCE, F.col("cited")).alias("label"),
        F.when(F.col("final") == RESOLVED, F.col("semantic_types")).when(by_unit, F.col("unit.semantic_types")).alias("semantic_types"),
        F.when(F.col("final") == RESOLVED, F.col("sources")).when(by_unit, F.col("unit.sources")).when(F.col("final") == POPULATION, F.array(F.lit(REGISTRY))).alias("sources"),
        F.when(F.col("final") == POPULATION, F.col("n_mentions")).otherwise(F.col("atom_count")).alias("atom_count"), "contest", "authority", F.when(by_unit, F.col("multiname_units")).alias("multiname_units"), F.when(F.col("final") == GUIDANCE, F.col("citation")).alias("citation"),
    )
    if hierarchy_names is not None:
        first = hierarchy_names.groupBy(F.col("norm").alias("normalized")).agg(F.min_by("mondo_id", "_ord").alias("mondo_id"))
        out = out.join(first, "normalized", "left").withColumn("hierarchy_available", F.col("mondo_id").isNotNull())
    return out


def near_misses(mentions: DataFrame, found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """query_id, source, reason, candidate for everything that was seen and not chosen."""
    norm = normalize(F.col("query"))
    empty = mentions.where(norm == "").select("query_id", F.lit("QUERY").alias("source"), F.lit("EMPTY_AFTER_NORMALIZATION").alias("reason"), F.lit(None).cast("string").alias("candidate"))
    reason = F.when(F.col("semantic_types").isNull() | (F.size("semantic_types") == 0), "NO_SEMANTIC_TYPE").when(~F.col("typed"), "TYPE_REJECTED").when(F.col("n_support") < rules.min_support, "SINGLE_VOCABULARY_ONLY")
    rejected = found.select("query_id", F.lit("CONCEPT").alias("source"), reason.alias("reason"), F.col("cui").alias("candidate")).where(F.col("reason").isNotNull())
    chosen = decide(mentions, found, rules).where(F.col("authority").isNotNull()).select("query_id", F.col("cui").alias("chosen"))
    standing = found.where(F.col("typed") & (F.col("n_support") >= rules.min_support))
    lost = standing.join(chosen, "query_id").where(F.col("cui") != F.col("chosen")).select("query_id", F.lit("CONTEST").alias("source"), F.lit("NOT_THE_LAY_MEANING").alias("reason"), F.col("cui").alias("candidate"))
    return empty.unionByName(rejected).unionByName(lost)


def cached_resolve(mentions: DataFrame, cache: DataFrame, run) -> tuple[DataFrame, DataFrame]:
    """(all rows, rows to add to the cache). Known normal forms come from the cache with the caller's own spelling; the rest is run.

    Failures are never cached."""
    asked = mentions.withColumn("normalized", normalize(F.col("query")))
    known = asked.join(cache.drop("query_id", "query"), "normalized")
    fresh = run(asked.join(cache.select("normalized").distinct(), "normalized", "left_anti").drop("normalized"))
    return known.unionByName(fresh, allowMissingColumns=True), fresh.where(F.col("status") != LOOKUP_FAILED)


#: Shorter names and texts are near nothing.
LEAST_NEAR = 4


def near_names(texts: DataFrame, names: DataFrame, similar: float) -> DataFrame:
    """t, k, id, far: every pair of a text (t) and a name (k, id) of four characters or more whose edit distance is at most 1 - ``similar`` of the longer one's length, rounded.

    With at most ``e`` edits one of any ``e`` + 1 pieces of a name stands in the text as it is, at most ``e`` places off. Names and
    texts meet by such pieces, so no pair is missed and none is formed that shares no piece.
    """
    most = lambda c: F.floor(((1 - similar) * F.length(c) + 0.5) / similar + 1e-9).cast("int")  # noqa: E731  edits that a name of this length allows
    texts, named = texts.where(F.length("t") >= LEAST_NEAR), names.where(F.length("k") >= LEAST_NEAR)
    named = named.withColumn("e", most("k")).where("e > 0").withColumn("n", F.length("k"))
    start = lambda i: F.floor(i * F.col("n") / (F.col("e") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("e")), lambda i: F.struct(start(i).alias("at"), F.substring("k", start(i) + 1, start(i + 1) - start(i)).alias("piece")))
    named = named.select("k", "id", "e", "n", F.explode(pieces).alias("p")).select("k", "id", "e", "n", "p.*").where("piece <> ''")
    # Pieces of any name are of a few lengths, near similar / (1 - similar).
    sizes = sorted(r["s"] for r in named.select(F.length("piece").alias("s")).distinct().collect())
    if not sizes:
        return texts.limit(0).select("t", F.lit("").alias("k"), F.lit(None).cast(names.schema["id"].dataType).alias("id"), F.lit(0).alias("far"))
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.length("t") - s), lambda i: F.struct(i.alias("there"), F.substring("t", i + 1, F.lit(s)).alias("piece")))
    every = F.flatten(F.array(*[F.when(F.length("t") >= s, cut(s)).otherwise(F.array().cast("array<struct<there:int,piece:string>>")) for s in sizes]))
    asked = texts.select("t", F.explode(every).alias("p")).select("t", "p.*")
    met = asked.join(named, "piece").where((F.abs(F.col("there") - F.col("at")) <= F.col("e")) & (F.abs(F.length("t") - F.col("n")) <= F.col("e"))).select("t", "k", "id").distinct()
    return met.withColumn("far", F.levenshtein("t", "k")).where(F.col("far") <= F.floor((1 - similar) * F.greatest(F.length("t"), F.length("k")) + 0.5))


def resolve_items(strings: DataFrame, names: DataFrame, ingredients: DataFrame, similar: float = 0.85) -> DataFrame:
    """Item strings (item) on ids: item, status, match_step, rxcui, key_names, key_ids.

    ``names`` (name, rxcui), ``ingredients`` (rxcui, ingredient_rxcui, ingredient). Steps: the string itself, the cleaned string, a name
    near the cleaned string, the text in parentheses unless that plainly names no drug, a name near that. The near steps take the
    nearest name by edit distance (``near_names``); of equally near ones the least.
    An id without ingredients stands for itself under the string.
    """
    low = lambda c: F.lower(F.trim(c))
    keys = names.groupBy(low(F.col("name")).alias("k")).agg(F.min("rxcui").alias("id"))
    inner = in_parentheses(F.col("item"))
    inner = F.when(~F.coalesce(plainly_no_drug(inner), F.lit(False)), low(inner))
    rows = strings.select("item").distinct().withColumn("clean", low(clean_drug(F.col("item")))).withColumn("inner", inner).withColumn("raw", low(F.col("item")))
    none = F.coalesce(F.trim("item"), F.lit("")) == ""
    no_drug = none | F.coalesce(plainly_no_drug(F.col("item")), F.lit(False))
    for step in ("raw", "clean", "inner"):
        rows = rows.join(keys.select(F.col("k").alias(step), F.col("id").alias(f"{step}_id")), step, "left")
    open_ = rows.where(~no_drug & F.col("raw_id").isNull() & F.col("clean_id").isNull())
    texts = open_.select(F.explode(F.array("clean", "inner")).alias("t")).distinct()
    close = near_names(texts, keys, similar).groupBy("t").agg(F.min(F.struct("far", "k", "id"))["id"].alias("near"))
    for step in ("clean", "inner"):
        rows = rows.join(close.select(F.col("t").alias(step), F.col("near").alias(f"{step}_near")), step, "left")
    inner_id = F.coalesce("inner_id", "inner_near")
    id_ = F.when(~no_drug, F.coalesce("raw_id", "clean_id", "clean_near", inner_id))
    step = F.when(no_drug, None).when(F.col("raw_id").isNotNull(), "exact_raw").when(F.col("clean_id").isNotNull(), "exact_clean").when(F.col("clean_near").isNotNull(), "approximate").when(inner_id.isNotNull(), "parenthetical")
    rows = rows.select("item", F.when(no_drug, "UNRESOLVED_NOT_A_DRUG").when(id_.isNull(), "UNRESOLVED_NOT_IN_RXNORM").otherwise(RESOLVED).alias("status"), step.alias("match_step"), id_.alias("rxcui"))
    parts = ingredients.groupBy("rxcui").agg(F.array_sort(F.collect_set(F.struct(F.lower("ingredient").alias("k"), "ingredient", "ingredient_rxcui"))).alias("p"))
    rows = rows.join(parts, "rxcui", "left")
    join = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "/")
    return rows.select("item", "status", "match_step", "rxcui", F.coalesce(join("ingredient"), F.when(F.col("rxcui").isNotNull(), F.trim("item"))).alias("key_names"), F.coalesce(join("ingredient_rxcui"), "rxcui").alias("key_ids"))
