"""What trials measure: flattened trials, outcome streams, co-occurrence, usage and roll-ups.

trials: nct_id, title, status, phases, start_date, sponsor, conditions, interventions (array<struct<type, name>>), primary_outcomes,
secondary_outcomes, other_outcomes (array<struct<measure>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import matching_outcomes, phrase_in, scaffolding, trial_id, uses_instrument
from ..functions.text import aliases, clean_measure, flat_spaces, trimmed
from ..session import bounded, checkpoint
from .dedup import first_per_key
from .link import therapies
from .meet import FEW, containing

NOT_IN_VOCABULARY = "UNRESOLVED_NOT_IN_RXNORM"


def unique_trials(pages: DataFrame) -> DataFrame:
    """Trials of all pages, the first page that has one wins; malformed ids go."""
    return first_per_key(pages.where(trial_id(F.col("nct_id"))), ["nct_id"], ["page", "pos"])


def naming(trials: DataFrame, instruments: DataFrame, *kinds: str) -> DataFrame:
    """Trials once for each instrument (column ``instrument``) that an outcome of these kinds contains, case aside; ids of trials are unique.

    Few instruments are broadcast; many meet the distinct measures by ``meet.containing``."""
    names = instruments.select("instrument").distinct()
    said = F.concat(*[F.coalesce(F.col(f"{k}_outcomes"), F.array().cast("array<struct<measure:string>>")) for k in kinds])
    few = bounded(names, FEW)
    if few is not names:
        return trials.join(few, F.exists(said, lambda o: F.coalesce(F.lower(o["measure"]).contains(F.lower(F.col("instrument"))), F.lit(False))))
    measures = trials.select("nct_id", F.explode(said).alias("o")).select("nct_id", F.lower("o.measure").alias("key")).distinct()
    low = names.select("instrument", F.lower("instrument").alias("term"))
    met = containing(measures.select("key").distinct(), "key", "key", low)
    return trials.join(measures.join(met, "key").join(low, "term").select("nct_id", "instrument").distinct(), "nct_id")


def using(trials: DataFrame, instruments: DataFrame) -> DataFrame:
    """One row per instrument and trial that has it in a primary or secondary outcome, with the measures verbatim and as_primary."""
    n = F.col("instrument")
    hit = naming(trials, instruments, "primary", "secondary")
    return hit.select("instrument", "nct_id", "title", "status", "phases", "start_date", "sponsor", "conditions", F.transform("interventions", lambda i: i["name"]).alias("interventions"), matching_outcomes(F.col("primary_outcomes"), n).alias("matched_primary"), matching_outcomes(F.col("secondary_outcomes"), n).alias("matched_secondary")).withColumn("as_primary", F.size("matched_primary") > 0)


def top_names(rows: DataFrame, keys: list[str], name: str, first: str, top: int = 3, sep: str = "|") -> DataFrame:
    """Keys, top: the ``top`` most frequent names of each key as ``name(n)``, joined; equal counts by the least ``first``."""
    by = rows.groupBy(*keys, name).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    best = by.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first"))).where(F.col("r") <= top)
    told = F.struct("r", F.concat(F.col(name), F.lit("("), F.col("n"), F.lit(")")).alias("s"))
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(told)), lambda x: x["s"]), sep).alias("top"))


def usage(instruments: DataFrame, used: DataFrame, top: int = 3) -> DataFrame:
    """Instrument, trials, as_primary, secondary_only, top_sponsors (``name(n)`` between bars, nameless ones aside), status; never used ones stay with 0."""
    per = used.groupBy("instrument").agg(F.count_distinct("nct_id").alias("trials"), F.count_if("as_primary").alias("as_primary"), F.count_if(~F.col("as_primary") & (F.size("matched_secondary") > 0)).alias("secondary_only"))
    best = top_names(used.where(F.coalesce("sponsor", F.lit("")) != ""), ["instrument"], "sponsor", "nct_id", top).withColumnRenamed("top", "top_sponsors")
    out = instruments.select("instrument").distinct().join(per, "instrument", "left").join(best, "instrument", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("instrument", n("trials"), n("as_primary"), n("secondary_only"), F.coalesce("top_sponsors", F.lit("")).alias("top_sponsors"), F.when(F.col("trials") > 0, "OK").otherwise("NO_TRIALS").alias("status"))


def outcomes(trials: DataFrame, kinds: tuple[str, ...] = ("primary", "secondary")) -> DataFrame:
    """nct_id, kind, measure (trimmed) for every outcome that is not blank."""
    tagged = F.concat(*[_measures(k) for k in kinds])
    return trials.select("nct_id", F.explode(tagged).alias("o")).select("nct_id", "o.kind", trimmed(F.col("o.measure")).alias("measure")).where("measure <> ''")


def _measures(kind: str) -> Column:
    rows = F.coalesce(F.col(f"{kind}_outcomes"), F.array().cast("array<struct<measure:string>>"))
    return F.transform(rows, lambda o: F.struct(F.lit(kind).alias("kind"), o["measure"].alias("measure")))


def drugs_of(trials: DataFrame, drug: str) -> DataFrame:
    """Trials of a drug with all endpoints, phase 3 first, then phase 2."""
    hit = trials.where(F.exists("interventions", lambda i: F.lower(i["name"]).contains(drug.lower())))
    phase = F.when(F.array_contains("phases", "PHASE3"), 0).when(F.array_contains("phases", "PHASE2"), 1).otherwise(2)
    return hit.select("nct_id", "title", "status", "phases", F.transform("primary_outcomes", lambda o: o["measure"]).alias("primary"), F.transform("secondary_outcomes", lambda o: o["measure"]).alias("secondary"), phase.alias("phase_rank"))


def cooccurring_drugs(trials: DataFrame, instruments: DataFrame, resolved: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """Instrument, drug, key_ids, in_vocabulary, trials: how many trials of an instrument have a canonical drug, each once per trial.

    resolved: item, key_names, key_ids and, if known, status. ``approved`` (key_ids, approved) keeps combinations all of whose parts
    are approved; without it, names that no vocabulary has (UNRESOLVED_NOT_IN_RXNORM) stay under their own name. Controls are no drugs."""
    rows = naming(trials, instruments, "primary", "secondary", "other")
    given = rows.select("instrument", "nct_id", F.explode("interventions").alias("i")).select("instrument", "nct_id", "i.type", trimmed(F.col("i.name")).alias("item"))
    given = therapies(given.where("item <> ''"), name="item").drop("type")
    status = F.col("status") if "status" in resolved.columns else F.lit(None).cast("string")
    known = resolved.select(trimmed(F.col("item")).alias("item"), "key_names", "key_ids", F.coalesce(status == NOT_IN_VOCABULARY, F.lit(False)).alias("absent")).distinct()
    named = given.join(known, "item").where(F.col("key_ids").isNotNull() | F.col("absent"))
    named = named.select("instrument", "nct_id", F.when(F.col("absent"), F.col("item")).otherwise(F.col("key_names")).alias("key_names"), F.when(F.col("absent"), "").otherwise(F.col("key_ids")).alias("key_ids"), (~F.col("absent")).alias("in_vocabulary")).distinct()
    if approved is not None:
        named = named.where("in_vocabulary").join(approved.where("approved").select("key_ids").distinct(), "key_ids", "left_semi")
    own = F.when(~F.col("in_vocabulary"), F.col("key_names")).alias("own")
    return named.groupBy("instrument", "key_ids", "in_vocabulary", own).agg(F.min("key_names").alias("drug"), F.count_distinct("nct_id").alias("trials")).drop("own")


def cooccurrence_status(instruments: DataFrame, counted: DataFrame, used: DataFrame) -> DataFrame:
    """C02 for co-occurrence: NO_TRIALS_FOUND, NO_DRUGS_IN_COA_TRIALS or DRUGS_LINKED for each instrument."""
    has = used.select("instrument", F.lit(True).alias("t")).distinct()
    drugs = counted.select("instrument", F.lit(True).alias("d")).distinct()
    return instruments.join(has, "instrument", "left").join(drugs, "instrument", "left").select("instrument", F.when(F.col("t").isNull(), "NO_TRIALS_FOUND").when(F.col("d").isNull(), "NO_DRUGS_IN_COA_TRIALS").otherwise("DRUGS_LINKED").alias("status"))


#: Cleaned measures shorter than this are left out.
LEAST_MEASURE = 3


def rolled_up(rows: DataFrame, group: str, fact: str, variant: str, **flags: Column) -> DataFrame:
    """For each group the distinct facts (``facts``), those for which some row has a flag, and its distinct variants (``n_variants``, sorted ``variants``); null variants count as none.

    Rows become facts first and are counted then, so nothing is expanded once per count."""
    facts = rows.groupBy(group, fact).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(k) for k, c in flags.items()])
    counted = facts.groupBy(group).agg(F.count(fact).alias("facts"), *[F.count_if(F.col(k) & F.col(fact).isNotNull()).alias(k) for k in flags])
    each = rows.where(F.col(variant).isNotNull()).select(group, F.col(variant).alias("_v")).distinct().groupBy(group).agg(F.count("*").alias("n_variants"), F.sort_array(F.collect_list("_v")).alias("variants"))
    return counted.join(each, group, "left").withColumns({"n_variants": F.coalesce("n_variants", F.lit(0)).cast("long"), "variants": F.coalesce("variants", F.array().cast("array<string>"))})


def canonical_measures(stream: DataFrame, lists: DataFrame) -> DataFrame:
    """Cleaned measures rolled up under the instrument they name: instrument, category, list_rank, as_primary, as_secondary, trials, n_variants, variants.

    lists: label, category, list_rank (0 first), _ord; the first list that names the measure wins, and in it the first spelling.
    Safety and laboratory outcomes are held against the first list only. Measures that no list names stand for themselves as
    ``other`` (list_rank null). Variants are the cleaned measures that differ from the instrument's name."""
    rows = stream.select("nct_id", "kind", clean_measure(F.col("measure")).alias("clean")).where(F.length("clean") >= LEAST_MEASURE)
    rows = checkpoint(rows.withColumn("low", flat_spaces(F.lower("clean"))))  # read for its texts, then for its rows
    names = lists.select("label", "category", "list_rank", "_ord", F.posexplode(aliases(F.col("label"))).alias("pos", "alias")).where("alias <> ''")
    # A spelling keeps its first place and takes the last label that it is given.
    at = F.struct("_ord", "pos")
    names = names.groupBy("list_rank", "alias").agg(F.min(at).alias("at"), F.max_by(F.struct("label", "category"), at).alias("l"))
    texts = rows.select("low").distinct()
    # Whether the letters are there at all is asked first: a pattern is made only for what may match.
    open_ = (F.col("list_rank") == 0) | ~scaffolding(F.col("low"))
    named = F.when(F.col("low").contains(F.col("alias")), F.when(open_, phrase_in(F.col("alias"), F.col("low"))).otherwise(False)).otherwise(False)
    few = bounded(names, FEW)
    if few is not names:
        met = texts.join(few, named)
    else:
        met = containing(texts, "low", "low", names, "alias").withColumnsRenamed({"key": "low", "term": "alias"}).join(names, "alias").where(named)
    hit = checkpoint(met.groupBy("low").agg(F.min(F.struct("list_rank", "at", "l")).alias("h")))
    rows = rows.join(bounded(hit), "low", "left").withColumn("instrument", F.coalesce("h.l.label", "clean"))
    kind = F.struct(F.coalesce("h.list_rank", F.lit(2**31 - 1)).alias("rank"), F.coalesce("h.l.category", F.lit("other")).alias("category"), F.col("h.list_rank").alias("list_rank"))
    variant = F.when(F.col("clean") != F.col("instrument"), F.col("clean"))
    rows = rows.select("instrument", "nct_id", "kind", kind.alias("k"), variant.alias("variant"))
    counted = rolled_up(rows, "instrument", "nct_id", "variant", as_primary=F.col("kind") == "primary", as_secondary=F.col("kind") == "secondary")
    out = counted.join(rows.groupBy("instrument").agg(F.min("k").alias("k")), "instrument")
    return out.select("instrument", "k.category", "k.list_rank", "as_primary", "as_secondary", F.col("facts").alias("trials"), "n_variants", "variants")


def ranked_measures(found: DataFrame) -> DataFrame:
    """By list, then most trials, then name."""
    return found.orderBy(F.col("list_rank").asc_nulls_last(), F.desc("trials"), F.lower("instrument"))


def shown(blocks: DataFrame) -> DataFrame:
    """Blocks (qualified, instruments: array of structs with trials) that are qualified or of which some trial used an instrument."""
    return blocks.where(F.coalesce("qualified", F.lit(False)) | F.coalesce(F.exists("instruments", lambda i: i["trials"] > 0), F.lit(False)))


def any_outcome(trials: DataFrame, needle: str) -> DataFrame:
    """Trials with the needle in any of three kinds of outcomes."""
    return trials.where(uses_instrument(F.col("primary_outcomes"), F.col("secondary_outcomes"), F.col("other_outcomes"), F.lit(needle)))
