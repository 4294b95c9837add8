"""A batch of queries through all steps: identity, catalogue, neighbours, usage, drugs; every step with a status of its own.

Each step is a function of frames and the whole is one plan for each output table. Steps that only matter where an earlier one
found nothing take just those rows (a left-anti join), as in the neighbours below.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import instrument_names
from ..operators import hierarchy, link, quality, records, resolve, usage
from ..session import checkpoint


@dataclass
class Sources:
    """Tables of a run; the shapes are those of the operators' docstrings."""

    atoms: DataFrame
    concepts: DataFrame
    catalog: DataFrame  # condition, cui, norm
    children: DataFrame  # condition, instrument, stage, qualified
    codes: DataFrame
    edges: DataFrame
    order: DataFrame
    trials: DataFrame
    defined: DataFrame | None = None
    gated: tuple[str, ...] = ()
    guidance: DataFrame | None = None
    treats: DataFrame | None = None  # code, id
    items: DataFrame | None = None  # item, ids, text
    approvals: DataFrame | None = None  # appl, approved
    least_instrument: int = 6


#: Statuses of steps that were left out.
IDLE = ("NOT_NEEDED", "NO_HIERARCHY", "CONDITION_UNRESOLVED")
#: Statuses of what could not be checked.
FAILED = ("LOOKUP_FAILED", "RETRIEVAL_ERROR", "INCOMPLETE_RETRIEVAL")


def identities(queries: DataFrame, s: Sources, rules: resolve.Rules = resolve.Rules()) -> DataFrame:
    return checkpoint(resolve.resolve(queries, s.atoms, s.concepts, s.trials, s.guidance, rules=rules))


def neighbours(who: DataFrame, found: DataFrame, s: Sources, suppress_on: str = "any") -> DataFrame:
    """Structural neighbours in the catalogue for queries that have no catalogue entry of their own (``any``), or no qualified one (``qualified``)."""
    own = found.where("status = 'COA_FOUND'")
    if suppress_on == "qualified":
        own = own.where(F.exists("entries", lambda e: F.exists(e["items"], lambda i: i["qualified"])))
    open_ = who.where("cui is not null").join(own.select("query_id"), "query_id", "left_anti")
    # Lines of descent matter only between codes of the open queries and of the catalogue.
    some = open_.select("cui").union(s.catalog.where("cui <> ''").select("cui")).distinct().join(s.codes, "cui").select("sab", F.col("code").alias("node"))
    ancestors = hierarchy.closure(s.edges, some)
    near = hierarchy.neighbours(open_.select("cui"), s.catalog.where("cui <> ''"), s.codes, s.edges, ancestors, s.order, s.defined, s.gated, reasons=False)
    with_items = near.join(s.children.groupBy("condition").agg(F.count_if("qualified").alias("n_qualified"), F.count("*").alias("n_items")), "condition", "left")
    if suppress_on == "qualified":
        with_items = with_items.where(F.coalesce("n_qualified", F.lit(0)) > 0)
    return open_.select("query_id", F.col("cui").alias("a")).join(with_items, "a").select("query_id", "b", "condition", "relation", "n_agreeing", "n_items")


def instruments(found: DataFrame, least: int) -> DataFrame:
    """query_id, instrument for every name in a query's catalogue entries that is long enough to search."""
    entries = found.where("status = 'COA_FOUND'").select("query_id", F.explode("entries").alias("e")).select("query_id", F.explode("e.items").alias("i"))
    names = entries.select("query_id", F.explode(instrument_names(F.col("i.instrument"))).alias("instrument"))
    return names.where(F.length("instrument") >= least).distinct()


#: What a run can make; each part needs those before it.
PARTS = ("identity", "catalog", "neighbours", "usage", "drugs")


def _measured(df: DataFrame, part: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """A part of a run, made once and written down, and what was counted of its rows on the way."""
    told = Observation(f"{part}-{uuid.uuid4().hex}")
    return checkpoint(df.observe(told, *[F.coalesce(m, F.lit(0)).cast("long").alias(n) for n, m in metrics.items()])), told.get


def run(queries: DataFrame, s: Sources, rules: resolve.Rules = resolve.Rules(), suppress_on: str = "any", parts: tuple[str, ...] = PARTS) -> dict[str, DataFrame | dict]:
    """R18 (suppress_on="qualified"), R19 (suppress_on="any"): identity, catalog, neighbours, usage, drugs, assembled and summary of a batch of queries (query_id, query).

    Each of ``parts`` is computed once and written down, what comes later reads it. ``metrics`` has what was counted while it was made, by part:
    rows asked, failures, and rows that nothing was found for."""
    failed = lambda c: F.count_if(F.coalesce(F.col(c).isin(*FAILED), F.lit(False)))
    metrics = {}
    who, metrics["identity"] = _measured(resolve.resolve(queries, s.atoms, s.concepts, s.trials, s.guidance, rules=rules), "identity", {"asked": F.count("*"), "failed": failed("status"), "none": F.count_if(F.col("cui").isNull())})
    out = {"identity": who, "metrics": metrics}
    found, metrics["catalog"] = _measured(link.catalog_lookup(who.select("query_id", "cui", "normalized", "status"), s.catalog, s.children), "catalog", {"asked": F.count("*"), "failed": failed("status"), "none": F.count_if(F.col("status") != "COA_FOUND")})
    out["catalog"] = found
    if "neighbours" in parts:
        out["neighbours"], metrics["neighbours"] = _measured(neighbours(who, found, s, suppress_on), "neighbours", {"asked": F.count("*"), "none": F.count_if(F.coalesce("n_items", F.lit(0)) == 0)})
    if "usage" in parts:
        asked = checkpoint(instruments(found, s.least_instrument))
        used = usage.using(s.trials, asked.select("instrument").distinct())
        out["usage"], metrics["usage"] = _measured(asked.join(usage.usage(asked, used), "instrument"), "usage", {"asked": F.count("*"), "none": F.count_if(F.coalesce("trials", F.lit(0)) == 0)})
    if "drugs" in parts and s.treats is not None and s.items is not None and s.approvals is not None:
        settled = who.where("cui is not null")
        concepts = settled.join(s.codes.where("code <> ''").select("cui", "code"), "cui").select("query_id", "code")
        terms = settled.select("query_id", F.explode(F.array("label", "query")).alias("term")).where("term is not null")
        asked_of = who.select("query_id", F.col("cui").isNotNull().alias("has_concept"))
        drugs = link.two_route_lookup(asked_of, concepts, terms, s.treats, s.items, s.approvals, resolved=F.col("has_concept")).drop("has_concept")
        out["drugs"], metrics["drugs"] = _measured(drugs, "drugs", {"asked": F.count("*"), "none": F.count_if(F.coalesce(F.size("drugs"), F.lit(0)) <= 0)})
    if "neighbours" in parts:
        out["assembled"] = assembled(out)
        if "usage" in parts:
            out["summary"] = summary(out)
    return out


def summary(out: dict[str, DataFrame | dict]) -> DataFrame:
    """query_id, query, steps (status and note by name), degraded_steps, statement."""
    who, found, near, counted = (out[k] for k in PARTS[:4])
    steps = who.select("query_id", "query", "status", "cui").join(found.select("query_id", F.col("status").alias("catalog")), "query_id", "left")
    steps = steps.join(near.groupBy("query_id").agg(F.count("*").alias("n_near")), "query_id", "left").join(counted.groupBy("query_id").agg(F.sum("trials").alias("n_trials")), "query_id", "left")
    neighbour_status = F.when(F.col("catalog") == "COA_FOUND", "NOT_NEEDED").when(F.col("cui").isNull(), "NO_HIERARCHY").when(F.col("n_near") > 0, "NEIGHBORS_FOUND").otherwise("NO_NEIGHBOR_IN_CATALOG")
    usage_status = F.when(F.col("catalog") != "COA_FOUND", "NOT_NEEDED").when(F.col("n_trials") > 0, "OK").otherwise("NO_TRIALS")
    each, degraded = quality.sealed({"identity": F.col("status"), "catalog": F.col("catalog"), "neighbours": neighbour_status, "usage": usage_status})
    line = F.concat_ws("\n", F.concat(F.lit("identity: "), F.col("status")), F.concat(F.lit("catalog: "), "catalog"), F.concat(F.lit("neighbours: "), neighbour_status), F.concat(F.lit("usage: "), usage_status))
    return steps.select("query_id", "query", each.alias("steps"), degraded.alias("degraded_steps"), line.alias("statement"))


def measured(out: dict[str, DataFrame | dict]) -> dict[str, Column]:
    """What a run's metrics say of its sources, by path in the calibration block. Rates are of what was asked, and null where nothing was;
    what no part of a run measures is not there. Looking an instrument up in the trials is the run's retrieval of facts."""
    m = out["metrics"]
    at = {}
    if "usage" in m:
        n, none = F.lit(m["usage"]["asked"]), F.lit(m["usage"]["none"])
        at |= {"fetch_attempted_count": n, "no_abstract_count": none, "no_abstract_rate": records.rate(none, n)}
    at = {f"technical_failures.by_source.pubmed.{k}": v for k, v in at.items()}
    asked, failed = (sum(m[p].get(k, 0) for p in m) for k in ("asked", "failed"))
    at |= {"technical_failures.by_source.pubmed.fetch_failure_count": F.lit(failed), "technical_failures.by_source.pubmed.fetch_failure_rate": records.rate(F.lit(failed), F.lit(asked))}
    at["technical_failures.by_source.orphadata_nomenclature.no_local_match"] = F.lit(m["identity"]["none"])
    if "drugs" in m:
        at["technical_failures.by_source.fda_approval.load_error"] = F.lit(m["drugs"]["asked"] > 0 and m["drugs"]["none"] == m["drugs"]["asked"])
    return at


def recorded(out: dict[str, DataFrame | dict], day: str) -> DataFrame:
    """query_id, record, suppressed, denominators: the record of every query that settled on a concept (null for others), with its
    calibration as the run measured it (rates of the whole run; of the query itself whether there was nothing to verify or to read), a
    suppression record for each step of the run that was not needed or could not be made, by name, and what the rates are of. ``day`` dates both."""
    on = F.lit(day).cast("date")
    own = out["catalog"].select("query_id", (F.col("status") == "COA_FOUND").alias("listed"))
    read = out["usage"].groupBy("query_id").agg(F.count("*").alias("n_asked"), F.sum("trials").alias("n_read"))
    who = out["identity"].join(own, "query_id", "left").join(read, "query_id", "left")
    values = measured(out) | {
        "structural_signals.no_endpoints_to_verify": F.when(F.col("listed"), F.col("n_asked").isNull()),
        "structural_signals.challenge_zero_articles": F.when(F.col("n_asked") > 0, F.coalesce("n_read", F.lit(0)) == 0),
    }
    who = who.select("query_id", F.when(F.col("cui").isNotNull(), records.disease_record(F.col("cui"), F.col("label"), on, values)).alias("record"))
    idle = F.filter(F.array_sort(F.map_entries("steps")), lambda x: x["value"]["status"].isin(*IDLE))
    steps = out["summary"].select("query_id", F.transform(idle, lambda x: records.suppression(x["key"], x["value"]["status"], F.lit("another status of an earlier step"), on)).alias("suppressed"))
    of = F.create_map(*[F.lit(v) for p, m in sorted(out["metrics"].items()) for v in (p, m["asked"])])
    return who.join(steps, "query_id", "left").withColumn("denominators", of)


def assembled(out: dict[str, DataFrame]) -> DataFrame:
    """What the parts of ``run`` say of each query, and nothing they do not: counts, whether items, qualified ones and drugs were found,
    the gap (drugs but no catalogue items), and the three best-agreed neighbours that have items, where the query has none.

    query_id, n_coas, n_qualified, n_drugs, n_drugs_corroborated, has_coa, has_qualified_coa, has_drugs, gap, nearby."""
    items = out["catalog"].select("query_id", F.explode_outer("entries").alias("e")).select("query_id", F.explode_outer("e.items").alias("i"))
    rows = items.groupBy("query_id").agg(F.count("i").alias("n_coas"), F.count_if("i.qualified").alias("n_qualified"))
    drugs = out.get("drugs")
    if drugs is None:
        rows = rows.withColumns({"n_drugs": F.lit(0), "n_drugs_corroborated": F.lit(0)})
    else:
        n = F.coalesce(F.size("drugs"), F.lit(0))
        both = F.coalesce(F.size(F.filter("drugs", lambda x: x["both_routes"])), F.lit(0))
        rows = rows.join(drugs.select("query_id", F.greatest(n, F.lit(0)).alias("n_drugs"), F.greatest(both, F.lit(0)).alias("n_drugs_corroborated")), "query_id", "left").fillna(0, ["n_drugs", "n_drugs_corroborated"])
    near = out["neighbours"].where("n_items > 0").groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("n_agreeing")).alias("o"), "condition", "relation", "n_items"))), 1, 3).alias("n"))
    near = near.select("query_id", F.transform("n", lambda x: F.struct(x["condition"].alias("condition"), x["relation"].alias("relation"), x["n_items"].alias("n_items"))).alias("nearby"))
    has = {"has_coa": F.col("n_coas") > 0, "has_qualified_coa": F.col("n_qualified") > 0, "has_drugs": F.col("n_drugs") > 0}
    rows = rows.join(near, "query_id", "left").withColumns(has).withColumn("gap", F.col("has_drugs") & ~F.col("has_coa"))
    return rows.withColumn("nearby", F.when(~F.col("has_coa"), F.coalesce("nearby", F.array().cast("array<struct<condition:string,relation:string,n_items:bigint>>"))))


def warm_relations(catalog: DataFrame, s: Sources, path: str) -> DataFrame:
    """Relations of all pairs of catalogue concepts that are related in some source, written once and read from then on."""
    near = hierarchy.neighbours(catalog.select("cui"), catalog, s.codes, s.edges, hierarchy.closure(s.edges), s.order, s.defined, s.gated)
    near.write.mode("overwrite").parquet(path)
    return catalog.sparkSession.read.parquet(path)


def verified(relations: DataFrame, known: DataFrame) -> DataFrame:
    """A, b, relation (known), found, holds: relations (a, b, relation) held against answers that are known; a pair that is not there is NO_HIERARCHY."""
    rows = known.join(relations.select("a", "b", F.col("relation").alias("found")), ["a", "b"], "left")
    return rows.select("a", "b", "relation", F.coalesce("found", F.lit(hierarchy.NO_HIERARCHY)).alias("found"), F.coalesce(F.col("found") == F.col("relation"), F.lit(False)).alias("holds"))


def name_to_concept(names: DataFrame, s: Sources, rules: resolve.Rules = resolve.Rules()) -> DataFrame:
    """Name, cui of names that are settled by votes; names settled from several units are left out, as their ids are not the name's own."""
    rows = resolve.resolve(names.select(F.col("name").alias("query_id"), F.col("name").alias("query")), s.atoms, s.concepts, rules=rules)
    return rows.where(F.col("status") == resolve.RESOLVED).select(F.col("query").alias("name"), "cui")


def cached_result(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """cached rows by the query as it stands, else by its trimmed lower-case form; of several results of a query the least."""
    low = lambda c: F.lower(F.trim(c))
    once = cache.groupBy(F.col("query").alias("k")).agg(F.min("result").alias("result"))
    exact = queries.join(once, F.col("query") == F.col("k"), "left").drop("k")
    loose = cache.groupBy(low(F.col("query")).alias("k")).agg(F.min("result").alias("loose"))
    return exact.join(loose, low(F.col("query")) == F.col("k"), "left").select("query_id", "query", F.coalesce("result", "loose").alias("result"))
