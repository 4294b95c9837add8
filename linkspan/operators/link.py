"""Linking: keys, catalogues, coded and text routes with their provenance kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import LEAST_TERM, control, overlaps_enough, term_matches, words_present
from ..functions.text import digits_key, drug_entries, generics_agree, iso_date, loose_words, normalize_loose
from ..session import bounded, checkpoint
from .meet import FEW, containing


#: How a query can be settled without a concept; its normal form is looked up then.
SETTLED_WITHOUT_CONCEPT = ("RESOLVED_AS_TRIAL_POPULATION", "RESOLVED_BY_GUIDANCE")


def catalog_lookup(queries: DataFrame, catalog: DataFrame, children: DataFrame, key: str = "condition") -> DataFrame:
    """query_id, key_kind, entries (array of struct<condition, items>), status COA_FOUND, NO_COA (no entry, or none with items) or CONDITION_UNRESOLVED.

    queries (query_id, cui, normalized and, if known, status) meet catalogue rows (condition, cui, norm) by cui, else by normal form;
    children carry ``key``. With a status, queries that are settled neither on a concept nor without one are not looked up; in the
    catalogue, an empty norm marks rows that are not settled.
    """
    kids = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in children.columns if c != key]))).alias("items"))
    entries = catalog.select("condition", F.nullif("cui", F.lit("")).alias("cui"), F.nullif("norm", F.lit("")).alias("norm")).join(kids.withColumnRenamed(key, "condition"), "condition", "left")
    entries = entries.withColumn("entry", F.struct("condition", "items"))
    known = F.coalesce(F.col("status").isin(*SETTLED_WITHOUT_CONCEPT), F.lit(False)) if "status" in queries.columns else F.lit(True)
    mine = queries.select("query_id", F.nullif("cui", F.lit("")).alias("cui"), "normalized", known.alias("known")).withColumn("known", F.col("known") | F.col("cui").isNotNull())
    coded = mine.where("cui is not null").join(entries.where("cui is not null").select("cui", "entry"), "cui").select("query_id", F.lit("cui").alias("key_kind"), "entry")
    named = mine.where("cui is null and known").join(entries.where("cui is null").select(F.col("norm").alias("normalized"), "entry"), "normalized").select("query_id", F.lit("name").alias("key_kind"), "entry")
    found = coded.unionByName(named).groupBy("query_id", "key_kind").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    some = F.coalesce(F.exists("entries", lambda e: F.coalesce(F.size(e["items"]), F.lit(0)) > 0), F.lit(False))
    status = F.when(~F.col("known"), "CONDITION_UNRESOLVED").when(some, "COA_FOUND").otherwise("NO_COA")
    return mine.select("query_id", "known").join(found, "query_id", "left").withColumn("status", status).drop("known")


def catalog_size(catalog: DataFrame) -> DataFrame:
    """Distinct concepts, distinct names without one, rows with neither, and their sum."""
    cui, norm = F.nullif("cui", F.lit("")), F.nullif("norm", F.lit(""))
    out = catalog.agg(F.count_distinct(cui).alias("concepts"), F.count_distinct(F.when(cui.isNull(), norm)).alias("names"), F.count_if(cui.isNull() & norm.isNull()).alias("neither"))
    return out.withColumn("size", F.col("concepts") + F.col("names") + F.col("neither"))


def by_number(items: DataFrame, documents: DataFrame, item: str, number: str) -> DataFrame:
    """Items with the documents of the number in the item's name (``digits_key``); items without any are kept."""
    left = items.withColumn("_key", digits_key(F.col(item)))
    own = F.trim(number)
    right = documents.where(own != "").withColumn("_key", F.when(F.length(own) < 6, F.lpad(own, 6, "0")).otherwise(own))
    return left.join(right, "_key", "left").drop("_key")


def coded_route(concepts: DataFrame, treats: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, item: concept codes (query_id, code) to ids that treat them (id, code) to items that hold the id (item, ids)."""
    hit = concepts.join(treats, "code").select("query_id", "id").distinct()
    return hit.join(items.select("item", F.explode("ids").alias("id")), "id").select("query_id", "item").distinct()


def text_route(terms: DataFrame, items: DataFrame, text: str = "text", least: int = LEAST_TERM) -> DataFrame:
    """query_id, item: terms (query_id, term) contained in a text, case aside; terms shorter than ``least`` are not searched.

    Texts and terms meet by ``meet.containing``.
    """
    asked = terms.select("query_id", F.lower(F.trim("term")).alias("term")).where(F.length("term") >= least).distinct()
    found = containing(items.select("item", F.lower(F.col(text)).alias("prose")), "item", "prose", asked)
    return found.join(asked, "term").select("query_id", F.col("key").alias("item")).distinct()


def merged_routes(**routes: DataFrame) -> DataFrame:
    """query_id, item, routes (sorted names of the routes that found it), both_routes."""
    rows = None
    for name, found in routes.items():
        one = found.select("query_id", "item", F.lit(name).alias("route"))
        rows = one if rows is None else rows.unionByName(one)
    out = rows.groupBy("query_id", "item").agg(F.sort_array(F.collect_set("route")).alias("routes"))
    return out.withColumn("both_routes", F.size("routes") == len(routes))


def _drug() -> Column:
    """Drugs of a query in order: both routes first, then by date, undated last (they sort as the latest)."""
    return F.struct((~F.col("both_routes")).alias("o1"), F.coalesce(F.col("approved").cast("string"), F.lit("9999")).alias("o2"), "item", "routes", "both_routes", "approved")


def _by_routes(concepts: DataFrame, terms: DataFrame, treats: DataFrame, items: DataFrame, approvals: DataFrame) -> DataFrame:
    """query_id, both_routes and the drug with its place in order, for everything that either route found."""
    # Approvals grow with the items, and small files may hold very many of them: never a broadcast.
    dates = approvals.select(F.col("appl").alias("item"), "approved").hint("merge")
    found = merged_routes(coded=coded_route(concepts, treats, items), prose=text_route(terms, items)).join(dates, "item", "left")
    return found.select("query_id", "both_routes", _drug().alias("drug"))


def _plain(drugs: str) -> Column:
    return F.transform(drugs, lambda x: F.struct(x["item"].alias("item"), x["approved"].alias("approved"), x["routes"].alias("routes"), x["both_routes"].alias("both_routes")))


def _with_status(queries: DataFrame, per: DataFrame, some: str, empty: dict[str, Column], checked: Column | None, resolved: Column | None) -> DataFrame:
    """Queries with what was found for them, or with ``empty`` where they settled on no concept, and a status. ``some`` is null where nothing was found."""
    ok = F.lit(True) if checked is None else F.coalesce(checked, F.lit(False))
    settled = F.lit(True) if resolved is None else F.coalesce(resolved, F.lit(False))
    status = F.when(~settled, "CONDITION_UNRESOLVED").when(~ok, "LOOKUP_FAILED").when(F.col(some).isNull(), "NO_DRUGS").otherwise("DRUGS_FOUND")
    rows = queries.join(per, "query_id", "left").withColumn("status", status)
    return rows.withColumns({c: F.when(settled, F.coalesce(c, e)).otherwise(e) for c, e in empty.items()})


def two_route_lookup(queries: DataFrame, concepts: DataFrame, terms: DataFrame, treats: DataFrame, items: DataFrame, approvals: DataFrame, checked: Column | None = None, resolved: Column | None = None) -> DataFrame:
    """One row per query: status, drugs (both routes first, then by date, undated last), n_one_route.

    ``checked`` is false for queries whose codes could not be looked up (LOOKUP_FAILED, not without drugs), ``resolved`` for those that
    settled on no concept: they are CONDITION_UNRESOLVED and get no drugs by either route. Both are columns of ``queries``.
    All drugs of a query are one list; where a query may have very many, ``two_route_ends`` gathers only those that are shown."""
    found = _by_routes(concepts, terms, treats, items, approvals)
    per = found.groupBy("query_id").agg(F.sort_array(F.collect_list("drug")).alias("drugs"), F.count_if(~F.col("both_routes")).alias("n_one_route"))
    return _with_status(queries, per.withColumn("drugs", _plain("drugs")), "drugs", {"drugs": F.lit(None), "n_one_route": F.lit(0)}, checked, resolved)


def two_route_ends(queries: DataFrame, concepts: DataFrame, terms: DataFrame, treats: DataFrame, items: DataFrame, approvals: DataFrame, first: int, last: int, checked: Column | None = None, resolved: Column | None = None) -> DataFrame:
    """The same of queries with any number of drugs: one row per query: status, n_drugs, n_one_route over all drugs, and of their order the ``first`` and the ``last`` so many.

    Every drug is found, counted and ranked; a task hands on only what may be among the first or last of a query, so no list grows with the items."""
    found = _by_routes(concepts, terms, treats, items, approvals)
    per = found.groupBy("query_id").agg(F.count("*").alias("n_drugs"), F.count_if(~F.col("both_routes")).alias("n_one_route"))
    for name, n, order in (("first", first, F.col("drug").asc()), ("last", last, F.col("drug").desc())):
        end = found.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(order))).where(F.col("_r") <= n)
        per = per.join(end.groupBy("query_id").agg(F.sort_array(F.collect_list("drug")).alias(name)).withColumn(name, _plain(name)), "query_id", "left")
    none = F.lit(None)
    return _with_status(queries, per, "n_drugs", {"n_drugs": F.lit(0), "n_one_route": F.lit(0), "first": none, "last": none}, checked, resolved)


def original_approvals(submissions: DataFrame) -> DataFrame:
    """Appl, approved: the earliest approved original submission."""
    first = submissions.where((F.col("SubmissionType") == "ORIG") & (F.col("SubmissionStatus") == "AP")).withColumn("d", iso_date(F.col("SubmissionStatusDate")))
    return first.where("d is not null").groupBy(F.col("ApplNo").alias("appl")).agg(F.min("d").alias("approved"))


def approved_since(items: DataFrame, approvals: DataFrame, conditions: DataFrame, since: str) -> DataFrame:
    """Condition, appl, term, approved: items approved since a date whose text has a term of the condition; the first term in order counts.

    conditions: condition, term, _ord."""
    recent = items.join(approvals.where(F.col("approved") >= F.lit(since).cast("date")), "appl")
    few = bounded(conditions, FEW)
    if few is not conditions:
        hit = recent.join(few, term_matches(F.col("term"), F.col("indication_text")))
    else:
        low = conditions.withColumn("low", F.lower(F.trim("term")))
        met = containing(recent.select("appl", F.lower("indication_text").alias("text")), "appl", "text", low, "low").withColumnsRenamed({"key": "appl", "term": "low"})
        hit = recent.join(met, "appl").join(low, "low").where(term_matches(F.col("term"), F.col("indication_text")))
    return hit.groupBy("condition", "appl").agg(F.min_by("term", "_ord").alias("term"), F.min("approved").alias("approved"))


def ingredient_ids(ids: DataFrame, ingredients: DataFrame, column: str = "rxcui") -> DataFrame:
    """Ids on the ids of their ingredients; an id without ingredients stands for itself."""
    parts = ingredients.select(F.col("rxcui").alias(column), F.col("ingredient_rxcui").alias("_part"))
    return ids.join(parts, column, "left").withColumn(column, F.coalesce("_part", F.col(column))).drop("_part").distinct()


def all_approved(combinations: DataFrame, approved: DataFrame, key: str = "key_ids", part: str = "id") -> DataFrame:
    """Combinations with the column approved: true only when every component (joined by /) is in ``approved``."""
    parts = combinations.select(key).distinct().withColumn(part, F.explode(F.split(key, "/")))
    known = parts.join(approved.select(part, F.lit(True).alias("_ok")).distinct(), part, "left")
    return combinations.join(known.groupBy(key).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("approved")), key, "left")


def word_overlap(names: DataFrame, blobs: DataFrame, name: str, blob: str) -> DataFrame:
    """Pairs whose text holds all long words of the name but one, and two at least: ids of both, present, of.

    At most one word may be missing, so one of any two distinct words of a name is always there. Few names are broadcast and every
    text is read once. Many meet the texts by words: which distinct words of texts contain which words of names is found once for
    the vocabulary (``meet.containing``), names and texts meet by the two words of a name that the fewest texts have, and what meets
    is counted. Texts themselves are never shuffled. names: name_id; blobs: blob_id.
    """
    words = F.filter(F.split("n", " "), lambda w: F.length(w) > 4)
    n = names.select("name_id", normalize_loose(F.col(name)).alias("n")).where(F.size(words) >= 2)
    few = bounded(n, FEW)
    if few is not n:
        by_length = F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
        few = F.broadcast(n.withColumn("w1", F.get(by_length, F.lit(0))["w"]).withColumn("w2", F.coalesce(F.get(by_length, F.lit(1))["w"], F.col("w1"))))
        b = blobs.select("blob_id", normalize_loose(F.col(blob)).alias("b"))
        found = words_present(F.col("n"), F.col("b"))
        # One conditional expression: as two predicates Catalyst would put the costly one first.
        rows = b.join(few, F.when(F.col("b").contains(F.col("w1")) | F.col("b").contains(F.col("w2")), overlaps_enough(found)).otherwise(False))
        return rows.select("name_id", "blob_id", found.alias("f")).select("name_id", "blob_id", "f.present", "f.of")
    each = checkpoint(n.select("name_id", F.size(words).alias("of"), F.explode(words).alias("w")).groupBy("name_id", "of", "w").agg(F.count("*").alias("times")))
    tokens = checkpoint(blobs.select("blob_id", F.explode(F.array_distinct(loose_words(F.col(blob)))).alias("token")).where(F.length("token") > 4))
    known = checkpoint(tokens.groupBy("token").agg(F.count("*").alias("n")))
    met = checkpoint(containing(known, "token", "token", each, "w").withColumnsRenamed({"key": "token", "term": "w"}))
    often = bounded(met.join(known, "token").groupBy("w").agg(F.sum("n").alias("n")))
    rare = each.join(often, "w", "left").groupBy("name_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))), 1, 2).alias("two"))
    rare = rare.select("name_id", F.explode(F.transform("two", lambda x: x["w"])).alias("w"))
    pairs = checkpoint(tokens.join(bounded(checkpoint(met.join(bounded(rare), "w").select("token", "name_id").distinct())), "token").select("name_id", "blob_id").distinct())
    mine = tokens.join(bounded(pairs), "blob_id").join(bounded(met), "token").select("name_id", "blob_id", "w").distinct()
    counted = mine.join(bounded(each), ["name_id", "w"]).groupBy("name_id", "blob_id").agg(F.sum("times").cast("int").alias("present"), F.first("of").alias("of"))
    return counted.where(overlaps_enough(F.struct("present", "of"))).select("name_id", "blob_id", "present", "of")


def brand_resolution(compendium: DataFrame, labels: DataFrame) -> DataFrame:
    """Every drug named in a compendium cell with its application: disease, brand, generic, approved, status, appl, label_generic.

    compendium: disease, drug_approval; labels: brand_name, ApplNo, generic_name. Cells with text and no drug stay as NOT_A_DRUG."""
    cells = compendium.withColumn("e", drug_entries(F.col("drug_approval")))
    none = cells.where((F.size("e") == 0) & (F.trim("drug_approval") != "")).select("disease", *[F.lit(None).cast("string").alias(c) for c in ("brand", "generic", "approved")], F.lit("NOT_A_DRUG").alias("status"), F.lit(None).cast("string").alias("appl"), F.lit(None).cast("string").alias("label_generic"))
    named = cells.select("disease", F.explode("e").alias("x")).select("disease", "x.*").withColumn("k", F.lower("brand"))
    by = labels.groupBy(F.lower("brand_name").alias("k")).agg(F.min(F.struct("ApplNo", "generic_name")).alias("l"))
    rows = named.join(by, "k", "left")
    status = F.when(F.col("l").isNull(), "NOT_FOUND").when(generics_agree(F.col("generic"), F.col("l.generic_name")), "OK").otherwise("GENERIC_MISMATCH")
    return rows.select("disease", "brand", "generic", "approved", status.alias("status"), F.col("l.ApplNo").alias("appl"), F.col("l.generic_name").alias("label_generic")).unionByName(none)


def key_status(keys: DataFrame, facts: DataFrame, key: str, missing: str = "NOT_FOUND") -> DataFrame:
    """Distinct keys with their facts, status OK, or one row with the status of a miss."""
    asked = keys.select(key).distinct()
    return asked.join(facts.distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("status", F.when(F.col("_hit"), "OK").otherwise(missing)).drop("_hit")


def repointed(rows: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Compare and set: a change (key, old, new) takes effect where the value is still the old one; column outcome says what was done."""
    out = rows.join(bounded(changes.select(F.col(key), F.col("old").alias("_old"), F.col("new").alias("_new"))), key, "left")
    hit = F.col(value).eqNullSafe(F.col("_old"))
    outcome = F.when(F.col("_new").isNull(), "UNTOUCHED").when(hit, "UPDATED").otherwise("SKIPPED_OLD_VALUE_DIFFERS")
    return out.withColumn("outcome", outcome).withColumn(value, F.when((F.col("outcome") == "UPDATED"), F.col("_new")).otherwise(F.col(value))).drop("_old", "_new")


def therapies(interventions: DataFrame, kind: str = "type", name: str = "name") -> DataFrame:
    """P10: interventions of a drug or biological that are no controls."""
    return interventions.where(F.col(kind).isin("DRUG", "BIOLOGICAL") & ~control(F.col(name)))
