"""Operators on small literal tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from linkspan.operators import dedup, facets, genes, hierarchy, link, meet, quality, resolve, setops, usage
from linkspan.plans import batch
from linkspan.sources import files, pages

T = ["Disease or Syndrome"]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def atoms(spark, cells):
    return spark.createDataFrame([(c, s, t) for c, t, names in cells for s in names], "cui string, sab string, str string")


@pytest.fixture(scope="module")
def vocabulary(spark):
    cells = [
        ("C1", "hip fracture", ["A", "B", "C"]), ("C2", "hip fracture", ["A"]), ("C3", "itch", ["A", "B"]), ("C4", "itch", ["A", "B"]),
        ("C5", "breast cancer", ["CHV", "MEDLINEPLUS"]), ("C6", "breast cancer", ["CHV", "B"]), ("C7", "odd", ["A", "B"]), ("C8", "odd", ["C", "D"]),
        ("C9", "gene only", ["A", "B"]), ("C10", "alpha disease", ["A", "B"]), ("C10", "beta disease", ["A", "B"]), ("C11", "lonely", ["A"]),
    ]
    types = {"C3": ["Gene or Genome"], "C9": ["Gene or Genome"]}
    concepts = [(c, c.lower(), types.get(c, T), 3) for c in sorted({x[0] for x in cells})]
    return atoms(spark, cells), spark.createDataFrame(concepts, "cui string, name string, semantic_types array<string>, atom_count int")


def test_resolution_ladder(spark, vocabulary):
    said = ["Hip Fracture", "itch", "breast cancer", "odd", "gene only", "Alpha Disease (AD) Beta Disease (BD)", "lonely", "Popular Thing", "(x)", "nothing", "cited one", "could not check"]
    m = spark.createDataFrame(list(enumerate(said)), "query_id int, query string")
    trials = spark.createDataFrame([(["popular thing."],), (["Popular thing"],), (["lonely"],)], "conditions array<string>")
    guidance = spark.createDataFrame([("Cited One", "Label", "Guidance")], "name string, label string, citation string")
    unchecked = spark.createDataFrame([("could not check",)], "norm string")
    out = {r["query"]: r for r in resolve.resolve(m, *vocabulary, trials, guidance, unchecked=unchecked).collect()}
    assert len(out) == len(said)
    want = {
        "Hip Fracture": ("RESOLVED", "C1"), "itch": ("RESOLVED", "C4"), "breast cancer": ("RESOLVED", "C5"), "odd": ("CONFLICT_DETECTED", None), "gene only": ("NOT_A_CONDITION", None),
        "Alpha Disease (AD) Beta Disease (BD)": ("RESOLVED_FROM_MULTINAME", "C10"), "lonely": ("NOT_A_CONDITION", None), "Popular Thing": ("RESOLVED_AS_TRIAL_POPULATION", None),
        "(x)": ("UNRESOLVED", None), "nothing": ("NOT_A_CONDITION", None), "cited one": ("RESOLVED_BY_GUIDANCE", None), "could not check": ("LOOKUP_FAILED", None),
    }
    assert {k: (v["status"], v["cui"]) for k, v in out.items()} == want
    assert out["odd"]["contest"] is not None and out["breast cancer"]["authority"] == "narrower"


def test_near_misses(spark, vocabulary):
    m = spark.createDataFrame([(1, "hip fracture"), (2, "itch"), (3, "breast cancer"), (4, "()")], "query_id int, query string")
    miss = resolve.near_misses(m, resolve.candidates(m, *vocabulary))
    assert rows(miss.where("candidate is not null"), "query_id", "reason", "candidate") == [(1, "SINGLE_VOCABULARY_ONLY", "C2"), (2, "TYPE_REJECTED", "C3"), (3, "NOT_THE_LAY_MEANING", "C6")]


def test_item_ladder(spark):
    names = spark.createDataFrame([("sacubitril / valsartan", "9"), ("dapagliflozin", "1"), ("aspirin", "2")], "name string, rxcui string")
    parts = spark.createDataFrame([("9", "12", "valsartan"), ("9", "11", "Sacubitril"), ("1", "1", "dapagliflozin")], "rxcui string, ingredient_rxcui string, ingredient string")
    items = spark.createDataFrame([("Sacubitril / Valsartan",), ("Dapagliflozin 10mg Tab",), ("dapagliflozine",), ("Blood thinner (aspirin)",), ("LCZ696 (aspirine)",), ("Pill 7 (placebo)",), ("placebo",), ("zzz",), ("",)], "item string")
    out = {r["item"]: (r["status"], r["match_step"], r["key_ids"]) for r in resolve.resolve_items(items, names, parts).collect()}
    assert out["Sacubitril / Valsartan"] == ("RESOLVED", "exact_raw", "11/12")
    assert out["Dapagliflozin 10mg Tab"] == ("RESOLVED", "exact_clean", "1")
    assert out["dapagliflozine"] == ("RESOLVED", "approximate", "1")
    assert out["Blood thinner (aspirin)"] == ("RESOLVED", "parenthetical", "2")
    assert out["LCZ696 (aspirine)"] == ("RESOLVED", "parenthetical", "2") and out["Pill 7 (placebo)"][0] == "UNRESOLVED_NOT_IN_RXNORM"
    named = {r["item"]: r["key_names"] for r in resolve.resolve_items(items, names, parts).collect()}
    assert named["Blood thinner (aspirin)"] == "Blood thinner (aspirin)" and named["zzz"] is None
    assert out["placebo"][0] == out[""][0] == "UNRESOLVED_NOT_A_DRUG" and out["zzz"][0] == "UNRESOLVED_NOT_IN_RXNORM"


def edges(spark, *cells):
    return spark.createDataFrame(list(cells), "sab string, child string, parent string")


def test_closure_with_a_cycle(spark):
    e = edges(spark, ("S", "a", "b"), ("S", "b", "c"), ("S", "c", "a"), ("S", "d", "a"))
    assert rows(hierarchy.closure(e), "node", "ancestor", "depth") == [("a", "b", 1), ("a", "c", 2), ("b", "a", 2), ("b", "c", 1), ("c", "a", 1), ("c", "b", 2), ("d", "a", 1), ("d", "b", 2), ("d", "c", 3)]


def relation(spark, e, pairs, defined=None, gated=()):
    sabs = [r[0] for r in e.select("sab").distinct().collect()]
    codes = spark.createDataFrame([(c, s, c) for c in {x for p in pairs for x in p} for s in sabs], "cui string, sab string, code string")
    p = spark.createDataFrame(pairs, "a string, b string")
    return hierarchy.relation_per_source(p, codes, e, hierarchy.closure(e), defined, gated)


def test_undefined_parent_gates_before_ancestors(spark):
    # b is an ancestor of a, and both also sit under the undefined g: the gate answers first.
    e = edges(spark, ("S", "a", "m"), ("S", "m", "b"), ("S", "a", "g"), ("S", "b", "g"))
    defined = spark.createDataFrame([("S", "m")], "sab string, code string")
    assert rows(relation(spark, e, [("a", "b")], defined, ("S",)), "relation") == [("UNRELATED",)]
    assert rows(relation(spark, e, [("a", "b")], defined.limit(0), ("S",)), "relation") == [("SIBLING",)]
    assert rows(relation(spark, e, [("a", "b")], defined, ()), "relation") == [("SIBLING",)]


@pytest.mark.parametrize(
    ("votes", "winner", "dissent"),
    [
        ({"A": "DESCENDANT", "B": "DESCENDANT", "C": "DESCENDANT", "D": "SIBLING"}, "DESCENDANT", {"SIBLING": ["D"]}),
        ({"A": "UNRELATED", "B": "UNRELATED", "C": "UNRELATED", "D": "UNRELATED", "E": "SIBLING"}, "UNRELATED", {"SIBLING": ["E"]}),
        ({"A": "UNRELATED", "B": "SIBLING"}, "SIBLING", {"UNRELATED": ["A"]}),
        ({"A": "CHILD", "B": "PARENT"}, "CHILD", {"PARENT": ["B"]}),
        ({"A": "NO_HIERARCHY"}, "NO_HIERARCHY", {}),
    ],
)
def test_vote(spark, votes, winner, dissent):
    per = spark.createDataFrame([("x", "y", s, r, ["p" + s] if r == "SIBLING" else []) for s, r in votes.items()], "a string, b string, sab string, relation string, via array<string>")
    order = spark.createDataFrame([(s, i) for i, s in enumerate("ABCDE")], "sab string, source_order int")
    r = hierarchy.vote(spark.createDataFrame([("x", "y")], "a string, b string"), per, order).first()
    assert r["relation"] == winner and (r["dissent"] or {}) == dissent
    assert (r["via"] or []) == (["pB"] if winner == "SIBLING" else [])


def brute(e, a, b):
    up = {}
    for c, p in e:
        up.setdefault(c, set()).add(p)

    def above(x):
        seen, todo = set(), [x]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen - {x}

    if a == b:
        return "EXACT"
    if b in up.get(a, ()):
        return "PARENT"
    if a in up.get(b, ()):
        return "CHILD"
    if up.get(a, set()) & up.get(b, set()):
        return "SIBLING"
    return "ANCESTOR" if b in above(a) else "DESCENDANT" if a in above(b) else "UNRELATED"


@pytest.mark.parametrize("seed", [1, 2])
def test_relations_against_walking(spark, seed):
    r = random.Random(seed)
    e = sorted({(f"n{i}", f"n{r.randrange(i)}") for i in range(1, 14) for _ in range(2)})
    pairs = [(f"n{i}", f"n{j}") for i in range(16) for j in range(16)]
    out = {(x["a"], x["b"]): x["relation"] for x in relation(spark, edges(spark, *[("S", c, p) for c, p in e]), pairs).collect()}
    assert out == {p: brute(e, *p) for p in pairs}


def test_code_bridge_precedence(spark):
    wanted = spark.createDataFrame([("c1", "S"), ("c2", "S"), ("c3", "S")], "cui string, sab string")
    curated = spark.createDataFrame([("c1", "S", "new"), ("c2", "OTHER", "o")], "cui string, sab string, code string")
    cached = spark.createDataFrame([("c1", "S", "old"), ("c2", "S", "old"), ("c3", "S", "old")], "cui string, sab string, code string")
    assert rows(hierarchy.code_bridge(wanted, curated, cached), "cui", "code") == [("c1", "new"), ("c2", ""), ("c3", "old")]


def test_one_row_per_key(spark):
    d = spark.createDataFrame([("k", 1, "a", None), ("k", 2, "b", 5), ("j", 3, "c", None)], "k string, _ord int, v string, n int")
    assert rows(dedup.first_per_key(d, ["k"]), "k", "v") == [("j", "c"), ("k", "a")]
    assert rows(dedup.last_per_key(d, ["k"]), "k", "v") == [("j", "c"), ("k", "b")]
    assert rows(dedup.preferred_or_first(d, ["k"], "v", F.col("v") == "b"), "k", "v") == [("j", "c"), ("k", "b")]
    best = spark.createDataFrame([("m", "g", "Limited", 1), ("m", "g", "Definitive", 2), ("m", "g", "Definitive", 3)], "mondo_id string, symbol string, classification string, _ord int")
    assert rows(genes.best_classification(best), "mondo_id", "classification") == [("MONDO:m", "Definitive")]


def test_routes_and_components(spark):
    concepts = spark.createDataFrame([(1, "D1")], "query_id int, code string")
    treats = spark.createDataFrame([("D1", "r1")], "code string, id string")
    items = spark.createDataFrame([("both", ["r1"], "for Heart Failure patients"), ("coded", ["r1"], ""), ("prose", ["r9"], "heart failure"), ("none", ["r9"], "AR")], "item string, ids array<string>, text string")
    terms = spark.createDataFrame([(1, "heart failure"), (1, "AR")], "query_id int, term string")
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    when = spark.createDataFrame([("both", "2020-01-01"), ("coded", "2019-01-01")], "appl string, approved string")
    out = {r["query_id"]: r for r in link.two_route_lookup(q, concepts, terms, treats, items, when).collect()}
    assert [(d["item"], d["both_routes"]) for d in out[1]["drugs"]] == [("both", True), ("coded", False), ("prose", False)] and out[1]["n_one_route"] == 2
    assert out[2]["status"] == "NO_DRUGS" and out[2]["drugs"] is None
    open_ = link.two_route_lookup(q, concepts, terms, treats, items, when, resolved=F.col("query_id") == 2)
    assert rows(open_, "query_id", "status", "n_one_route") == [(1, "CONDITION_UNRESOLVED", 0), (2, "NO_DRUGS", 0)] and open_.where("drugs is not null").isEmpty()
    ends = link.two_route_ends(q, concepts, terms, treats, items, when, 2, 2)
    one = {r["query_id"]: r for r in ends.collect()}
    assert (one[1]["n_drugs"], one[1]["n_one_route"], [d["item"] for d in one[1]["first"]], [d["item"] for d in one[1]["last"]]) == (3, 2, ["both", "coded"], ["coded", "prose"])
    assert (one[2]["status"], one[2]["n_drugs"], one[2]["n_one_route"], one[2]["first"], one[2]["last"]) == ("NO_DRUGS", 0, 0, None, None)
    assert ends._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4  # tasks hand on a few rows of a query, and no list holds all
    shut = link.two_route_ends(q, concepts, terms, treats, items, when, 2, 2, resolved=F.col("query_id") == 2)
    assert rows(shut, "query_id", "status", "n_drugs", "first") == [(1, "CONDITION_UNRESOLVED", 0, None), (2, "NO_DRUGS", 0, None)]
    c = spark.createDataFrame([("1/2",), ("1",)], "key_ids string")
    assert rows(link.all_approved(c, spark.createDataFrame([("1",)], "id string")), "key_ids", "approved") == [("1", True), ("1/2", False)]


def test_many_terms_by_index(spark):
    items = spark.createDataFrame([("i", "severe hip fracture of the elderly"), ("j", "nothing here")], "item string, text string")
    terms = spark.createDataFrame([(1, "hip fracture")], "query_id int, term string").union(spark.range(2100).select(F.col("id").cast("int") + 10, F.concat(F.lit("filler term "), "id")))
    assert rows(link.text_route(terms, items), "query_id", "item") == [(1, "i")]


def test_compendium(spark):
    cells = spark.createDataFrame([("x", "1. Brilinta (ticagrelor) July 20, 2011"), ("x", "Qualified COA"), ("y", "2. Other (wrong) May 1, 2012"), ("z", "Zed (zed) May 1, 2012")], "disease string, drug_approval string")
    labels = spark.createDataFrame([("BRILINTA", "A1", "Ticagrelor"), ("Other", "A2", "right")], "brand_name string, ApplNo string, generic_name string")
    assert rows(link.brand_resolution(cells, labels).select("disease", F.coalesce("brand", F.lit("")).alias("brand"), "status"), "disease", "brand", "status") == [("x", "", "NOT_A_DRUG"), ("x", "Brilinta", "OK"), ("y", "Other", "GENERIC_MISMATCH"), ("z", "Zed", "NOT_FOUND")]


def test_approvals(spark):
    s = spark.createDataFrame([("1", "ORIG", "AP", "2012-03-01 00:00"), ("1", "ORIG", "AP", "2011-03-01"), ("1", "SUPPL", "AP", "2001-01-01"), ("2", "ORIG", "TA", "2001-01-01")], "ApplNo string, SubmissionType string, SubmissionStatus string, SubmissionStatusDate string")
    assert [(r["appl"], str(r["approved"])) for r in link.original_approvals(s).collect()] == [("1", "2011-03-01")]


def test_repoint(spark):
    d = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, v string")
    changes = spark.createDataFrame([("a", "1", "9"), ("b", "7", "9")], "k string, old string, new string")
    assert rows(link.repointed(d, changes, "k", "v"), "k", "v", "outcome") == [("a", "9", "UPDATED"), ("b", "2", "SKIPPED_OLD_VALUE_DIFFERS"), ("c", "3", "UNTOUCHED")]


def test_completeness_and_status(spark):
    d = spark.createDataFrame([("q", "a", 2), ("q", "b", 2), ("p", "a", 3), ("u", "a", None)], "k string, i string, t int")
    assert rows(quality.completeness(d, "k", "i", "t"), "k", "status") == [("p", "INCOMPLETE_RETRIEVAL"), ("q", "OK"), ("u", "INCOMPLETE_RETRIEVAL")]
    with pytest.raises(ValueError, match="rows were read"):
        quality.assert_row_parity(d, d.limit(1))


def test_catalogue_sizes_and_sets(spark):
    c = spark.createDataFrame([("C1", "a"), ("C1", "b"), ("", "x"), ("", "x"), ("", "")], "cui string, norm string")
    assert rows(link.catalog_size(c), "concepts", "names", "neither", "size") == [(1, 1, 1, 3)]
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("abb", "bc"))
    assert rows(setops.overlap_report("k", a=a, b=b), "sources", "n_keys") == [("a", 1), ("a+b", 1), ("b", 1)]


def test_lookup_of_unsettled_queries(spark):
    queries = spark.createDataFrame([(1, "", "adults", "RESOLVED_AS_TRIAL_POPULATION"), (2, None, "adults", "CONFLICT_DETECTED"), (3, "C1", "x", "RESOLVED"), (4, "C2", "y", "RESOLVED"), (5, "", "", "RESOLVED_BY_GUIDANCE")], "query_id int, cui string, normalized string, status string")
    catalog = spark.createDataFrame([("Adults", "", "adults"), ("One", "C1", "one"), ("Two", "C2", "two"), ("Open", "", "")], "condition string, cui string, norm string")
    children = spark.createDataFrame([("Adults", "a"), ("One", "b"), ("Open", "c")], "condition string, instrument string")
    out = link.catalog_lookup(queries, catalog, children)
    assert rows(out, "query_id", "key_kind", "status") == [(1, "name", "COA_FOUND"), (2, None, "CONDITION_UNRESOLVED"), (3, "cui", "COA_FOUND"), (4, "cui", "NO_COA"), (5, None, "NO_COA")]


def test_gene_resolution(spark):
    diseases = spark.createDataFrame([("ORPHA:1", "FOXG1 syndrome", "Disease"), ("2", "Wide", "Disease"), ("3", "Sub", "Etiological subtype"), ("4", "Empty", None)], "orpha_id string, name string, disorder_type string")
    parents = spark.createDataFrame([(f"c{i}", "2") for i in range(4)], "child string, parent string")
    g = spark.createDataFrame([("1", "FOXG1", genes.CAUSATIVE[0], 1), *[(f"c{i}", f"G{i}", genes.CAUSATIVE[0], i) for i in range(4)]], "orpha_id string, symbol string, assoc_type string, _ord int")
    chain = spark.createDataFrame([("9", "Z")], "orpha_id string, symbol string")
    mondo, clingen = spark.createDataFrame([("2", "7")], "orpha_id string, mondo_id string"), spark.createDataFrame([("MONDO:7", "G1", "Moderate", 1)], "mondo_id string, symbol string, classification string, _ord int")
    out = {r["orpha_id"]: r for r in genes.resolve_diseases(diseases, parents, g, None, chain, mondo, clingen).collect()}
    assert (out["1"]["disease_class"], out["1"]["gene_confidence"], out["1"]["resolution_status"], out["1"]["gene_source"]) == ("MONOGENIC", "CONFIRMED", "RESOLVED", "orphadata_genes")
    assert (out["2"]["disease_class"], out["2"]["gene_set"], out["2"]["gene_confidence"], out["2"]["primary_gene"]) == ("HETEROGENEOUS", ["G0", "G1", "G2", "G3"], "HIGH", None)
    assert out["3"]["is_subtype"] and out["3"]["resolution_status"] == "GENE_NOT_RESOLVED" and out["4"]["disease_class"] == "UNKNOWN"


@pytest.mark.parametrize(
    ("kind", "direct", "other", "chain", "want"),
    [
        ("Disease", "AB", "", "", (["A"], "A", "orphadata_genes", "CONFLICT_DETECTED", True, False)),
        ("Disease", "A", "", "", (["A"], "A", "orphadata_genes", "HIGH_CONFIDENCE", True, False)),
        ("Disease", "", "B", "Z", (["Z"], "Z", "omim_chain", "HIGH_CONFIDENCE", True, False)),
        ("Clinical group", "BA", "", "", (["A", "B"], None, "orphadata_gene_family", "HIGH_CONFIDENCE", True, True)),
        ("Clinical group", "", "", "Z", ([], None, None, "MODERATE_CONFIDENCE", False, False)),
        ("Clinical subtype", "BA", "", "", (["B", "A"], None, "orphadata_genes_phenocopy", "HIGH_CONFIDENCE", False, False)),
        ("Clinical subtype", "", "", "Z", (["Z"], "Z", "omim_chain_phenocopy", "HIGH_CONFIDENCE", False, False)),
        ("Clinical syndrome", "A", "B", "", (["A", "B"], None, "orphadata_genes_syndromic", "HIGH_CONFIDENCE", False, False)),
        ("Something new", "A", "", "Z", ([], None, None, "GENE_NOT_RESOLVED", False, False)),
    ],
)
def test_gene_sets_by_class(spark, kind, direct, other, chain, want):
    g = [("1", x, genes.CAUSATIVE[0], i) for i, x in enumerate(direct)] + [("1", x, "Role in the phenotype of", 9) for x in other]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    none = frame([], "mondo_id string, symbol string, classification string, _ord int")
    args = (frame([], "child string, parent string"), frame(g, "orpha_id string, symbol string, assoc_type string, _ord int"), None, frame([("1", x) for x in chain], "orpha_id string, symbol string"), frame([], "orpha_id string, mondo_id string"), none)
    r = genes.resolve_diseases(frame([("1", "name", kind)], "orpha_id string, name string, disorder_type string"), *args).first()
    assert (r["gene_set"], r["primary_gene"], r["gene_source"], r["resolution_status"], r["gene_identified"], r["is_polygenic"]) == want
    lost = genes.resolve_diseases(frame([("1", "name", kind, False)], "orpha_id string, name string, disorder_type string, found boolean"), *args).first()
    assert lost["resolution_status"] == "NOMENCLATURE_NO_LOCAL_MATCH"


TRIAL = "nct_id string, title string, status string, phases array<string>, start_date string, sponsor string, conditions array<string>, interventions array<struct<type:string,name:string>>, primary_outcomes array<struct<measure:string>>, secondary_outcomes array<struct<measure:string>>, other_outcomes array<struct<measure:string>>"


@pytest.fixture(scope="module")
def trials(spark):
    m = lambda *x: [(v,) for v in x]
    return spark.createDataFrame(
        [
            ("NCT00000001", "t", "DONE", ["PHASE3"], "2020", "S1", ["hf"], [("DRUG", "a"), ("DRUG", "placebo")], m("Change from baseline in KCCQ at week 12"), m("Adverse events"), m()),
            ("NCT00000002", "t", "DONE", ["PHASE2"], "2021", "S1", ["hf"], [("DRUG", "a"), ("DRUG", "b")], m("death"), m("kccq score", "6MWT"), m()),
            ("NCT00000003", "t", "DONE", [], "2021", "S2", ["hf"], [("DEVICE", "c")], m("other"), m(), m("KCCQ")),
        ],
        TRIAL,
    )


def test_usage(spark, trials):
    asked = spark.createDataFrame([("KCCQ",), ("NEVER",)], "instrument string")
    out = usage.usage(asked, usage.using(trials, asked))
    assert rows(out, "instrument", "trials", "as_primary", "secondary_only", "top_sponsors", "status") == [("KCCQ", 2, 1, 1, "S1(2)", "OK"), ("NEVER", 0, 0, 0, "", "NO_TRIALS")]
    resolved = spark.createDataFrame([("a", "A", "1"), ("b", "B", "2")], "item string, key_names string, key_ids string")
    assert rows(usage.cooccurring_drugs(trials, asked, resolved), "instrument", "drug", "trials") == [("KCCQ", "A", 2), ("KCCQ", "B", 1)]
    part = spark.createDataFrame([("a", "A", "1", "RESOLVED"), ("b", None, None, "UNRESOLVED_NOT_IN_RXNORM"), ("placebo", "P", "3", "RESOLVED")], "item string, key_names string, key_ids string, status string")
    assert rows(usage.cooccurring_drugs(trials, asked, part), "instrument", "drug", "in_vocabulary", "trials") == [("KCCQ", "A", True, 2), ("KCCQ", "b", False, 1)]
    assert rows(usage.cooccurring_drugs(trials, asked, part, spark.createDataFrame([("1", True), ("", True)], "key_ids string, approved boolean")), "drug") == [("A",)]
    lists = spark.createDataFrame([("Kansas City Questionnaire (KCCQ)", "qualified", 0, 1), ("6MWT", "listed", 1, 2)], "label string, category string, list_rank int, _ord int")
    found = usage.canonical_measures(usage.outcomes(trials), lists)
    assert ("Kansas City Questionnaire (KCCQ)", "qualified", 1, 1, 2, 2) in rows(found, "instrument", "category", "as_primary", "as_secondary", "trials", "n_variants")
    assert ("Adverse events", "other", 0) in rows(found, "instrument", "category", "n_variants")
    # Safety outcomes are held against the first list only; variants are cleaned measures that differ from the name.
    guarded = spark.createDataFrame([("events", "qualified", 1, 1), ("6MWT", "listed", 0, 2)], "label string, category string, list_rank int, _ord int")
    out = {r["instrument"]: r for r in usage.canonical_measures(usage.outcomes(trials), guarded).collect()}
    assert out["Adverse events"]["category"] == "other" and (out["6MWT"]["list_rank"], out["6MWT"]["variants"]) == (0, [])
    assert [r["instrument"] for r in usage.ranked_measures(found).collect()][:2] == ["Kansas City Questionnaire (KCCQ)", "6MWT"]
    b = spark.createDataFrame([(1, True, []), (2, False, [(0,)]), (3, None, [(0,), (2,)]), (4, None, None)], "id int, qualified boolean, instruments array<struct<trials:int>>")
    assert rows(usage.shown(b), "id") == [(1,), (3,)]


def test_facets(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "y")], "p string, q string")
    assert rows(facets.facet_counts(d, "p", "q").select("facet", F.coalesce("value", F.lit("-")).alias("value"), "n"), "facet", "value", "n") == [("p", "-", 1), ("p", "a", 2), ("q", "x", 1), ("q", "y", 2)]


def test_batch(spark, vocabulary, trials):
    catalog = spark.createDataFrame([("Hip Fracture", "C1", "hip fracture"), ("Alpha", "C10", "alpha disease")], "condition string, cui string, norm string")
    children = spark.createDataFrame([("Hip Fracture", "Kansas (KCCQ) Form", "s", True), ("Alpha", "Alpha Diary", "s", False)], "condition string, instrument string, stage string, qualified boolean")
    e = edges(spark, ("S", "1", "0"), ("S", "5", "0"), ("S", "10", "0"))
    codes = spark.createDataFrame([("C1", "S", "1"), ("C5", "S", "5"), ("C10", "S", "10")], "cui string, sab string, code string")
    s = batch.Sources(*vocabulary, catalog, children, codes, e, spark.createDataFrame([("S", 0)], "sab string, source_order int"), trials)
    out = batch.run(spark.createDataFrame([(1, "hip fracture"), (2, "breast cancer"), (3, "nothing")], "query_id int, query string"), s)
    assert rows(out["catalog"], "query_id", "status") == [(1, "COA_FOUND"), (2, "NO_COA"), (3, "CONDITION_UNRESOLVED")]
    assert rows(out["neighbours"], "query_id", "condition", "relation") == [(2, "Alpha", "SIBLING"), (2, "Hip Fracture", "SIBLING")]
    assert {r["query_id"]: r["steps"]["neighbours"]["status"] for r in out["summary"].collect()} == {1: "NOT_NEEDED", 2: "NEIGHBORS_FOUND", 3: "NO_HIERARCHY"}
    said = {r["query_id"]: r for r in out["assembled"].collect()}
    assert [(said[i]["n_coas"], said[i]["has_qualified_coa"], said[i]["gap"]) for i in (1, 2, 3)] == [(1, True, False), (0, False, False), (0, False, False)]
    assert [x["condition"] for x in said[2]["nearby"]] == ["Alpha", "Hip Fracture"] and said[1]["nearby"] is None and said[3]["nearby"] == []


def test_sources(spark, tmp_path):
    assert files.read_csv(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    (tmp_path / "c.csv").write_text('a,b\n"x ""q"" y","l1\nl2"\n')
    assert files.read_csv(spark, str(tmp_path / "c.csv"), "a string, b string").collect()[0]["a"] == 'x "q" y'
    line = lambda cui, aui, sab, code, s: "|".join([cui, "ENG", "", "", "", "", "", aui, "", "", "", sab, "", code, s, "", "", ""]) + "|\n"
    (tmp_path / "conso").write_text(line("C1", "A1", "MSH", "D1", "one") + line("C1", "A2", "MSH", "D2", "two") + line("C2", "A3", "MSH", "D3", "three"))
    a = files.atoms(spark, str(tmp_path / "conso"), ("MSH",))
    assert rows(files.first_codes(a), "cui", "code") == [("C1", "D1"), ("C2", "D3")]
    tree = spark.createDataFrame([("A1", "A3", "MSH"), ("A2", "A2", "MSH")], "aui string, paui string, sab string")
    assert rows(files.edges_from_atoms(tree, a), "child", "parent") == [("D1", "D3")]
    (tmp_path / "codes.txt").write_text("A000    Cholera\nC441021 Long name\n")
    assert rows(files.read_code_list(spark, str(tmp_path / "codes.txt")), "code", "code_dotted", "name") == [("A000", "A00.0", "Cholera"), ("C441021", "C44.1021", "Long name")]
    (tmp_path / "m.json").write_text(json.dumps({"graphs": [{"nodes": [{"id": "http://o/MONDO_1", "lbl": "a", "type": "CLASS", "meta": {"synonyms": [{"pred": "hasExactSynonym", "val": "s"}], "xrefs": [{"val": "MESH:D1"}]}}, {"id": "http://o/MONDO_2", "lbl": "b", "type": "CLASS", "meta": {"deprecated": True}}], "edges": [{"sub": "http://o/MONDO_1", "pred": "is_a", "obj": "http://o/MONDO_3"}]}]}))
    n = files.ontology_nodes(spark, str(tmp_path / "m.json"))
    assert rows(n, "id", "label", "exact_synonyms") == [("MONDO:1", "a", ["s"])]
    assert rows(files.ontology_edges(spark, str(tmp_path / "m.json")), "child", "parent") == [("MONDO:1", "MONDO:3")]
    (tmp_path / "x.xml").write_text("<r><rec><id>1</id><t><n>C01</n><n>A1</n></t></rec><rec><id>2</id><t><n>B1</n></t></rec></r>")
    x = files.read_xml(spark, str(tmp_path / "x.xml"), "rec", "id string, t struct<n:array<string>>").select("id", F.col("t.n").alias("tree_numbers"))
    assert rows(files.disease_records(x), "id") == [("1",)]
    (tmp_path / "pre.csv").write_text("note\nmore\nGENE,ID\ng1,1\ng2,2\n")
    assert rows(files.read_after_preamble(spark, str(tmp_path / "pre.csv"), "GENE", ["gene", "id"]), "gene", "id") == [("g1", "1"), ("g2", "2")]
    html = spark.createDataFrame([('<a href="/a"><b>One</b> x</a><A class=q href=\'/b\'>Two</A>',)], "html string")
    assert rows(files.links(html), "link", "label") == [("/a", "One x"), ("/b", "Two")]


def test_paged_source(spark, tmp_path):
    study = {"protocolSection": {"identificationModule": {"nctId": "NCT00000001"}, "outcomesModule": {"primaryOutcomes": [{"measure": "m"}]}}}
    for i, s in enumerate(([study, study], [study])):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"studies": s, "totalCount": 3, "nextPageToken": "t"}))
    spark.dataSource.register(pages.PagedFacts)
    for df in (spark.read.format("paged_facts").load(str(tmp_path)), pages.read_pages(spark, str(tmp_path))):
        assert rows(df, "page", "pos", "total") == [(0, 0, 3), (0, 1, 3), (1, 0, 3)]
        flat = pages.trial_records(df)
        assert rows(usage.unique_trials(flat), "nct_id", "page", "pos") == [("NCT00000001", 0, 0)]


def test_streams(spark, tmp_path):
    from linkspan.streaming import facts

    src = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:20:00", "a", 2.0)], "id int, ts string, k string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    schema = "id int, ts timestamp, k string, value double"
    once = facts.each_once(facts.page_stream(spark, str(src), schema), "id", "ts")
    q = once.groupBy("k").agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName("t_once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("t_once"), "k", "n") == [("a", 2)]
    for _ in range(2):
        facts.resumable_build(facts.page_stream(spark, str(src), schema), "id", str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df.select("id", F.lit("done").alias("r"))).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id") == [(1,), (2,)]


@pytest.mark.parametrize("n", [12_000, 60_000])
def test_every_gauge_has_its_band(spark, n):
    gauges = spark.range(n).select(F.col("id").cast("string").alias("gauge"))
    out = quality.over_band(gauges.withColumn("rate", F.lit(0.5)), gauges.withColumn("band", F.lit(0.2)))
    assert out.count() == n and out.where("band is null or not over_band").count() == 0


# ---- texts and terms, near names, deep hierarchies ----------------------------------------------------------------------
def _words(rng, n, letters="abcde", least=1, most=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(least, most))) for _ in range(n)]


def test_containing_by_grams(spark):
    import random

    rng = random.Random(4)
    terms = sorted(set(_words(rng, 400)) | {"", "zz", "ü\U0001f600x"})
    texts = [(i, " ".join(_words(rng, rng.randrange(0, 12)))) for i in range(200)] + [(900, None), (901, ""), (902, "aü\U0001f600xb"), (902, "zz")]
    out = meet.containing(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([(t,) for t in terms], "term string"))
    want = {(i, w) for i, t in texts for w in terms if w and t is not None and w in t}
    assert len(terms) > meet.FEW and {(r["key"], r["term"]) for r in out.collect()} == want
    few = meet.containing(spark.createDataFrame(texts, "id long, t string"), "id", "t", spark.createDataFrame([(t,) for t in terms[:50]], "term string"))
    assert {(r["key"], r["term"]) for r in few.collect()} == {(i, w) for i, w in want if w in terms[:50]}


def test_near_names_are_all_found(spark):
    import random

    rng = random.Random(7)
    names = sorted(set(_words(rng, 150, "abcdefgh", 3, 24)) | {"ibuprofen", "acetaminophen"})
    texts = ["ubuprofen", "aectaminophen", "ibuprofen", "x"]
    for n in names[:120]:
        t = list(n)
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randrange(2)] = rng.choice(["", "z", "q"])
        texts.append("".join(t))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    out = resolve.near_names(spark.createDataFrame([(t,) for t in set(texts)], "t string"), spark.createDataFrame([(n, n.upper()) for n in names], "k string, id string"), 0.85)
    got = {(r["t"], r["k"]): r["far"] for r in out.collect()}
    want = {(t, k): distance(t, k) for t in texts for k in names if min(len(t), len(k)) >= 4 and distance(t, k) <= int(0.15 * max(len(t), len(k)) + 0.5)}
    assert got == want and {("ubuprofen", "ibuprofen"), ("aectaminophen", "acetaminophen")} <= set(got)
    items = resolve.resolve_items(spark.createDataFrame([("ubuprofen",), ("aectaminophen 20 mg",)], "item string"), spark.createDataFrame([(n, n) for n in names], "name string, rxcui string"), spark.createDataFrame([], "rxcui string, ingredient_rxcui string, ingredient string"))
    assert {r["item"]: (r["rxcui"], r["match_step"]) for r in items.collect()} == {"ubuprofen": ("ibuprofen", "approximate"), "aectaminophen 20 mg": ("acetaminophen", "approximate")}
    assert resolve.near_names(spark.createDataFrame([("abc",)], "t string"), spark.createDataFrame([("abc", "1")], "k string, id string"), 0.85).count() == 0


def test_closure_of_long_chains(spark):
    edges = spark.createDataFrame([("S", f"n{i}", f"n{i + 1}") for i in range(70)] + [("S", "n70", "n60")], "sab string, child string, parent string")
    up = hierarchy.closure(edges, spark.createDataFrame([("S", "n0")], "sab string, node string"))
    assert {r["ancestor"]: r["depth"] for r in up.collect()} == {f"n{i}": i for i in range(1, 71)}


def _many_instruments(n=60_000):
    return [(f"scale number {i:06} of all",) for i in range(n)]


def test_many_names_meet_without_a_product(spark):
    """60,000 names: no plan holds every text against every name, and the answers are those of the few-names way."""
    measure = lambda *m: [{"measure": x} for x in m]
    kind = "array<struct<measure:string>>"
    rows = [(f"NCT{i:08}", "t", "s", ["P"], "d", "x", ["c"], [{"type": "DRUG", "name": f"drug{i}"}], measure(f"Change in Scale number {i:06} of all at week 2"), measure("other", f"SCALE NUMBER {i + 1:06} OF ALL"), measure(f"scale number {i + 2:06} of all")) for i in range(40)]
    trials = spark.createDataFrame(rows, f"nct_id string, title string, status string, phases array<string>, start_date string, sponsor string, conditions array<string>, interventions array<struct<type:string,name:string>>, primary_outcomes {kind}, secondary_outcomes {kind}, other_outcomes {kind}")
    many, few = spark.createDataFrame(_many_instruments(), "instrument string"), spark.createDataFrame(_many_instruments(50), "instrument string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    short = lambda df: sorted((r["instrument"], r["nct_id"], r["as_primary"]) for r in df.select("instrument", "nct_id", "as_primary").collect())
    used = usage.using(trials, many)
    assert "CartesianProduct" not in plan(used) and "NestedLoop" not in plan(used) and short(used) == short(usage.using(trials, few))
    resolved = trials.select(F.explode("interventions").alias("i")).select(F.col("i.name").alias("item")).select("item", F.col("item").alias("key_names"), F.col("item").alias("key_ids"))
    drugs = [sorted(map(tuple, usage.cooccurring_drugs(trials, names, resolved).collect())) for names in (many, few)]
    assert drugs[0] == drugs[1] and len(drugs[0]) == 40 + 40 + 40
    stream = usage.outcomes(trials)
    lists = lambda names: names.select(F.col("instrument").alias("label"), F.lit("c").alias("category"), F.lit(0).alias("list_rank"), F.substring("instrument", 14, 6).cast("int").alias("_ord"))
    rolled = usage.canonical_measures(stream, lists(many))
    assert "CartesianProduct" not in plan(rolled) and "NestedLoop" not in plan(rolled)
    assert sorted(map(str, rolled.collect())) == sorted(map(str, usage.canonical_measures(stream, lists(few)).collect()))
    items = spark.createDataFrame([(f"a{i}", f"for scale number {i:06} of all, or none") for i in range(30)], "appl string, indication_text string")
    dates = items.select("appl", F.lit("2020-01-01").cast("date").alias("approved"))
    terms = lambda names: names.select(F.col("instrument").alias("condition"), F.upper("instrument").alias("term"), F.lit(0).alias("_ord"))
    since = link.approved_since(items, dates, terms(many), "2019-01-01")
    assert "CartesianProduct" not in plan(since) and "NestedLoop" not in plan(since)
    assert sorted(map(str, since.collect())) == sorted(map(str, link.approved_since(items, dates, terms(few), "2019-01-01").collect())) and since.count() == 30


def test_word_overlap_both_ways(spark, monkeypatch):
    import random

    rng = random.Random(9)
    vocabulary = [f"{a}{b}word{c}" for a in "abc" for b in "xyz" for c in range(6)] + ["longwordinside", "wordinside"]
    names = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6)))) for i in range(120)] + [(500, "twice1 twice1"), (501, None), (502, "tiny set of a few")]
    blobs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))) for i in range(80)] + [(900, "twice1"), (901, None), (902, "prelongwordinsidepost xtwice1x")]
    n, b = spark.createDataFrame(names, "name_id long, name string"), spark.createDataFrame(blobs, "blob_id long, blob string")
    rows = lambda: sorted(map(tuple, link.word_overlap(n, b, "name", "blob").collect()))
    by_words = rows()
    monkeypatch.setattr(link, "FEW", 10_000)
    assert len(names) > meet.FEW and by_words == rows() and len(by_words) > 50


def test_shared_folder(spark, monkeypatch):
    from linkspan import session

    assert session.scratch(spark, "x") != session.scratch(spark, "x") and session.scratch(spark, "x").startswith(spark.sparkContext.getCheckpointDir())

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="share"):
        session.shared_folder(Session())
