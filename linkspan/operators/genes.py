"""Diseases and genes: classes, gene sets by strategy, and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import symbol_in_name
from ..functions.text import bare_id, prefixed_id

# ---- fixed values -------------------------------------------------------------------------------------------------------
TYPE_CLASS = {
    "Disease": "MONOGENIC_OR_HETEROGENEOUS",
    "Etiological subtype": "PHENOCOPY",
    "Clinical subtype": "PHENOCOPY",
    "Histopathological subtype": "PHENOCOPY",
    "Morphological anomaly": "PHENOCOPY",
    "Malformation syndrome": "SYNDROMIC",
    "Clinical syndrome": "SYNDROMIC",
    "Clinical group": "HETEROGENEOUS",
    "Category": "HETEROGENEOUS",
    "Biological anomaly": "PATHWAY_DISORDER",
    "Particular clinical situation in a disease or syndrome": "UNKNOWN",
}
CLASS_STRATEGY = {
    "MONOGENIC": "SINGLE_GENE",
    "HETEROGENEOUS": "GENE_FAMILY",
    "SYNDROMIC": "SYNDROMIC_MANIFESTATION",
    "PHENOCOPY": "PHENOCOPY_EXCLUDED",
    "PREDISPOSITION": "SINGLE_GENE",
    "PATHWAY_DISORDER": "GENE_FAMILY",
    "UNKNOWN": "UNKNOWN",
}
CAUSATIVE = ("Disease-causing germline mutation(s) in", "Disease-causing germline mutation(s) (loss of function) in")
PRIORITY = {"Definitive": 4, "Strong": 3, "Moderate": 2, "Limited": 1}
#: More distinct genes than this among the children make a disease heterogeneous.
DIVERSE = 3
NOT_LISTED = "Not in ClinGen"
# -------------------------------------------------------------------------------------------------------------------------


def _look_up(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key), F.lit(default))


def best_classification(clingen: DataFrame) -> DataFrame:
    """mondo_id, symbol, classification of highest priority; of equals the first."""
    p = _look_up(PRIORITY, F.col("classification"), 0)
    return clingen.groupBy(prefixed_id(F.col("mondo_id"), "MONDO").alias("mondo_id"), "symbol").agg(F.max_by("classification", F.struct(p, -F.col("_ord"))).alias("classification"))


def genes_of(genes: DataFrame, approved: DataFrame | None, causative_only: bool) -> DataFrame:
    """orpha_id, symbol, _ord: approved symbols only (an empty or missing list approves all), each once at its first place."""
    rows = genes.where(F.col("assoc_type").isin(*CAUSATIVE)) if causative_only else genes
    if approved is not None and not approved.isEmpty():
        rows = rows.join(approved.select("symbol").distinct(), "symbol", "left_semi")
    return rows.groupBy("orpha_id", "symbol").agg(F.min("_ord").alias("_ord"))


def gene_family(parents: DataFrame, causative: DataFrame) -> DataFrame:
    """orpha_id, symbol of a disease and its children."""
    below = parents.select(F.col("parent").alias("orpha_id"), F.col("child").alias("member"))
    own = causative.select("orpha_id", "symbol")
    return own.union(below.join(own.withColumnRenamed("orpha_id", "member"), "member").select("orpha_id", "symbol")).distinct()


def omim_chain(orpha_omim: DataFrame, mim2gene: DataFrame, hgnc: DataFrame) -> DataFrame:
    """orpha_id, symbol: the first OMIM id in order that leads to a gene with a symbol; of several symbols of that id the least."""
    chain = orpha_omim.join(mim2gene.select("omim_id", "gene_id"), "omim_id").join(hgnc.select(F.col("entrez_id").alias("gene_id"), "symbol"), "gene_id")
    return chain.groupBy("orpha_id").agg(F.min_by("symbol", F.struct("_ord", "symbol")).alias("symbol"))


def confidence(classes: Column) -> Column:
    """Of an array of classifications (null or empty: no genes)."""
    return (
        F.when(F.coalesce(F.size(classes), F.lit(0)) <= 0, "NONE")
        .when(F.array_contains(classes, "Definitive"), "CONFIRMED")
        .when(F.arrays_overlap(classes, F.array(F.lit("Strong"), F.lit("Moderate"))), "HIGH")
        .otherwise("LOW")
    )


def resolve_diseases(diseases: DataFrame, parents: DataFrame, genes: DataFrame, approved: DataFrame | None, chain: DataFrame, mondo: DataFrame, clingen: DataFrame) -> DataFrame:
    """One row per disease: orpha_id, preferred_name, disease_class, strategy, is_subtype, gene_set, primary_gene, gene_source,
    gene_confidence, conflict_detected, resolution_status, gene_identified, is_polygenic.

    diseases: orpha_id, name, disorder_type and, where the nomenclature may lack some, found; mondo: orpha_id, mondo_id. A disease
    whose children carry more than three distinct causative genes is heterogeneous. The set is, by class: the first causative gene
    (monogenic, predisposition; more than one is a conflict), the sorted genes of the disease and its children (heterogeneous,
    pathway), all causative genes (phenocopy), all genes (syndromic). Where that is empty the chain's gene stands in, but not for
    families; unknown classes have no genes. Only one-gene classes and phenocopies with one gene name a primary gene.
    """
    found = F.coalesce("found", F.lit(True)) if "found" in diseases.columns else F.lit(True)
    rows = diseases.select(bare_id(F.col("orpha_id"), "ORPHA").alias("orpha_id"), "name", F.nullif("disorder_type", F.lit("")).alias("disorder_type"), found.alias("found"))
    causative, any_ = genes_of(genes, approved, True), genes_of(genes, approved, False)
    below = parents.select(F.col("parent").alias("orpha_id"), F.col("child").alias("member")).join(causative.select(F.col("orpha_id").alias("member"), "symbol"), "member")
    diverse = below.groupBy("orpha_id").agg((F.count_distinct("symbol") > DIVERSE).alias("diverse"))
    rows = rows.join(diverse, "orpha_id", "left")
    kind = _look_up(TYPE_CLASS, F.col("disorder_type"), "UNKNOWN")
    kind = F.when(kind == "MONOGENIC_OR_HETEROGENEOUS", F.when(F.coalesce("diverse", F.lit(False)), "HETEROGENEOUS").otherwise("MONOGENIC")).otherwise(kind)
    rows = rows.withColumn("disease_class", F.when(F.col("disorder_type").isNull(), "UNKNOWN").otherwise(kind)).withColumn("strategy", _look_up(CLASS_STRATEGY, F.col("disease_class"), "UNKNOWN"))

    listed = lambda df, name: df.groupBy("orpha_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_ord", "symbol"))), lambda x: x["symbol"]).alias(name))
    family = gene_family(parents, causative).groupBy("orpha_id").agg(F.sort_array(F.collect_set("symbol")).alias("family"))
    rows = rows.join(listed(causative, "direct"), "orpha_id", "left").join(listed(any_, "any"), "orpha_id", "left").join(family, "orpha_id", "left").join(chain.select("orpha_id", F.col("symbol").alias("chain")), "orpha_id", "left")
    c = F.col("disease_class")
    one, many, copy, syndrome = c.isin("MONOGENIC", "PREDISPOSITION"), c.isin("HETEROGENEOUS", "PATHWAY_DISORDER"), c == "PHENOCOPY", c == "SYNDROMIC"
    own = F.when(one, F.slice("direct", 1, 1)).when(many, F.col("family")).when(copy, F.col("direct")).when(syndrome, F.col("any"))
    chained = own.isNull() & (one | copy | syndrome) & F.col("chain").isNotNull()
    rows = rows.withColumn("gene_set", F.coalesce(own, F.when(chained, F.array("chain")), F.array().cast("array<string>")))
    ending = F.when(copy, "_phenocopy").when(syndrome, "_syndromic").otherwise("")
    source = F.when(chained, F.concat(F.lit("omim_chain"), ending)).when(own.isNotNull(), F.when(many, "orphadata_gene_family").otherwise(F.concat(F.lit("orphadata_genes"), ending)))
    primary = F.when(one | (copy & (F.size("gene_set") == 1)), F.get("gene_set", F.lit(0)))
    conflict = one & (F.coalesce(F.size("direct"), F.lit(0)) > 1)
    rows = rows.withColumns({"gene_source": source, "primary_gene": primary, "conflict_detected": conflict})

    classes = rows.select("orpha_id", F.explode("gene_set").alias("symbol")).join(mondo.select("orpha_id", prefixed_id(F.col("mondo_id"), "MONDO").alias("mondo_id")), "orpha_id", "left")
    classes = classes.join(best_classification(clingen), ["mondo_id", "symbol"], "left").groupBy("orpha_id").agg(F.collect_set(F.coalesce("classification", F.lit(NOT_LISTED))).alias("classes"))
    rows = rows.join(classes, "orpha_id", "left")
    told = confidence(F.col("classes"))
    rows = rows.withColumn("gene_confidence", F.when((told == "LOW") & F.col("primary_gene").isNotNull() & symbol_in_name(F.col("primary_gene"), F.col("name")), "CONFIRMED").otherwise(told))
    some, sure = F.size("gene_set") > 0, F.col("gene_confidence").isin("CONFIRMED", "HIGH")
    status = (
        F.when(~F.col("found"), "NOMENCLATURE_NO_LOCAL_MATCH").when(F.col("conflict_detected"), "CONFLICT_DETECTED").when(some & sure, "RESOLVED")
        .when(some, "HIGH_CONFIDENCE").when(many, "MODERATE_CONFIDENCE").otherwise("GENE_NOT_RESOLVED")
    )
    identified = sure | ((F.col("gene_confidence") == "LOW") & (((c == "MONOGENIC") & F.col("primary_gene").isNotNull()) | (many & some)))
    subtype = F.coalesce(F.col("disorder_type").isin(*[k for k, v in TYPE_CLASS.items() if v == "PHENOCOPY"]), F.lit(False))
    return rows.select(
        "orpha_id", F.col("name").alias("preferred_name"), "disease_class", "strategy", subtype.alias("is_subtype"), "gene_set", "primary_gene", "gene_source",
        "gene_confidence", "conflict_detected", status.alias("resolution_status"), identified.alias("gene_identified"), (many & (F.size("gene_set") > 1)).alias("is_polygenic"),
    )
