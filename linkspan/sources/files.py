"""Readers and writers of the file formats that tables come in. Schemas are declared, never inferred; codes stay strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import disease_branch, pdf_magic
from ..functions.text import dotted_code, iri_to_curie, listed, safe_name, without_tags

# ---- fixed values -------------------------------------------------------------------------------------------------------
#: Columns of the positional concept and hierarchy files.
MRCONSO = "CUI LAT TS LUI STT SUI ISPREF AUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF".split()
MRHIER = "CUI AUI CXN PAUI SAB RELA PTR HCD CVF".split()
ISA, FULL_NAME = "116680003", "900000000000003001"
# -------------------------------------------------------------------------------------------------------------------------


def strings(*names: str) -> str:
    return ", ".join(f"`{n}` string" for n in names)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store the session reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", **options) -> DataFrame:
    """A table with a header; a missing file is an empty table. Cells may hold line breaks and doubled quotes."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.csv(path, schema=schema, header=True, sep=sep, multiLine=True, escape='"', mode="PERMISSIVE", **options)


def read_dynamic(spark: SparkSession, *paths: str) -> DataFrame:
    """Tables with a header whose columns are not known before, all of them strings; a column that a path lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.csv(p, header=True, inferSchema=False, multiLine=True, escape='"') for p in paths])


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, is_pdf (by the first bytes) of the files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("size"), pdf_magic(F.col("content")).alias("is_pdf"))


def to_fetch(wanted: DataFrame, there: DataFrame, name: str) -> DataFrame:
    """What is not stored yet."""
    return wanted.join(there.select(name).distinct(), name, "left_anti")


def read_tsv_keys(spark: SparkSession, path: str, schema: str, *keys: str) -> DataFrame:
    """Keys of a tab-separated table, empty first keys dropped."""
    return read_csv(spark, path, schema, sep="\t").select(*[F.trim(k).alias(k) for k in keys]).where(F.col(keys[0]) != "")


def read_positional(spark: SparkSession, path: str, names: list[str], sep: str = "|") -> DataFrame:
    """Rows without a header and with a separator at the end; pruned to the columns that are used."""
    return spark.read.csv(path, schema=strings(*names, "_end"), sep=sep, quote="", header=False).drop("_end")


def atoms(spark: SparkSession, path: str, sources: tuple[str, ...] | None = None, language: str = "ENG") -> DataFrame:
    """Cui, sab, code, aui, str, _ord of one language's atoms."""
    rows = read_positional(spark, path, MRCONSO).where(F.col("LAT") == language)
    rows = rows.where(F.col("SAB").isin(*sources)) if sources else rows
    return rows.select(F.col("CUI").alias("cui"), F.col("SAB").alias("sab"), F.col("CODE").alias("code"), F.col("AUI").alias("aui"), F.col("STR").alias("str"), F.monotonically_increasing_id().alias("_ord"))


def first_codes(atoms_: DataFrame) -> DataFrame:
    """Cui, sab and the first code of a concept in a source."""
    return atoms_.groupBy("cui", "sab").agg(F.min_by("code", "_ord").alias("code"))


def all_codes(atoms_: DataFrame, sab: str) -> DataFrame:
    """Cui and the set of its codes in a source."""
    return atoms_.where(F.col("sab") == sab).groupBy("cui").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def edges_from_atoms(tree: DataFrame, atoms_: DataFrame) -> DataFrame:
    """Edges (sab, child, parent) of codes from a tree of atoms (aui, paui, sab); no self-edges, no repeats."""
    code = atoms_.groupBy("aui").agg(F.min_by("code", "_ord").alias("code"))
    child = tree.join(code.withColumnRenamed("code", "child"), "aui")
    return child.join(code.select(F.col("aui").alias("paui"), F.col("code").alias("parent")), "paui").where("child <> parent").select("sab", "child", "parent").distinct()


def release_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated release file with a header and no quoting; all columns strings."""
    return spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)


def isa_edges(relationships: DataFrame, sab: str = "SNOMEDCT_US") -> DataFrame:
    """Active is-a rows as edges."""
    return relationships.where((F.col("active") == "1") & (F.col("typeId") == ISA)).select(F.lit(sab).alias("sab"), F.col("sourceId").alias("child"), F.col("destinationId").alias("parent")).distinct()


def defined_codes(relationships: DataFrame, sab: str = "SNOMEDCT_US") -> DataFrame:
    """Codes with an active attribute that is not is-a."""
    return relationships.where((F.col("active") == "1") & (F.col("typeId") != ISA)).select(F.lit(sab).alias("sab"), F.col("sourceId").alias("code")).distinct()


def preferred_names(descriptions: DataFrame) -> DataFrame:
    """Code, name: the full name, else the first active term."""
    rows = descriptions.where(F.col("active") == "1").withColumn("_ord", F.monotonically_increasing_id())
    pick = F.coalesce(F.max_by("term", F.when(F.col("typeId") == FULL_NAME, F.col("_ord"))), F.min_by("term", "_ord"))
    return rows.groupBy(F.col("conceptId").alias("code")).agg(pick.alias("name"))


def node_index(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Code, name, sorted parents and children of every code with an edge."""
    up = edges.groupBy(F.col("child").alias("code")).agg(F.sort_array(F.collect_set("parent")).alias("parents"))
    down = edges.groupBy(F.col("parent").alias("code")).agg(F.sort_array(F.collect_set("child")).alias("children"))
    empty = F.array().cast("array<string>")
    both = up.join(down, "code", "full").join(names, "code", "left")
    return both.select("code", "name", F.coalesce("parents", empty).alias("parents"), F.coalesce("children", empty).alias("children"))


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    """Records of an XML file."""
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def disease_records(records: DataFrame, tree: str = "tree_numbers") -> DataFrame:
    """Records with a tree number of a disease."""
    return records.where(disease_branch(F.col(tree)))


def ontology_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Live classes of an ontology graph in JSON: id, label, exact and related synonyms, definition (500 characters), xrefs."""
    schema = "graphs array<struct<nodes:array<struct<id:string,lbl:string,type:string,meta:struct<deprecated:boolean,definition:struct<val:string>,synonyms:array<struct<pred:string,val:string>>,xrefs:array<struct<val:string>>>>>,edges:array<struct<sub:string,pred:string,obj:string>>>>"
    graph = spark.read.json(path, schema=schema, multiLine=True).select(F.explode(F.slice("graphs", 1, 1)).alias("g"))
    n = graph.select(F.explode("g.nodes").alias("n")).where("n.type = 'CLASS' and coalesce(n.meta.deprecated, false) = false and n.lbl is not null")
    synonyms = lambda kind: F.transform(F.filter(F.coalesce("n.meta.synonyms", F.array().cast("array<struct<pred:string,val:string>>")), lambda s: s["pred"] == kind), lambda s: s["val"])
    return n.select(iri_to_curie(F.col("n.id")).alias("id"), F.col("n.lbl").alias("label"), synonyms("hasExactSynonym").alias("exact_synonyms"), synonyms("hasRelatedSynonym").alias("related_synonyms"), F.substring("n.meta.definition.val", 1, 500).alias("definition"), F.transform("n.meta.xrefs", lambda x: x["val"]).alias("xrefs"))


def xrefs_by_prefix(nodes: DataFrame, *prefixes: str) -> DataFrame:
    """One column of joined ids per prefix."""
    x = nodes.select("id", F.explode("xrefs").alias("x")).withColumn("p", F.substring_index("x", ":", 1))
    return x.groupBy("id").pivot("p", list(prefixes)).agg(F.array_join(F.sort_array(F.collect_set("x")), "|"))


def ontology_edges(spark: SparkSession, path: str, contains: str = "MONDO_") -> DataFrame:
    """Is-a edges between classes of the ontology, several parents kept."""
    schema = "graphs array<struct<edges:array<struct<sub:string,pred:string,obj:string>>>>"
    e = spark.read.json(path, schema=schema, multiLine=True).select(F.explode(F.slice("graphs", 1, 1)).alias("g")).select(F.explode("g.edges").alias("e"))
    return e.where((F.col("e.pred") == "is_a") & F.col("e.sub").contains(contains) & F.col("e.obj").contains(contains)).select(iri_to_curie(F.col("e.sub")).alias("child"), iri_to_curie(F.col("e.obj")).alias("parent")).distinct()


def read_code_list(spark: SparkSession, path: str) -> DataFrame:
    """Code, code_dotted, name from lines of a code, white space of any length, and a name."""
    line = r"^(\S+)\s+(.+?)\s*$"
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.regexp_extract("value", line, 1).alias("code"), F.regexp_extract("value", line, 2).alias("name")).where("code <> ''").select("code", dotted_code(F.col("code")).alias("code_dotted"), "name")


def banner_rows(raw: DataFrame, is_banner: Column, value: str, within: list[str], order: list[str]) -> DataFrame:
    """Rows of an extracted table with the last banner above them; the banners go."""
    from ..operators.dedup import forward_fill

    return forward_fill(raw.withColumn("_banner", F.when(is_banner, F.col(value))), "_banner", order, within, "banner").where(~is_banner).drop("_banner")


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with url and label of every anchor."""
    a = r"(?is)<a\b[^>]*?href=[\x22']([^\x22']*)[\x22'][^>]*>(.*?)</a>"
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(a), 1).alias("url"), F.regexp_extract_all(html, F.lit(a), 2).alias("inner"))
    return pages.withColumn("_a", F.explode(found)).select(*pages.columns, F.col("_a.url").alias("link"), without_tags(F.col("_a.inner")).alias("label"))


def file_names(rows: DataFrame, label: str, ext: str = "pdf") -> DataFrame:
    """rows with a file name made of their label."""
    return rows.withColumn("filename", F.concat(safe_name(F.col(label)), F.lit(f".{ext}")))


def codelist_items(members: DataFrame) -> DataFrame:
    """Code, items and whether a total score is declared; pointers and total scores are no items."""
    other = F.col("name").contains("Test Code Terminology") | F.col("name").contains("Test Name Terminology")
    total = F.col("name").contains("Total Score")
    return members.groupBy("code").agg(F.sort_array(F.collect_list(F.when(~other & ~total, F.col("name")))).alias("items"), F.bool_or(total).alias("has_total_score"))


def read_after_preamble(spark: SparkSession, path: str, header: str, names: list[str]) -> DataFrame:
    """A CSV with lines before its header: the rows after the first line that begins so. Lines carry their place in the file."""
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.posexplode(F.split("value", r"\r?\n"))).toDF("at", "line")
    start = lines.where(F.col("line").startswith(header)).agg(F.min("at").alias("start"))
    body = lines.crossJoin(F.broadcast(start)).where("at > start and line <> ''")
    parsed = F.from_csv("line", F.lit(strings(*names)))
    return body.select("at", parsed.alias("r")).select(F.col("at").cast("long").alias("_ord"), "r.*")


def read_comment_tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated rows, comment lines skipped, a hyphen for null."""
    return spark.read.csv(path, schema=strings(*names), sep="\t", comment="#", nullValue="-")


#: Records of diseases as three files spell them: cross references, genes, nomenclature.
DISORDER = (
    "OrphaCode string, Name string, SynonymList struct<Synonym:array<string>>, DisorderType struct<Name:string>, ClassificationLevel struct<Name:string>, "
    "ExternalReferenceList struct<ExternalReference:array<struct<Source:string,Reference:string>>>, "
    "DisorderGeneAssociationList struct<DisorderGeneAssociation:array<struct<Gene:struct<Symbol:string>,DisorderGeneAssociationType:struct<Name:string>>>>"
)


def disorders(spark: SparkSession, path: str) -> DataFrame:
    """The disorders of any of the three files; what a file does not tell is null."""
    return read_xml(spark, path, "Disorder", DISORDER).where("OrphaCode <> ''")


def disorder_references(records: DataFrame, source: str = "OMIM") -> DataFrame:
    """orpha_id, omim_id, _ord (place in the record) of the cross references of one source."""
    rows = records.select(F.col("OrphaCode").alias("orpha_id"), F.posexplode("ExternalReferenceList.ExternalReference").alias("_ord", "r"))
    return rows.where((F.col("r.Source") == source) & (F.col("r.Reference") != "")).select("orpha_id", F.col("r.Reference").alias("omim_id"), "_ord")


def disorder_genes(records: DataFrame) -> DataFrame:
    """orpha_id, symbol, assoc_type (Unknown where none is given), _ord; associations without a symbol go."""
    rows = records.select(F.col("OrphaCode").alias("orpha_id"), F.posexplode("DisorderGeneAssociationList.DisorderGeneAssociation").alias("_ord", "a"))
    return rows.where(F.trim("a.Gene.Symbol") != "").select("orpha_id", F.trim("a.Gene.Symbol").alias("symbol"), F.coalesce("a.DisorderGeneAssociationType.Name", F.lit("Unknown")).alias("assoc_type"), "_ord")


def disorder_names(records: DataFrame) -> DataFrame:
    """orpha_id, name, synonyms, disorder_type, level."""
    return records.select(F.col("OrphaCode").alias("orpha_id"), F.col("Name").alias("name"), F.coalesce("SynonymList.Synonym", F.array().cast("array<string>")).alias("synonyms"), F.col("DisorderType.Name").alias("disorder_type"), F.col("ClassificationLevel.Name").alias("level"))


def mim_genes(spark: SparkSession, path: str) -> DataFrame:
    """omim_id, gene_id of a commented table; rows without a gene go, and of a repeated id the last row stands."""
    rows = read_comment_tsv(spark, path, ["omim_id", "gene_id"]).where("gene_id <> ''").withColumn("_ord", F.monotonically_increasing_id())
    return rows.groupBy("omim_id").agg(F.max_by("gene_id", "_ord").alias("gene_id"))


def approved_genes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Symbol, entrez_id by the names in the header; rows without a symbol go."""
    return read_csv(spark, path, schema, sep="\t").select("symbol", "entrez_id").where("symbol <> ''")


#: The columns that a table of gene classifications is read by, and the classifications that count.
CLASSIFIED = {"GENE SYMBOL": "symbol", "DISEASE ID (MONDO)": "mondo_id", "CLASSIFICATION": "classification"}
CLASSES = ("Definitive", "Strong", "Moderate", "Limited")


def classified_genes(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(symbol, mondo_id, classification, _ord; whether the header has the columns) of a table whose header comes after other lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n"))).toDF("at", "line")
    head = lines.where(F.col("line").rlike('^"?GENE SYMBOL')).orderBy("at").limit(1).collect()  # one line
    names = [c.strip().strip('"') for c in head[0]["line"].split(",")] if head else []
    if not {"GENE SYMBOL", "CLASSIFICATION"} <= set(names):
        return spark.createDataFrame([], "symbol string, mondo_id string, classification string, _ord int"), False
    cells = lines.where(F.col("at") > head[0]["at"]).select(F.col("at").alias("_ord"), F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(len(names))))).alias("c"))
    rows = cells.select(*[(F.trim(F.col("c")[f"c{names.index(k)}"]) if k in names else F.lit(None).cast("string")).alias(v) for k, v in CLASSIFIED.items()], "_ord")
    return rows.where((F.col("symbol") != "") & F.col("classification").isin(*CLASSES) & F.col("mondo_id").startswith("MONDO:")), True


def id_map(spark: SparkSession, path: str, names: tuple[str, str] = ("orpha_id", "mondo_id")) -> DataFrame:
    """A JSON object of ids, by itself or under ``mappings``."""
    whole = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.mappings"), F.col("value"))
    return whole.select(F.explode(F.from_json(inner, "map<string,string>")).alias(*names))


def parent_map(spark: SparkSession, path: str) -> DataFrame:
    """Child, parent of a JSON object of children with lists of parents."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("child", "parents"))
    return rows.select("child", F.explode("parents").alias("parent"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Declared columns; arrays as cells between bars."""
    kind = dict(df.dtypes)
    df.select(*[F.array_join(c, "|").alias(c) if kind[c].startswith("array") else F.col(c) for c in columns]).write.mode("overwrite").csv(path, header=True, escape='"')


def split_lists(df: DataFrame, *columns: str) -> DataFrame:
    """Cells between bars as arrays."""
    return df.withColumns({c: listed(F.col(c)) for c in columns})


def write_index(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """The commit protocol makes the replacement all or nothing."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An index, or an empty one where none is."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def ingestion_health(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Source, status (ok or absent), _ord for each input file."""
    rows = [(k, "ok" if exists(spark, p) else "absent", i) for i, (k, p) in enumerate(paths.items())]
    return spark.createDataFrame(rows, "source string, status string, _ord int")
