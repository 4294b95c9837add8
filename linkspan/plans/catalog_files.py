"""Queries of readers and writers: the driver's rows written in a format, read back by its reader, and SQL over the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..session import scratch, table
from ..sources import boxes, files, pages
from .registry import query


def _lines(df: DataFrame, spark: SparkSession, name: str, *parts, sep: str = "|", files_: int = 3) -> str:
    """Rows as lines of text in a new folder."""
    path = scratch(spark, name)
    text = F.concat_ws(sep, *parts) if len(parts) > 1 else parts[0]
    df.select(text.alias("value")).repartition(files_).write.text(path)
    return path


def _one_text(spark: SparkSession, name: str, text) -> str:
    """One document, whose lines have an order, as a single file."""
    path = scratch(spark, name)
    text.coalesce(1).write.text(path)
    return path


# ---- tables of text -----------------------------------------------------------------------------------------------------
@query("""SELECT c_custkey::VARCHAR AS custkey, 'He said "' || c_name || '", twice' || chr(10) || 'and left' AS note, 'x|' || c_nationkey AS tags, c_nationkey % 2 = 1 AS two FROM customer""")
def csv_tables(spark, d):
    """Declared columns, quotes, commas and line breaks in cells, lists between bars; a file that is missing is an empty table."""
    rows = table(spark, d, "customer")
    note = F.concat(F.lit('He said "'), "c_name", F.lit('", twice\nand left'))
    tags = F.when(F.col("c_nationkey") % 2 == 1, F.array(F.lit("x"), F.col("c_nationkey").cast("string"))).otherwise(F.array(F.concat(F.lit("x|"), F.col("c_nationkey"))))
    path = scratch(spark, "csv")
    files.write_csv(rows.select(F.col("c_custkey").alias("custkey"), note.alias("note"), tags.alias("tags"), F.lit("gone").alias("other")), path, ["custkey", "note", "tags"])
    schema = files.strings("custkey", "note", "tags")
    back = files.split_lists(files.read_csv(spark, path, schema).union(files.read_csv(spark, path + "-missing", schema)), "tags")
    return back.select("custkey", "note", F.array_join("tags", "|").alias("tags"), (F.col("custkey").isNotNull() & (F.size("tags") == 2) & (F.element_at("tags", 2).cast("int") % 2 == 1)).alias("two"))


@query("SELECT p_partkey::VARCHAR AS code, p_name AS name FROM part WHERE p_size % 5 <> 0")
def tsv_keys(spark, d):
    """Keys of a tab-separated table with a header; rows with an empty first key go."""
    path = scratch(spark, "tsv")
    code = F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_partkey").cast("string")))
    table(spark, d, "part").select(code.alias("code"), F.concat("p_name", F.lit(" ")).alias("name"), F.col("p_brand").alias("more")).write.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_tsv_keys(spark, path, files.strings("code", "name", "more"), "code", "name")


@query("""SELECT p_partkey::VARCHAR AS partkey, p_name, CASE WHEN p_size > 25 THEN p_brand END AS p_brand FROM part""")
def dynamic_table(spark, d):
    """A table with whatever columns its header names, all of them strings; files may have different ones."""
    part, path = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_name", "p_brand", "p_size"), scratch(spark, "dynamic")
    part.where("p_size > 25").drop("p_size").write.csv(path + "/a", header=True)
    part.where("p_size <= 25").select("p_name", "partkey").write.csv(path + "/b", header=True)
    return files.read_dynamic(spark, path + "/a", path + "/b").select("partkey", "p_name", "p_brand")


@query("""SELECT 'C' || p_type AS cui, p_brand AS sab, p_partkey::VARCHAR AS code, 'A' || p_partkey AS aui, p_name AS str FROM part WHERE p_size % 3 <> 0 AND p_brand < 'Brand#4'""")
def positional_atoms(spark, d):
    """Rows without a header by position, one language and some sources."""
    part = table(spark, d, "part")
    value = {"CUI": F.concat(F.lit("C"), "p_type"), "LAT": F.when(F.col("p_size") % 3 == 0, "GER").otherwise("ENG"), "AUI": F.concat(F.lit("A"), "p_partkey"), "SAB": F.col("p_brand"), "CODE": F.col("p_partkey").cast("string"), "STR": F.col("p_name")}
    path = _lines(part, spark, "atoms", *[value.get(c, F.lit("")) for c in files.MRCONSO], F.lit(""))
    brands = tuple(f"Brand#{i}{j}" for i in range(1, 4) for j in range(10)) + tuple(f"Brand#{i}" for i in range(1, 4))
    return files.atoms(spark, path, brands).select("cui", "sab", "code", "aui", "str")


@query("""SELECT p_partkey::VARCHAR AS code, CASE WHEN p_size % 2 = 0 THEN p_name || ' (thing)' ELSE p_name END AS name FROM part WHERE p_size % 7 <> 0""")
def release_names(spark, d):
    """The full name of a code, else its first active term; inactive ones do not count."""
    part, path = table(spark, d, "part"), scratch(spark, "names")
    active = F.when(F.col("p_size") % 7 == 0, "0").otherwise("1")
    term = lambda text, kind: F.struct(text.alias("term"), F.lit(kind).alias("typeId"))
    terms = F.when(F.col("p_size") % 2 == 0, F.array(term(F.col("p_name"), "7"), term(F.concat("p_name", F.lit(" (thing)")), files.FULL_NAME))).otherwise(F.array(term(F.col("p_name"), "7")))
    part.select(F.col("p_partkey").alias("conceptId"), active.alias("active"), F.explode(terms).alias("t")).select("conceptId", "active", "t.typeId", "t.term").write.csv(path, sep="\t", header=True, quote="")
    return files.preferred_names(files.release_table(spark, path))


@query("""SELECT CASE WHEN p_size > 9 THEN 'A' || p_partkey || 'x' ELSE 'B' || p_size END AS code, CASE WHEN p_size > 9 AND length('A' || p_partkey || 'x') > 3 THEN substr('A' || p_partkey || 'x', 1, 3) || '.' || substr('A' || p_partkey || 'x', 4) WHEN p_size > 9 THEN 'A' || p_partkey || 'x' ELSE 'B' || p_size END AS code_dotted,
                  p_name || ' of  ' || p_type AS name, (SELECT count(*) FROM part) AS n_rows FROM part""")
def code_list(spark, d):
    """A code, any white space and a name on each line; as many rows as lines."""
    part = table(spark, d, "part")
    code = F.when(F.col("p_size") > 9, F.concat(F.lit("A"), "p_partkey", F.lit("x"))).otherwise(F.concat(F.lit("B"), "p_size"))
    path = _lines(part, spark, "codes", F.concat(code, F.lit("   \t"), "p_name", F.lit(" of  "), "p_type", F.lit("  ")))
    out = files.read_code_list(spark, path)
    return out.withColumn("n_rows", F.lit(quality.assert_row_parity(out, spark.read.text(path))).cast("long"))


@query("""SELECT 'i' || p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS a, p_brand AS b FROM part""")
def commented_table(spark, d):
    """Tab-separated rows, comment lines skipped, a hyphen for null."""
    part = table(spark, d, "part")
    row = F.concat_ws("\t", F.concat(F.lit("i"), "p_partkey"), F.when(F.col("p_size") % 4 == 0, "-").otherwise(F.col("p_name")), "p_brand")
    path = _lines(part.select(F.explode(F.array(row, F.concat(F.lit("# about "), "p_name"))).alias("x")), spark, "comments", F.col("x"))
    return files.read_comment_tsv(spark, path, ["id", "a", "b"])


@query("""SELECT 'D' || p_partkey AS ui, p_name AS name, CASE p_size % 4 WHEN 0 THEN 'C' || p_size || '|Z1' WHEN 1 THEN 'A2|F03.5' END AS trees FROM part WHERE p_size % 4 < 2""")
def descriptor_records(spark, d):
    """Records of an XML file whose tree numbers lie in a branch of diseases."""
    part, path = table(spark, d, "part"), scratch(spark, "descriptors")
    k = F.col("p_size") % 4
    trees = F.when(k == 0, F.array(F.concat(F.lit("C"), "p_size"), F.lit("Z1"))).when(k == 1, F.array(F.lit("A2"), F.lit("F03.5"))).when(k == 2, F.array(F.lit("F04"), F.lit("B1"))).otherwise(F.array(F.lit("D9")))
    rows = part.select(F.concat(F.lit("D"), "p_partkey").alias("DescriptorUI"), F.struct(F.col("p_name").alias("String")).alias("DescriptorName"), F.struct(trees.alias("TreeNumber")).alias("TreeNumberList"))
    rows.write.format("xml").option("rootTag", "DescriptorRecordSet").option("rowTag", "DescriptorRecord").save(path)
    back = files.read_xml(spark, path, "DescriptorRecord", "DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>")
    found = files.disease_records(back.withColumn("tree_numbers", F.col("TreeNumberList.TreeNumber")))
    return found.select(F.col("DescriptorUI").alias("ui"), F.col("DescriptorName.String").alias("name"), F.array_join("tree_numbers", "|").alias("trees"))


# ---- disorders and genes ------------------------------------------------------------------------------------------------
def _disorders(spark: SparkSession, d: str) -> DataFrame:
    """Customers as disorders: orders as cross references (OMIM where urgent), order statuses as genes, nations as synonyms."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "OMIM").otherwise("ICD").alias("source"))
    ref = F.struct(F.col("source").alias("Source"), F.col("o_orderkey").cast("string").alias("Reference"))
    gene = F.struct(F.struct(F.concat(F.lit("G"), "o_orderstatus").alias("Symbol")).alias("Gene"), F.struct(F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("Type "), "source")).alias("Name")).alias("DisorderGeneAssociationType"))
    per = o.groupBy("k").agg(F.sort_array(F.collect_list(ref)).alias("refs"), F.sort_array(F.collect_list(gene)).alias("genes"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_nationkey", "c_mktsegment").join(per, "k", "left")
    synonyms = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.concat(F.lit("N"), "c_nationkey"), F.concat(F.lit("K"), "k")))
    rows = c.select(
        F.col("k").cast("string").alias("OrphaCode"), F.col("c_name").alias("Name"), F.struct(synonyms.alias("Synonym")).alias("SynonymList"), F.struct(F.col("c_mktsegment").alias("Name")).alias("DisorderType"), F.struct(F.lit("Disorder").alias("Name")).alias("ClassificationLevel"),
        F.struct(F.col("refs").alias("ExternalReference")).alias("ExternalReferenceList"), F.struct(F.col("genes").alias("DisorderGeneAssociation")).alias("DisorderGeneAssociationList"),
    )
    path = scratch(spark, "disorders")
    rows.write.format("xml").option("rootTag", "JDBOR").option("rowTag", "Disorder").save(path)
    return files.disorders(spark, path)


@query("SELECT o_custkey::VARCHAR AS orpha_id, o_orderkey::VARCHAR AS omim_id FROM orders WHERE o_orderpriority = '1-URGENT'")
def disorder_references(spark, d):
    """The cross references of one source."""
    return files.disorder_references(_disorders(spark, d)).select("orpha_id", "omim_id")


@query("""SELECT o_custkey::VARCHAR AS orpha_id, 'G' || o_orderstatus AS symbol, CASE WHEN o_orderstatus = 'O' THEN 'Unknown' WHEN o_orderpriority = '1-URGENT' THEN 'Type OMIM' ELSE 'Type ICD' END AS assoc_type, count(*) AS n FROM orders GROUP BY 1, 2, 3""")
def disorder_genes(spark, d):
    """The genes of disorders, with the kind of association where one is given."""
    return files.disorder_genes(_disorders(spark, d)).groupBy("orpha_id", "symbol", "assoc_type").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey::VARCHAR AS orpha_id, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'N' || c_nationkey || '|K' || c_custkey ELSE '' END AS synonyms, c_mktsegment AS disorder_type, 'Disorder' AS level FROM customer""")
def disorder_names(spark, d):
    """Names, synonyms and types of disorders."""
    return files.disorder_names(_disorders(spark, d)).withColumn("synonyms", F.array_join("synonyms", "|"))


@query("""SELECT 'mim' AS kind, 'm' || s_suppkey AS a, 'g' || s_nationkey AS b, NULL AS c FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'hgnc', s_name, 'e' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 4 <> 0
           UNION ALL SELECT 'clingen', s_name, 'MONDO:' || s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Definitive' ELSE 'Limited' END FROM supplier WHERE s_suppkey % 5 < 2
           UNION ALL SELECT 'mondo', 'o' || n_nationkey, 'MONDO:' || n_regionkey, NULL FROM nation UNION ALL SELECT 'flat', 'o' || n_nationkey, 'MONDO:' || n_regionkey, NULL FROM nation
           UNION ALL SELECT 'parent', 'o' || n_nationkey, x.p, NULL FROM nation CROSS JOIN (VALUES ('p1'), ('p2')) x(p)""")
def gene_tables(spark, d):
    """The five tables that genes and classes of diseases come in, each in its own layout."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    k = F.col("s_suppkey")
    mim = F.concat_ws("\t", F.concat(F.lit("m"), k), F.when(k % 3 == 0, "-").otherwise(F.concat(F.lit("g"), "s_nationkey")), F.lit("x"))
    mims = files.mim_genes(spark, _one_text(spark, "mim", s.select(F.explode(F.array(F.lit("# comment"), mim)).alias("value"))))
    hgnc = scratch(spark, "hgnc")
    s.select(k.alias("hgnc_id"), F.when(k % 4 != 0, F.col("s_name")).alias("symbol"), F.concat(F.lit("e"), k).alias("entrez_id")).write.csv(hgnc, sep="\t", header=True)
    genes = files.approved_genes(spark, hgnc, files.strings("hgnc_id", "symbol", "entrez_id"))
    kind = F.when(k % 5 == 0, "Definitive").when(k % 5 == 1, "Limited").when(k % 5 == 2, "Disputed").otherwise("Strong")
    id_ = F.when(k % 5 < 3, F.concat(F.lit("MONDO:"), k)).otherwise("OTHER:1")
    rows = s.agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('"'), "s_name", F.lit('","x,y","'), id_, F.lit('","'), kind, F.lit('"')))), "\n").alias("body"))
    table_ = rows.select(F.concat(F.lit('"CLINGEN VALIDITY"\n"FILE CREATED: now"\n"GENE SYMBOL","NOTE","DISEASE ID (MONDO)","CLASSIFICATION"\n"+++","+++","+++","+++"\n'), "body").alias("value"))
    classified, whole = files.classified_genes(spark, _one_text(spark, "clingen", table_))
    assert whole
    ids = n.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("o"), "n_nationkey"), F.concat(F.lit("MONDO:"), "n_regionkey")))).alias("m"))
    nested = files.id_map(spark, _one_text(spark, "mondo", ids.select(F.to_json(F.struct(F.create_map(F.lit("made"), F.lit("now")).alias("_metadata"), F.col("m").alias("mappings"))).alias("value"))))
    flat = files.id_map(spark, _one_text(spark, "flat", ids.select(F.to_json("m").alias("value"))))
    up = n.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("o"), "n_nationkey"), F.array(F.lit("p1"), F.lit("p2"))))).alias("m"))
    parents = files.parent_map(spark, _one_text(spark, "parents", up.select(F.to_json("m").alias("value"))))
    out = None
    for name, df in (("mim", mims.select("omim_id", "gene_id")), ("hgnc", genes), ("clingen", classified.select("symbol", "mondo_id", "classification")), ("mondo", nested), ("flat", flat), ("parent", parents)):
        one = df.select(F.lit(name).alias("kind"), F.col(df.columns[0]).alias("a"), F.col(df.columns[1]).alias("b"), (F.col(df.columns[2]) if len(df.columns) > 2 else F.lit(None).cast("string")).alias("c"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- documents in JSON --------------------------------------------------------------------------------------------------
def _ontology(spark: SparkSession, d: str) -> str:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name", F.col("n_regionkey").alias("r"))
    iri = lambda c: F.concat(F.lit("http://purl.obolibrary.org/obo/MONDO_"), c)
    syn = lambda kind, text: F.struct(F.lit(kind).alias("pred"), text.alias("val"))
    node = F.struct(iri("k").alias("id"), F.col("n_name").alias("lbl"), F.when(F.col("k") % 5 == 4, "PROPERTY").otherwise("CLASS").alias("type"), F.struct(
        (F.col("k") % 7 == 6).alias("deprecated"), F.struct(F.concat(F.lit("About "), "n_name").alias("val")).alias("definition"), F.array(syn("hasExactSynonym", F.lower("n_name")), syn("hasRelatedSynonym", F.lit("land"))).alias("synonyms"),
        F.array(F.struct(F.concat(F.lit("OMIM:"), "k").alias("val")), F.struct(F.concat(F.lit("ICD:"), "r").alias("val"))).alias("xrefs")).alias("meta"))
    edge = F.array(F.struct(iri("k").alias("sub"), F.lit("is_a").alias("pred"), iri(100 + F.col("r")).alias("obj")), F.struct(iri("k").alias("sub"), F.lit("part_of").alias("pred"), iri("k").alias("obj")), F.struct(iri("k").alias("sub"), F.lit("is_a").alias("pred"), F.lit("http://other/x").alias("obj")))
    doc = n.agg(F.collect_list(node).alias("nodes"), F.flatten(F.collect_list(edge)).alias("edges")).select(F.to_json(F.struct(F.array(F.struct("nodes", "edges")).alias("graphs"))).alias("value"))
    return _one_text(spark, "ontology", doc)


@query("SELECT 'MONDO:' || n_nationkey AS child, 'MONDO:' || (100 + n_regionkey) AS parent FROM nation")
def ontology_edges(spark, d):
    """Is-a edges between classes."""
    return files.ontology_edges(spark, _ontology(spark, d))


@query("""SELECT 'MONDO:' || n_nationkey AS id, n_name AS label, lower(n_name) AS exact, 'land' AS related, 'About ' || n_name AS definition, 'ICD:' || n_regionkey AS icd, 'OMIM:' || n_nationkey AS omim FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 7 <> 6""")
def ontology_classes(spark, d):
    """Live classes with synonyms, definitions and cross references."""
    nodes = files.ontology_nodes(spark, _ontology(spark, d))
    refs = files.xrefs_by_prefix(nodes, "ICD", "OMIM").withColumnsRenamed({"ICD": "icd", "OMIM": "omim"})
    return nodes.join(refs, "id", "left").select("id", "label", F.array_join("exact_synonyms", "|").alias("exact"), F.array_join("related_synonyms", "|").alias("related"), "definition", "icd", "omim")


@query("""SELECT 'NCT' || lpad(o_orderkey::VARCHAR, 8, '0') AS nct_id, CASE WHEN o_orderstatus <> 'P' THEN 'Trial ' || o_orderkey END AS title, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN 'PHASE3' ELSE '' END AS phases,
                  'K' || o_custkey AS sponsor, o_orderpriority AS conditions, 'DRUG:x' || o_custkey AS interventions, CASE WHEN o_orderstatus = 'F' THEN 'm' || o_orderkey ELSE '' END AS measures, count(*) OVER (PARTITION BY o_orderkey // 500) AS total FROM orders""")
def paged_trials(spark, d):
    """Staged pages of studies as flat rows; what a study lacks is null or empty."""
    o = table(spark, d, "orders")
    done = F.col("o_orderstatus") == "F"
    study = F.struct(F.struct(
        F.struct(F.concat(F.lit("NCT"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("nctId"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Trial "), "o_orderkey")).alias("briefTitle")).alias("identificationModule"),
        F.struct(F.col("o_orderstatus").alias("overallStatus")).alias("statusModule"), F.when(done, F.struct(F.array(F.lit("PHASE3")).alias("phases"))).alias("designModule"),
        F.struct(F.struct(F.concat(F.lit("K"), "o_custkey").alias("name")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"), F.struct(F.array("o_orderpriority").alias("conditions")).alias("conditionsModule"),
        F.struct(F.array(F.struct(F.lit("DRUG").alias("type"), F.concat(F.lit("x"), "o_custkey").alias("name"))).alias("interventions")).alias("armsInterventionsModule"),
        F.when(done, F.struct(F.array(F.struct(F.concat(F.lit("m"), "o_orderkey").alias("measure"))).alias("primaryOutcomes"))).alias("outcomesModule"),
    ).alias("protocolSection"))
    page = o.groupBy(F.floor(F.col("o_orderkey") / 500).alias("page")).agg(F.collect_list(study).alias("studies"), F.count("*").alias("totalCount"))  # at most 500 studies
    folder = scratch(spark, "pages")
    page.select(F.to_json(F.struct("studies", "totalCount", F.concat(F.lit("t"), F.col("page") + 1).alias("nextPageToken"))).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    read = pages.read_pages(spark, folder)
    rows = pages.trial_records(read).join(read.select("page", "pos", "total"), ["page", "pos"])
    measures = F.array_join(F.transform("primary_outcomes", lambda x: x["measure"]), "|")
    given = F.array_join(F.transform("interventions", lambda x: F.concat_ws(":", x["type"], x["name"])), "|")
    return rows.select("nct_id", "title", "status", F.array_join("phases", "|").alias("phases"), "sponsor", F.array_join("conditions", "|").alias("conditions"), given.alias("interventions"), measures.alias("measures"), "total")


# ---- indexes, folders, health -------------------------------------------------------------------------------------------
@query("SELECT p_partkey AS partkey, p_type AS kind, p_name AS name FROM part")
def index_files(spark, d):
    """An index replaced as a whole, read by partitions; one that is missing is empty."""
    rows, path = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"), F.col("p_type").alias("kind")), scratch(spark, "index")
    schema = "partkey long, name string, kind string"
    files.write_index(rows.where("partkey < 10"), path, "kind")
    files.write_index(rows, path, "kind")
    return files.read_index(spark, path, schema).unionByName(files.read_index(spark, path + "-missing", schema)).select("partkey", "kind", "name")


@query("""SELECT p_type AS folder, p_type IN ('SMALL', 'LARGE') AS is_pdf, count(*) AS n_files FROM (SELECT DISTINCT p_type FROM part) GROUP BY 1, 2""")
def stored_documents(spark, d):
    """Which files of a folder are what they claim to be, by their first bytes; those already there are not fetched again."""
    kinds, path = table(spark, d, "part").select(F.col("p_type").alias("folder")).distinct(), scratch(spark, "documents")
    body = F.when(F.col("folder").isin("SMALL", "LARGE"), "%PDF-1.4 ...").otherwise("<html>")
    kinds.select("folder", body.alias("value")).repartition("folder").write.partitionBy("folder").text(path)
    seen = files.stored(spark, path)
    assert files.to_fetch(kinds.select(F.col("folder").alias("name")), seen.select(F.regexp_extract("path", "folder=([^/]+)/", 1).alias("name")), "name").isEmpty()
    return seen.groupBy(F.regexp_extract("path", "folder=([^/]+)/", 1).alias("folder"), "is_pdf").agg(F.count("*").alias("n_files"))


@query("""SELECT * FROM (VALUES ('documents', 'ok', 0), ('nothing', 'absent', 1), ('nation', 'ok', 2)) x(source, status, _ord)""")
def input_health(spark, d):
    """Which inputs are there."""
    return files.ingestion_health(spark, {"documents": f"{d}/documents.parquet", "nothing": f"{d}/nothing.parquet", "nation": f"{d}/nation.parquet"})


@query("""SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL ELSE 'x' END AS cell, last_value(CASE WHEN event_type = 'signup' THEN 'B' || user_id || '/' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS banner FROM events QUALIFY event_type <> 'signup'""")
def banner_rows(spark, d):
    """Rows of an extracted table under the banner above them; the banners go."""
    is_banner = F.col("event_type") == "signup"
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.when(is_banner, F.concat(F.lit("B"), "user_id", F.lit("/"), "event_id")).otherwise("x").alias("cell"))
    return files.banner_rows(e, is_banner, "cell", ["user_id"], ["ts", "event_id"]).select("event_id", "cell", "banner")


@query("""SELECT 'D' || (p_partkey // 2000) AS doc, (p_partkey // 20) % 100 AS page, p_partkey::VARCHAR AS key, p_name || ' ' || p_type || ' ' || p_brand AS described,
                 CASE WHEN p_size >= 5 THEN p_size::VARCHAR ELSE '' END AS size, 'What page ' || (p_partkey // 20) % 100 || ' holds, by key and name' AS banner FROM part""")
def boxed_table(spark, d):
    """Parts laid out as words on pages (cells of two lines, words a little off their line, empty cells, a header on each page and a banner over all columns) and read back."""
    at = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("D"), F.floor(F.col("p_partkey") / 2000)).alias("doc"), (F.floor(F.col("p_partkey") / 20) % 100).alias("page"), "p_name", "p_type", "p_brand", "p_size")
    # A letter is 6 wide; words of a line follow each other by a blank, lines of a row by 10, rows by 40.
    word = lambda x, y, t: F.struct(x.cast("double").alias("x0"), (x + 6 * F.length(t)).cast("double").alias("x1"), y.cast("double").alias("y"), t.alias("text"))
    run = lambda x, y, text: F.transform(F.split(text, " "), lambda t, i: word(F.lit(x) + 6 * F.coalesce(F.aggregate(F.slice(F.split(text, " "), 1, i), F.lit(0), lambda n, b: n + F.length(b) + 1), F.lit(0)), F.lit(y) + i % 2, t))
    y = 60 + 40 * (F.col("key") % 20)
    parts = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    described = F.transform(parts, lambda t, i: word(F.lit(90) + F.when(i % 2 == 1, 6 * (F.length(F.get(parts, i - 1)) + 1)).otherwise(0), y + 10 * F.floor(i / 2) + i % 2, t))
    size = F.col("p_size").cast("string")
    cells = at.select("doc", "page", F.explode(F.concat(F.array(word(F.lit(10), y, F.col("key").cast("string"))), described, F.when(F.col("p_size") >= 5, F.array(word(300 - 6 * F.length(size), y, size))).otherwise(F.array()))).alias("w"))
    pages = at.select("doc", "page").distinct()
    banner = F.concat_ws(" ", F.lit("What page"), F.col("page").cast("string"), F.lit("holds, by key and name"))
    fixed = pages.select("doc", "page", F.explode(F.concat(run(10, 10, F.lit("Key")), run(90, 10, F.lit("Name and brand")), run(276, 10, F.lit("Size")), run(10, 35, banner))).alias("w"))
    rows = boxes.extract(cells.union(fixed).select("doc", "page", "w.*")).withColumn("first", F.col("cells")[0])
    rows = files.banner_rows(rows, boxes.is_banner(), "first", ["doc"], ["page", "row"])
    return rows.select("doc", "page", boxes.cell("Key").alias("key"), boxes.cell("Name and brand").alias("described"), boxes.cell("Size").alias("size"), "banner")
