"""Paged facts as a Spark data source: one partition per page file, read where it is scheduled.

``spark.dataSource.register(PagedFacts)`` and ``spark.read.format("paged_facts").schema(...).load(folder)``. A page is a JSON
document with ``studies``, ``totalCount`` and ``nextPageToken``; it yields one row per study with the page's number, the
study's position and the reported total, which is what completeness is judged by.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page int, pos int, total long, token string, study string"


class PagedFacts(DataSource):
    """S21 to S24 on staged pages (the network is not part of the engine)."""

    @classmethod
    def name(cls) -> str:
        return "paged_facts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options["path"])


class _Pages(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, f"{self.folder}/{f}")) for i, f in enumerate(sorted(x for x in os.listdir(self.folder) if x.endswith(".json")))]

    def read(self, partition: InputPartition):
        page, path = partition.value
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        for pos, study in enumerate(doc.get("studies", [])):
            yield page, pos, doc.get("totalCount"), doc.get("nextPageToken"), json.dumps(study)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows by Spark's own JSON reader, for folders in any store; pages are numbered by file name."""
    raw = spark.read.json(folder, schema="studies array<variant>, totalCount long, nextPageToken string", multiLine=True).withColumn("file", F.input_file_name())
    names = raw.select("file").distinct()
    from pyspark.sql import Window as W

    number = names.withColumn("page", F.row_number().over(W.orderBy("file")) - 1)
    return raw.join(number, "file").select("page", F.posexplode("studies").alias("pos", "study"), F.col("totalCount").alias("total"), F.col("nextPageToken").alias("token")).select("page", "pos", "total", "token", F.to_json("study").alias("study"))


def trial_records(pages: DataFrame) -> DataFrame:
    """Trials as flat rows with arrays of structs; what a study lacks is null or empty."""
    kind = "struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,statusModule:struct<overallStatus:string,startDateStruct:struct<date:string>>,designModule:struct<phases:array<string>>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>,conditionsModule:struct<conditions:array<string>>,armsInterventionsModule:struct<interventions:array<struct<type:string,name:string>>>,outcomesModule:struct<primaryOutcomes:array<struct<measure:string>>,secondaryOutcomes:array<struct<measure:string>>,otherOutcomes:array<struct<measure:string>>>>>"
    s = pages.withColumn("s", F.from_json("study", kind)["protocolSection"])
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias
    return s.select(
        "page", "pos", F.col("s.identificationModule.nctId").alias("nct_id"), F.col("s.identificationModule.briefTitle").alias("title"), F.col("s.statusModule.overallStatus").alias("status"),
        empty("s.designModule.phases", "array<string>")("phases"), F.col("s.statusModule.startDateStruct.date").alias("start_date"), F.col("s.sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"),
        empty("s.conditionsModule.conditions", "array<string>")("conditions"), empty("s.armsInterventionsModule.interventions", "array<struct<type:string,name:string>>")("interventions"),
        *[empty(f"s.outcomesModule.{k}Outcomes", "array<struct<measure:string>>")(f"{k}_outcomes") for k in ("primary", "secondary", "other")],
    )
