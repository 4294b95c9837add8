"""Indexes in versions: a write makes a folder of its own, and one small file, the manifest, makes it the newest.

A reader asks once which version is the newest and from then on reads that folder, so a replacement under way, or one that failed, is
never seen in part. Versions stay until they are no longer asked for; removing old folders is left to whoever keeps the store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists

MANIFEST = "folder string, schema string, n_rows long, version long"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, folder, schema, n_rows of every committed version; none where there is no index."""
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Writes rows to a folder that no reader knows of yet, and gives its name."""
    folder = f"rows-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path}/{folder}")
    return folder


def commit(spark: SparkSession, path: str, folder: str, schema: str) -> int:
    """Makes a staged folder the newest version and gives its number. Of two writers that commit the same number the second one raises, and may commit again."""
    number = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    n = spark.read.schema(schema).parquet(f"{path}/{folder}").count()
    row = spark.range(1).select(F.lit(folder).alias("folder"), F.lit(schema).alias("schema"), F.lit(n).alias("n_rows"))
    row.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest/version={number}")
    return number


def write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """The rows as a new version."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return commit(df.sparkSession, path, stage(df, path, partition_by), kinds)


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest if none is named, whatever is written from now on; empty, of the given schema, where there is none. A version that was never committed is a ValueError."""
    known = versions(spark, path)
    row = known.where(F.col("version") == version).first() if version is not None else known.orderBy(F.col("version").desc()).first()
    if row is None:
        if version is not None:
            raise ValueError(f"{path} has no version {version}")
        return spark.createDataFrame([], schema)
    return spark.read.schema(row["schema"]).parquet(f"{path}/{row['folder']}")
