"""What operators need of a session: tables, checkpoints, and broadcasts of a checked size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of a few short columns may be broadcast with at most so many rows; they are counted before.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set one is made on this machine, if all executors are on it too (master ``local``); on a cluster that raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="linkspan-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes it when nothing uses it any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if a count finds at most ``rows`` rows; else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
