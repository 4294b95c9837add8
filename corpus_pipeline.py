"""From raw documents to token ids: language ID, exact dedup, near dedup, mixing, byte-level BPE.

Each stage works on all that its predecessor kept and returns the columns of documents; the last returns digests of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkspan.llm import bpe, exact_dedup, jaccard_join, langid, mixing
from linkspan.llm.common import checkpoint
from linkspan.llm.queries import tokenizer


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that the network can tell, go."""
    return langid.keep_known(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the text decoded from them, for each document of the mix."""
    return bpe.encode_digests(docs, **tokenizer())


STAGES = [("language_id", identified), ("exact_dedup", distinct), ("jaccard_join", dissimilar), ("mixing", mixed), ("bpe", encoded)]

#: The language network has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared checkpoint folder, so that no stage is computed again by those after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
