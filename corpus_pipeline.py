"""A corpus pipeline: five stages over ``documents``, each through one of the training-data operators.

Every stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and works on all rows
that the stage before it kept; its result is written as Parquet and read again as the next one's docs. The result
of a stage is deleted once the next one is written.

Null texts are empty, null and repeated doc_ids, repeated rows, null sources, very long texts and extra columns of any name
pass through all stages that keep the columns: toxicity and decontamination judge row by row; near-duplicate removal
keeps one row of each group and all rows without doc_id; mixing takes rows by doc_id, source and size. The manifest
has one row per row of the mix. Empty tables give an empty manifest; without labels the hand-written lexicon decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, minhash, mixing, shards, toxicity
from millrace.llm.common import remove, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon rejects go."""
    return toxicity.clean_rows(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return minhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken never, once or twice, so that sources come near their target weights."""
    return mixing.taken_rows(docs, weights=[3, 1, 2], factor=1.5, cap=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of 24 byte-balanced shards: one row per row of the mix."""
    placed = shards.byte_balanced(docs, 24)
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The mix is drawn at random, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
