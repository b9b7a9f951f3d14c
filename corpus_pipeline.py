"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, passages that repeat are cut
to their first occurrence, documents that hold a benchmark item go, and what is left is encoded as byte-level BPE tokens.

Every stage but the last returns the columns of `documents`; run() writes each stage's result to the shared folder that
spark.checkpoint.dir names and reads it back, so a lost executor never costs more than the stage at hand; a stage's result goes
when the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from maskspan.llm import _spark, bpe, decontam, simhash, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.cut(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Classifiers, signatures and searches: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{_spark.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            _spark.remove(spark, f"{folder}/{before}")
        before = name
    return docs
