"""The queries of the corpus operators and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, langid, licenses, lmscore, simhash, substring, toxicity, urls, webp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.classify(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_webp_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures: every vector of `embeddings` is written as a lossless WebP file, then decoded."""
    return webp.pixels(webp.make_media(table(spark, sf_dir, "embeddings")), "vec_id", "media")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_mixture": op1_language_mixture,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_webp_pixels": op7_webp_pixels,
    "op8_licenses": op8_licenses,
    "op9_lm_score": op9_lm_score,
    "op10_substring": op10_substring,
}

SQL: dict[str, str] = {"op4_url_filter": urls.sql(), "op7_webp_pixels": webp.SQL}
