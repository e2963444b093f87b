"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing; each stage reads the last one's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmend.llm import decontaminate, line_dedup, minhash, mixing, quality_rules
from gridmend.llm.common import saved
from gridmend.session import prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier in the corpus go; n_chars is counted anew (null for a null text)."""
    from pyspark.sql import functions as F

    kind = docs.schema["n_chars"].dataType
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(kind)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.keep_one(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken by the mix, with the number of copies to train on."""
    return mixing.sample(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_dedup", near_copies), ("decontaminate", benchmark), ("mix_sources", mixture)]

#: SQL states neither robust estimates nor similarity groups; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is written as Parquet and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
