"""Corpus pipeline: quality filter, near duplicates, repeated substrings, benchmark leaks, mixture.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each
result as Parquet in the shared scratch folder and rereads it.  All but the last stage return the
columns of ``documents``; the last adds a struct with the words taken, the copies and the position.
Rows with null or empty texts pass the stages that judge words (they have none) and are not mixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, mixing, near_dedup, quality_gam, suffix_dedup
from panelspark.llm.tables import table
from panelspark.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, does not reject."""
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their five-word shingles."""
    return near_dedup.keep_one(docs, shingle=5, percent=80)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that occurred earlier; n_chars follows."""
    cut = suffix_dedup.remove_repeats(docs, length=100)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"), n=10)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source mixture takes."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
]

# A classifier's scores and min-hashes are not expressible in SQL: tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
