"""Input tables of the registered queries, and steps that free their shuffle files."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from panelspark.session import ensure_checkpoint_dir, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files go with the job that made them."""
    was = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, was)


def released(df: DataFrame) -> DataFrame:
    """``df`` as a table written in the shared scratch folder; its shuffle files go with the write.

    checkpoint() keeps them until the driver collects its garbage, so a job of several large steps
    would hold the files of all of them.  The table also lets later steps read single columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    with _cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int, path: str) -> DataFrame:
    """``df`` as a table written at ``path``, dealt into ``buckets`` by ``column``: a join on it with rows
    dealt alike does not move this table.  The catalog keeps no name of it; its shuffle files go
    with the write."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")      # the files of a table with its own path stay
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that a later written one has replaced."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
