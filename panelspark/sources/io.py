"""CSV / Parquet scans, the overwrite table sink and catalog helpers.

* CSV files are read with a fixed schema bound by *position* (the header row is
  skipped, so its spelling, a leading byte-order mark or CRLF endings do no harm).
* A family of yearly files is **one** scan; the year comes from each file's path
  (``_metadata.file_path``), so adding years adds tasks, not driver loops.
* Sinks overwrite per table; nothing ever deletes folders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_BOM = "\ufeff"


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType,
             header: bool = True, sep: str = ",", **options: str) -> DataFrame:
    """Fixed-schema CSV scan.  Quoted commas, CRLF and a leading BOM are handled."""
    reader = (spark.read.schema(schema)
              .option("header", str(header).lower())
              .option("sep", sep)
              .option("enforceSchema", "true")
              .option("quote", '"')
              .option("escape", '"')
              .option("mode", "PERMISSIVE"))
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.csv(list(paths) if not isinstance(paths, str) else paths)
    if not header:
        first = schema.fields[0]
        if isinstance(first.dataType, StringType):
            df = df.withColumn(first.name, F.regexp_replace(first.name, "^" + _BOM, ""))
    return df


# A four-digit year of the last or this century that no other digit touches.
YEAR_TOKEN = r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"


def file_year(path: Column, year_pattern: str = YEAR_TOKEN) -> Column:
    """The last year in a file's path, its part-file name left out; null without one."""
    return F.regexp_extract(F.regexp_replace(path, r"/part-[^/]*$", "/"), f".*{year_pattern}", 1).try_cast("int")


def scan_family(spark: SparkSession, paths: str | Sequence[str], schema: StructType,
                fmt: str = "csv", year_pattern: str = YEAR_TOKEN, year_col: str = "year",
                strict: bool = False, **options: str) -> DataFrame:
    """Read a family of yearly files in one scan and add the year found in each file path.

    The *last* match of ``year_pattern`` in the path wins, so ``/data/2017-2022/volume_2019.csv``
    yields 2019.  The names of part files that Spark wrote are left out, as their digits mean
    nothing: ``counts-2019/part-00000-....csv`` yields 2019.  A file without a year gets null, or with
    ``strict`` stops the scan with its path.
    """
    if fmt == "csv":
        opts = {"recursiveFileLookup": "true", **options}
        df = read_csv(spark, paths, schema, **opts)
    else:
        reader = spark.read.schema(schema).format(fmt).option("recursiveFileLookup", "true")
        for k, v in options.items():
            reader = reader.option(k, v)
        df = reader.load(list(paths) if not isinstance(paths, str) else paths)
    path = F.col("_metadata.file_path")
    year = file_year(path, year_pattern)
    if strict:
        year = F.coalesce(year, F.raise_error(F.concat(F.lit("no year in "), path)).cast("int"))
    return df.withColumn(year_col, year)


def write_table(df: DataFrame, name: str, partition_by: Sequence[str] | None = None,
                path: str | None = None, fmt: str = "parquet",
                watch: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Overwrite one managed (or, with ``path``, external) table.  Never deletes folders.  ``watch``
    (``quality.WriteChecks.watch``) sees the rows as they are written.

    Rows are rebalanced by the partition columns first, so that a partition gets few files (a large
    one several) and not one from every task.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    w = (watch(df) if watch else df).write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def write_parts(df: DataFrame, path: str, part_col: str) -> None:
    """Replace the parts (years, say) that ``df`` holds in a partitioned Parquet folder; others stay."""
    (df.hint("rebalance", F.col(part_col)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part_col).parquet(path))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def list_catalog(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """``SHOW TABLES`` as a DataFrame: (namespace, tableName, isTemporary)."""
    q = "SHOW TABLES" if pattern is None else f"SHOW TABLES LIKE '{pattern}'"
    return spark.sql(q)


def register_views(views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def empty_frame(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def union_all(frames: Iterable[DataFrame], seed: DataFrame | None = None,
              allow_missing: bool = False) -> DataFrame:
    """Union-all by column name, optionally starting from a typed (possibly empty) seed."""
    frames = list(frames)
    if seed is not None:
        frames = [seed] + frames
    if not frames:
        raise ValueError("union_all needs at least one frame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)
