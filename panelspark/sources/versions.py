"""A set of tables that is replaced as a whole.

``publish`` writes every table of the set into a folder of its own version and then appends one
manifest: a single file with a row for each table.  Readers follow the newest manifest, so the
append of that one file is the switch.  Before it they see all old tables, after it all new ones;
a run that fails between two tables leaves files that no manifest names.  Nothing is overwritten
or deleted, so a DataFrame of an older version stays readable, and ``restore`` makes a version
current again by appending its rows once more.

Versions are ordered by the time they were published at; of two writers the later switch counts,
whole.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version string, table string, path string"


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root.rstrip('/')}/_manifests"
    try:
        return spark.read.schema(_MANIFEST).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _switch(spark: SparkSession, root: str, rows: Sequence[tuple[str, str]]) -> str:
    """Append one manifest file; its rows become visible together."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    manifest = spark.createDataFrame([(version, t, p) for t, p in rows], _MANIFEST)
    manifest.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/_manifests")
    return version


def stage(df: DataFrame, root: str, run: str, name: str, partition_by: Sequence[str] = ()) -> str:
    """Write one table of a version that is not readable yet; returns its folder."""
    path = f"{root.rstrip('/')}/{run}/{name}"
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def publish(spark: SparkSession, root: str,
            tables: Mapping[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]],
            partition_by: Mapping[str, Sequence[str]] | None = None) -> str:
    """Write all tables, then switch readers to them; returns the version.

    A table may be given as a function of ``staged``, which reads a table of this version that was
    written before it, so that what derives from a large table is computed from its files.
    """
    run, written = f"run-{uuid.uuid4().hex}", {}

    def staged(name: str) -> DataFrame:
        return spark.read.parquet(written[name])

    for name, df in tables.items():
        df = df(staged) if callable(df) else df
        written[name] = stage(df, root, run, name, (partition_by or {}).get(name, ()))
    return _switch(spark, root, list(written.items()))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, table, path) of every published version."""
    return _manifests(spark, root)


def _rows_of(spark: SparkSession, root: str, version: str | None) -> list[tuple[str, str]]:
    listed = _manifests(spark, root)
    newest = listed.agg(F.max("version").alias("version")) if version is None else None
    rows = listed.join(newest, "version") if version is None else listed.where(F.col("version") == version)
    found = [(r["table"], r["path"]) for r in rows.collect()]      # a row for each table of one version
    if not found:
        raise LookupError(f"no published tables under {root}" + (f" in version {version}" if version else ""))
    return found


def read_published(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of the newest (or the given) version, all of one."""
    return {t: spark.read.parquet(p) for t, p in _rows_of(spark, root, version)}


def restore(spark: SparkSession, root: str, version: str) -> str:
    """Make an earlier version current again."""
    return _switch(spark, root, _rows_of(spark, root, version))
