"""Small relational building blocks shared by the operators.

Broadcast policy: a side is hinted for broadcast only after a check proves it holds at
most ``max_rows`` rows.  The check is ``take(max_rows + 1)`` of a one-column projection,
which Spark runs incrementally (one partition, then four times as many, ...) and stops as
soon as ``max_rows + 1`` rows are seen, so it reads little of a large table and brings at
most ``max_rows + 1`` one-column rows to the driver.  Past the bound nothing is hinted:
the planner uses its own size estimate, and AQE can still switch to a broadcast at run
time from the measured shuffle size.  Derived sides behind an aggregation are left to AQE
(or checked through ``probe``, a source table that bounds them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
# Assumed width of a variable-length value (strings, binary, arrays, maps) when bounding
# the bytes of a broadcast from its schema.
VARIABLE_WIDTH = 64


def estimated_row_bytes(schema: T.StructType) -> int:
    """A generous per-row size from the schema alone (no data read)."""
    def width(dt: T.DataType) -> int:
        if isinstance(dt, T.StructType):
            return sum(width(f.dataType) for f in dt.fields)
        if isinstance(dt, (T.ByteType, T.BooleanType)):
            return 1
        if isinstance(dt, (T.ShortType,)):
            return 2
        if isinstance(dt, (T.IntegerType, T.FloatType, T.DateType)):
            return 4
        if isinstance(dt, (T.LongType, T.DoubleType, T.TimestampType, T.TimestampNTZType)):
            return 8
        if isinstance(dt, T.DecimalType):
            return 16
        return VARIABLE_WIDTH
    return 16 + width(schema)


def broadcast_if_bounded(df: DataFrame, max_rows: int = DIMENSION_MAX_ROWS,
                         probe: DataFrame | None = None, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint ``df`` for broadcast when ``probe`` (default ``df``; pass the source table
    when ``df`` is a reduction of it) holds at most ``max_rows`` rows, and those rows at
    ``df``'s estimated width fit in ``max_bytes``."""
    cap = min(max_rows, max_bytes // estimated_row_bytes(df.schema))
    if cap < 1:
        return df
    src = probe if probe is not None else df
    n = len(src.select(F.lit(1).alias("one")).take(cap + 1))
    return F.broadcast(df) if n <= cap else df


def anti_join(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``left`` whose key is absent from ``right`` (duplicates in ``left`` kept)."""
    return left.join(right, on, "left_anti")


def full_outer_distinct(left: DataFrame, right: DataFrame, cond: Column,
                        order: Sequence[str] | None = None) -> DataFrame:
    out = left.join(right, cond, "full_outer").distinct()
    return out.orderBy(*order) if order else out


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """Sort-then-limit; planned as ``TakeOrderedAndProject`` (per-task top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def sample_n(df: DataFrame, n: int, key: str | Column, seed: str = "0") -> DataFrame:
    """Repeatable pseudo-random sample of ``n`` rows: order by ``md5(key || seed)``.

    Same rows for the same data and seed, on any engine that has ``md5``.
    Ties on the hash are broken by the key itself.
    """
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat_ws("", k.cast("string"), F.lit(str(seed))))      # null key -> md5(seed), not null
    return df.withColumn("__h", h).orderBy("__h", k).limit(n).drop("__h")


def pivot_count(df: DataFrame, column: str, values: Sequence, group_by: Sequence[str] = ()) -> DataFrame:
    """One column per value with its row count; give ``values`` to skip the discovery job."""
    return df.groupBy(*group_by).pivot(column, list(values)).count().na.fill(0, [str(v) for v in values])
