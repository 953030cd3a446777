"""Distinct counts that can be merged: one HyperLogLog sketch for each part and column.

A part is a year, say.  Its sketches come from one aggregation over the part, are a few KB each and
are stored by part (``sources.write_parts``), so a new year is read alone and merged with what is
stored; a year that comes again replaces its own sketches only.  Any choice of parts can be merged.
The relative error is about 1.04 / sqrt(2 ** lg_k), 1.6 % by default, and small counts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType

LG_K = 12
_DIRECT = (IntegerType, LongType, StringType, BinaryType)


def _value(df: DataFrame, column: str) -> Column:
    """What is sketched: types that the sketches do not take go in as text."""
    return F.col(column) if isinstance(df.schema[column].dataType, _DIRECT) else F.col(column).cast("string")


def key_sketch(*columns: str) -> Column:
    """One value of a key of several columns, null only if all are: lengths keep the parts apart."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
             for c in columns]
    return F.concat(*parts)


def part_sketches(df: DataFrame, part_col: str, columns: Sequence[str], keys: Sequence[Sequence[str]] = (),
                  lg_k: int = LG_K) -> DataFrame:
    """(part_col, column, sketch, n_rows, n_known) in one aggregation; ``keys`` add sketches of whole
    keys, named like ``a,b``, in which nulls are values."""
    named = [(c, _value(df, c)) for c in columns] + [(",".join(k), key_sketch(*k)) for k in keys]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, (_, value) in enumerate(named):
        aggs += [F.hll_sketch_agg(value, F.lit(lg_k)).alias(f"__s{i}"), F.count(value).alias(f"__n{i}")]
    rows = F.inline(F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"__s{i}").alias("sketch"),
                                       F.col(f"__n{i}").alias("n_known")) for i, (name, _) in enumerate(named)]))
    return df.groupBy(part_col).agg(*aggs).select(part_col, "n_rows", rows).select(part_col, "column", "sketch", "n_rows", "n_known")


def merged_counts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, column, n_distinct, n_rows, n_known) over all parts, or by some of their columns."""
    return sketches.groupBy(*by, "column").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"), F.sum("n_rows").alias("n_rows"),
        F.sum("n_known").alias("n_known"))


def sketch_report(sketches: DataFrame, table: str, keys: Sequence[Sequence[str]] = (), by: Sequence[str] = (),
                  tolerance: float = 0.05) -> DataFrame:
    """Merged counts in the shape of the quality reports: ``distinct(c)`` next to the known values, and for
    keys ``unique(a,b)``, which passes if the estimate is within ``tolerance`` of the rows."""
    names = [",".join(k) for k in keys]
    m = merged_counts(sketches, by)
    is_key = F.col("column").isin(*names) if names else F.lit(False)
    near = F.abs(F.col("n_distinct") - F.col("n_rows")) <= tolerance * F.col("n_rows")
    group = F.concat_ws("/", *[F.col(c).cast("string") for c in by]) if by else F.lit("all")
    return m.select(F.lit(table).alias("table"), group.alias("group"),
                    F.concat(F.when(is_key, "unique(").otherwise("distinct("), "column", F.lit(")")).alias("check"),
                    F.col("n_distinct").cast("double").alias("observed"),
                    F.when(is_key, F.col("n_rows")).otherwise(F.col("n_known")).cast("double").alias("expected"),
                    F.when(is_key, near).alias("passed"))
