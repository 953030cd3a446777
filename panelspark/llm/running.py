"""Running totals over a global order without a window over all rows.

Rows carry a fine bucket number that rises with the order; a window sorts one fine bucket, the
totals of fine buckets are summed within coarse ones, and the totals of coarse ones last.  With
F rows a fine bucket and COARSE fine buckets a coarse one, the last window has n / (F * COARSE)
rows, so no task holds a group that grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FINE_ROWS = 2048
COARSE = 1024


def fine_bucket(position: Column, rows: Column) -> Column:
    """Fine bucket of a position in [0, 1] along the order of ``rows`` rows."""
    n = F.greatest(F.ceil(rows / F.lit(float(FINE_ROWS))), F.lit(1))
    return F.least(F.floor(position * n), n - 1).cast("long")


def add_total_before(df: DataFrame, group: str, bucket: str, order: list, value: str, out: str, rank: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows before this one in its group's order.

    ``bucket`` must rise with ``order``; ``rank`` gets the row's number within its bucket, so
    (group, bucket, rank) names the row.  ``group`` and ``bucket`` must not be null.
    """
    inner = Window.partitionBy(group, bucket).orderBy(*order)
    rows = df.withColumns({
        rank: F.row_number().over(inner),
        out: F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)})
    cell = (df.groupBy(F.col(group).alias("_g"), F.col(bucket).alias("_b")).agg(F.sum(value).alias("_v"))
            .withColumn("_c", F.floor(F.col("_b") / COARSE)))
    coarse = (cell.groupBy("_g", "_c").agg(F.sum("_v").alias("_w"))
              .withColumn("_before", F.sum("_w").over(
                  Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w"))
              .drop("_w"))
    fine = cell.withColumn("_in", F.sum("_v").over(
        Window.partitionBy("_g", "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v"))
    start = fine.join(coarse, ["_g", "_c"]).select("_g", "_b", (F.col("_in") + F.col("_before")).alias("_start"))
    return (rows.join(start, (rows[group] == start["_g"]) & (rows[bucket] == start["_b"]))
            .withColumn(out, F.col(out) + F.col("_start")).drop("_g", "_b", "_start"))
