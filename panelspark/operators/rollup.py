"""Roll-ups: wide hourly records to daily totals, group sums and means.

All of these are hash aggregations with a map-side partial step, so a hot key is
combined inside each task before anything crosses the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.sources.schemas import HOUR_COLUMNS


def hours_to_daily(df: DataFrame, keys: Sequence[str] = ("station_id", "date"),
                   hour_cols: Sequence[str] = HOUR_COLUMNS, null_as_zero: bool = False,
                   out: str = "total_volume", out_zero_filled: str | None = None) -> DataFrame:
    """Sum every hour column over the rows of a key (lanes, directions), then add the hours.

    A null hour sum (no value for that hour on any lane) makes the day null, as in the
    source; ``null_as_zero=True`` counts it as 0 instead.  ``out_zero_filled`` adds the
    zero-filled total as a second column from the same aggregation.
    """
    sums = [F.sum(F.col(h)).alias(h) for h in hour_cols]
    daily = df.groupBy(*keys).agg(*sums)
    strict = reduce(add, [F.col(h) for h in hour_cols])
    filled = reduce(add, [F.coalesce(F.col(h), F.lit(0)) for h in hour_cols])
    cols = [(filled if null_as_zero else strict).alias(out)]
    if out_zero_filled:
        cols.append(filled.alias(out_zero_filled))
    return daily.select(*keys, *cols)


def wide_by_hour(df: DataFrame, keys: Sequence[str], ts_col: str, value: Column | None = None,
                 hour_cols: Sequence[str] = HOUR_COLUMNS) -> DataFrame:
    """Build a wide hourly record from timestamped rows: hour h (1-based) = sum of ``value``
    (default: row count) over rows in clock hour h-1; null where there are none."""
    v = value if value is not None else F.lit(1)
    hr = F.hour(F.col(ts_col))
    aggs = [F.sum(F.when(hr == i, v)).alias(h) for i, h in enumerate(hour_cols)]
    return df.groupBy(*keys).agg(*aggs)


def group_sum(df: DataFrame, keys: Sequence[str], value: str | Column, out: str) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*keys).agg(F.sum(v).alias(out))


def group_mean(df: DataFrame, keys: Sequence[str], values: Mapping[str, str | Column]) -> DataFrame:
    """Mean of several measures per key; ``values`` maps output name -> column."""
    aggs = [F.avg(F.col(v) if isinstance(v, str) else v).alias(o) for o, v in values.items()]
    return df.groupBy(*keys).agg(*aggs)


def group_count(df: DataFrame, keys: Sequence[str], out: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), *keys)


def minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*aggs)
