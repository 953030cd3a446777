"""Calendar baseline and share of expected volume.

Each day is compared with the mean of the days sharing its (ISO week, weekday[, by])
in the baseline years.  Year ranges become date bounds so Parquet scans prune.
Division is ``try_divide`` (ANSI mode raises on /0); the share is null where the
baseline has no matching calendar slot (ISO week 53, see ``functions.dates``).

``baseline_parts`` keeps a baseline mergeable: sums and counts by year and slot, a few thousand rows a
year.  Stored by year (``sources.write_parts``), they give the share of new days without reading
the old ones again; any range of stored years can be the baseline.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.dates import between_dates, calendar_keys, year_bounds

CAL_KEYS = ["week", "weekday"]


def calendar_baseline(df: DataFrame, date_col: str, value_col: str, by: Sequence[str] = (),
                      baseline_years: tuple[int, int] = (2017, 2019),
                      week53_to_52: bool = False, out: str = "baseline") -> DataFrame:
    lo, hi = year_bounds(*baseline_years)
    base = calendar_keys(df.where(between_dates(date_col, lo, hi)), date_col, week53_to_52)
    return base.groupBy(*CAL_KEYS, *by).agg(
        F.avg(value_col).alias(out), F.count(F.col(value_col)).alias("baseline_days"))


def share_of_baseline(df: DataFrame, date_col: str = "date", value_col: str = "total_volume",
                      by: Sequence[str] = (), baseline_years: tuple[int, int] = (2017, 2019),
                      compare_years: tuple[int, int | None] = (2020, None),
                      week53_to_52: bool = False) -> DataFrame:
    """(date, *by, value, baseline, share, pct_diff) for the compared years.

    One pass over the input: rows of both year ranges are read together (one scan filtered
    on both date ranges, merged into one when they touch), and the baseline is a windowed mean over each calendar slot
    (week, weekday, *by) restricted to baseline rows.  A slot holds one row per year and
    ``by`` value, so the window stays small however large the input, and no join is needed.
    """
    b_lo, b_hi = year_bounds(*baseline_years)
    c_lo, c_hi = year_bounds(*compare_years)
    in_base = between_dates(date_col, b_lo, b_hi)
    in_cmp = between_dates(date_col, c_lo, c_hi)
    # Touching or overlapping ranges reach the scan as one range, otherwise as their OR.
    if c_lo <= (b_hi or c_lo) and b_lo <= (c_hi or b_lo):
        scan = between_dates(date_col, min(b_lo, c_lo), None if None in (b_hi, c_hi) else max(b_hi, c_hi))
    else:
        scan = in_base | in_cmp
    rows = calendar_keys(df.where(scan), date_col, week53_to_52)
    slot = Window.partitionBy(*CAL_KEYS, *by)
    base = F.avg(F.when(in_base, F.col(value_col))).over(slot)
    out = rows.withColumn("baseline", base).where(in_cmp)
    share = F.try_divide(F.col(value_col).cast("double"), F.col("baseline"))
    return out.select(date_col, *by, value_col, "baseline",
                      share.alias("share"), (share - F.lit(1.0)).alias("pct_diff"))


def baseline_parts(df: DataFrame, date_col: str = "date", value_col: str = "total_volume", by: Sequence[str] = (),
                   week53_to_52: bool = False) -> DataFrame:
    """(year, week, weekday, *by, total, n_days): what the baseline needs of each year's days; days
    without a value do not count, as in the mean."""
    rows = calendar_keys(df, date_col, week53_to_52).withColumn("year", F.year(date_col))
    return rows.groupBy("year", *CAL_KEYS, *by).agg(
        F.sum(F.col(value_col).cast("double")).alias("total"), F.count(F.col(value_col)).alias("n_days"))


def baseline_from_parts(parts: DataFrame, by: Sequence[str] = (), baseline_years: tuple[int, int] = (2017, 2019),
                        out: str = "baseline") -> DataFrame:
    """The same (week, weekday, *by, baseline, baseline_days) as ``calendar_baseline`` over those years."""
    kept = parts.where(F.col("year").between(*baseline_years))
    return kept.groupBy(*CAL_KEYS, *by).agg(
        F.try_divide(F.sum("total"), F.sum("n_days").cast("double")).alias(out), F.sum("n_days").alias("baseline_days"))


def share_from_parts(df: DataFrame, parts: DataFrame, date_col: str = "date", value_col: str = "total_volume",
                     by: Sequence[str] = (), baseline_years: tuple[int, int] = (2017, 2019),
                     compare_years: tuple[int, int | None] = (2020, None), week53_to_52: bool = False) -> DataFrame:
    """``share_of_baseline`` with the baseline from stored parts: of ``df`` only the compared years
    are read.  Keys are compared null-safe, as the window of the one-pass form groups them."""
    lo, hi = year_bounds(*compare_years)
    rows = calendar_keys(df.where(between_dates(date_col, lo, hi)), date_col, week53_to_52)
    base = baseline_from_parts(parts, by, baseline_years)
    keys = [*CAL_KEYS, *by]
    base = base.select(*[F.col(k).alias(f"__{k}") for k in keys], "baseline")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    share = F.try_divide(F.col(value_col).cast("double"), F.col("baseline"))
    return rows.join(base, same, "left").select(date_col, *by, value_col, "baseline", share.alias("share"),
                                                (share - F.lit(1.0)).alias("pct_diff"))
