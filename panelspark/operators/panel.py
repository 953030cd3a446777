"""Panels (entity x date series): gaps, date spines, gap filling, running totals.

Windows here are always partitioned by the entity, and are meant for *daily-grain*
panels (one row per entity and day, as produced by the roll-ups): a partition then
holds at most one row per calendar day, whatever the size of the raw data.  With no
entity columns gaps and running totals reduce the rows to one per day and run by blocks of the
calendar (``operators.prefix``), so no task holds the whole series.  The spine of each entity runs from its own first
to its own last day (``sequence`` + ``explode``), never a global cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.prefix import running


def _w(entity_cols: Sequence[str], date_col: str):
    return Window.partitionBy(*entity_cols).orderBy(date_col) if entity_cols else Window.orderBy(date_col)


def gaps(df: DataFrame, entity_cols: Sequence[str], date_col: str = "date",
         out: str = "gap", prev_col: str = "prev_date") -> DataFrame:
    """Days since the entity's previous row (null for its first row).  Without entity columns the
    result is about the distinct days of the table: (date, prev_date, gap)."""
    if entity_cols:
        df = df.withColumn(prev_col, F.lag(date_col).over(_w(entity_cols, date_col)))
    else:
        df = running(df.select(date_col).distinct(), date_col, [date_col], {prev_col: (F.max, date_col)}, end=-1)
    return df.withColumn(out, F.datediff(F.col(date_col), F.col(prev_col)))


def gap_list(df: DataFrame, entity_cols: Sequence[str], date_col: str = "date",
             keep: Column | None = None, out: str = "gap") -> DataFrame:
    """Rows whose gap is not exactly one day (first rows, with a null gap, drop out),
    optionally only those matching ``keep`` (e.g. ``county != 'Unknown'``)."""
    g = gaps(df, entity_cols, date_col, out)
    g = g.where(F.col(out) != 1)
    return g.where(keep) if keep is not None else g


def _on_spine(df: DataFrame, entity_cols: Sequence[str], value_cols: Sequence[str], date_col: str,
              fills: Sequence[Column]) -> DataFrame:
    """Observed rows plus the missing days after each of them, in one pass.

    Each observed row expands to itself and the days up to (not including) the entity's
    next observed day (``lead`` over the entity's window), so the spine needs no separate
    min/max pass and no join back.  Added days hold ``fills``, one per value column and computed
    on the observed rows, nulls in the other columns, and ``filled = true``.  Several rows of one
    day all stay; the last of them expands.
    """
    w = Window.partitionBy(*entity_cols).orderBy(date_col, *value_cols) if entity_cols else Window.orderBy(
        date_col, *value_cols)
    next_day = F.date_sub(F.lead(date_col).over(w), 1)
    last_day = F.greatest(F.coalesce(next_day, F.col(date_col)), F.col(date_col))
    # explode_outer: a row with a null date passes through unchanged instead of vanishing.
    expanded = (df.withColumns({"__last": last_day, **{f"__fill{i}": f for i, f in enumerate(fills)}})
                .withColumn("__day", F.explode_outer(F.sequence(F.col(date_col), F.col("__last"),
                                                                F.expr("INTERVAL 1 DAY")))))
    filled = F.coalesce(F.col("__day") != F.col(date_col), F.lit(False))
    put = {v: F.when(filled, F.col(f"__fill{i}")).otherwise(F.col(v)) for i, v in enumerate(value_cols)}
    other = [c for c in df.columns if c not in entity_cols and c != date_col]
    return expanded.select(*entity_cols, F.col("__day").alias(date_col),
                           *[put.get(c, F.when(~filled, F.col(c))).alias(c) for c in other], filled.alias("filled"))


def _rows_by_day(entity_cols: Sequence[str], value_cols: Sequence[str], date_col: str):
    w = Window.partitionBy(*entity_cols) if entity_cols else Window
    return w.orderBy(date_col, *value_cols)


def fill_last(df: DataFrame, entity_cols: Sequence[str], value_cols: Sequence[str],
              date_col: str = "date") -> DataFrame:
    """Add missing days; each missing value repeats the last observed one.

    Observed rows are left untouched and a ``filled`` flag marks the added days.  Of several rows of
    one day the last in the order of their values counts.
    """
    w = _rows_by_day(entity_cols, value_cols, date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _on_spine(df, entity_cols, value_cols, date_col, [F.last(v, ignorenulls=True).over(w) for v in value_cols])


def fill_mean(df: DataFrame, entity_cols: Sequence[str], value_cols: Sequence[str],
              date_col: str = "date", k: int = 2) -> DataFrame:
    """Add missing days; every day of a gap gets the mean of the last ``k`` observed rows before
    the gap and the first ``k`` after it, however long the gap is."""
    w = _rows_by_day(entity_cols, value_cols, date_col).rowsBetween(-(k - 1), k)
    return _on_spine(df, entity_cols, value_cols, date_col, [F.avg(v).over(w) for v in value_cols])


def running_total(df: DataFrame, entity_cols: Sequence[str], value_cols: Sequence[str],
                  date_col: str = "date", suffix: str = "") -> DataFrame:
    """Running sums of each entity.  Without entity columns the days are summed first: the result
    has the date and the sums only."""
    if not entity_cols:
        days = df.groupBy(date_col).agg(*[F.sum(v).alias(v) for v in value_cols])
        made = running(days, date_col, [date_col], {f"_running_{v}": (F.sum, v) for v in value_cols})
        names = {f"_running_{v}": f"{v}{suffix}" for v in value_cols}
        return (made if suffix else made.drop(*value_cols)).withColumnsRenamed(names)
    w = _w(entity_cols, date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({f"{v}{suffix}": F.sum(v).over(w) for v in value_cols})


def daily_from_total(df: DataFrame, entity_cols: Sequence[str], total_cols: Sequence[str],
                     date_col: str = "date", suffix: str = "_daily") -> DataFrame:
    """Daily increments from running totals: the total less the entity's last known one (0 before
    the first).  A day without a total has no increment, and the next total counts from the last
    known one: 100, null, 105 gives 100, null, 5."""
    w = _w(entity_cols, date_col).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({
        f"{c}{suffix}": F.col(c) - F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0)) for c in total_cols})
