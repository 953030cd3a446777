"""Event timeline: selection, day axis, alignment and train/test windows.

``event_windows`` takes, for every event, the last ``before`` series rows up to (and by
default including) the event day and the first ``after`` rows past it -- rows, not days,
as the source counts them.  It is built from equi-joins only, no range or nested-loop
join: the series is numbered per series key (one without keys by blocks of the calendar, with no
single-partition step); each event gets the number of the last
row at or before it (an as-of lookup done by one window over series rows + event
rows); the event then fans out to the row numbers of its window, which are joined
back.  Events are de-duplicated first (partial aggregation), so a date that occurs a
million times costs one window.  Work is linear in (series rows + events x window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.dates import day_number
from panelspark.operators.prefix import running
from panelspark.operators.relational import sample_n


def event_condition(order_type: str | None = None, event_type: str | None = "Effective",
                    exclude_category: str | None = None, order_type_col: str = "order_type",
                    event_type_col: str = "event_type", category_col: str = "category") -> Column:
    """Predicate for one event selection; OR several of them to select in a single scan."""
    cond = F.lit(True)
    if order_type is not None:
        cond = cond & (F.col(order_type_col) == order_type)
    if event_type is not None:
        cond = cond & (F.col(event_type_col) == event_type)
    if exclude_category is not None:
        cond = cond & (F.col(category_col) != exclude_category)
    return cond


def select_events(timeline: DataFrame, order_type: str | None = None, event_type: str | None = "Effective",
                  exclude_category: str | None = None, **cols: str) -> DataFrame:
    return timeline.where(event_condition(order_type, event_type, exclude_category, **cols))


def event_axis(events: DataFrame, date_col: str = "date", origin: str = "2020-01-01",
               out: str = "day_number") -> DataFrame:
    return events.withColumn(out, day_number(date_col, origin))


def align(left: DataFrame, right: DataFrame, on: str = "date", upto: str | None = None) -> DataFrame:
    """Full outer join on a shared date (coalesced key), optionally bounded ``date < upto``."""
    out = left.join(right, on, "full_outer")
    return out.where(F.col(on) < F.lit(upto).cast("date")) if upto else out


def sample_events(series: DataFrame, date_col: str, n: int, seed: str, after: str | None = None,
                  before: str | None = None, out: str = "event_date") -> DataFrame:
    """``n`` repeatable pseudo-random dates of the series strictly between ``after`` and ``before``."""
    d = series.select(F.col(date_col).alias(out)).distinct()
    if after:
        d = d.where(F.col(out) > F.lit(after).cast("date"))
    if before:
        d = d.where(F.col(out) < F.lit(before).cast("date"))
    return sample_n(d, n, out, seed)


def _number_by_key(s: DataFrame, ev: DataFrame, keys: list[str], include_event_day: bool) -> tuple[DataFrame, DataFrame]:
    """Series rows numbered within their keys, and each event with the number of the last row at its date."""
    numbered = s.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("ds")))

    # As-of lookup: series rows and events on one axis; an event sees the last row
    # number at its date.  kind orders same-day rows before (or after) the event.
    row_kind, event_kind = (0, 1) if include_event_day else (1, 0)
    axis = numbered.select(*keys, F.col("ds").alias("d"), "rn", F.lit(row_kind).alias("kind")).unionByName(
        ev.select(*keys, F.col("event_date").alias("d"), F.lit(None).cast("int").alias("rn"),
                  F.lit(event_kind).alias("kind")))
    w = Window.partitionBy(*keys).orderBy("d", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    anchored = (axis.withColumn("anchor", F.coalesce(F.max("rn").over(w), F.lit(0)))
                .where(F.col("rn").isNull())
                .select(*keys, F.col("d").alias("event_date"), "anchor"))
    return numbered, anchored


def _number_by_block(s: DataFrame, ev: DataFrame, include_event_day: bool) -> tuple[DataFrame, DataFrame]:
    """The same for one series without keys: one running count of series rows over the joint axis, by
    blocks of the calendar, numbers the rows and anchors the events."""
    row_kind, event_kind = (0, 1) if include_event_day else (1, 0)
    axis = s.select("ds", "y", F.lit(1).alias("row"), F.lit(row_kind).alias("kind")).unionByName(
        ev.select(F.col("event_date").alias("ds"), F.lit(0).alias("row"), F.lit(event_kind).alias("kind")),
        allowMissingColumns=True)
    axis = running(axis, "ds", ["ds", "kind"], {"rn": (F.sum, "row")}).withColumn("rn", F.col("rn").cast("int"))
    return (axis.where(F.col("row") == 1).select("ds", "y", "rn"),
            axis.where(F.col("row") == 0).select(F.col("ds").alias("event_date"), F.col("rn").alias("anchor")))


def event_windows(series: DataFrame, events: DataFrame, date_col: str = "date", value_col: str = "y",
                  before: int = 30, after: int = 10, keys: Sequence[str] = (),
                  event_col: str = "event_date", include_event_day: bool = True) -> DataFrame:
    """(*keys, event_date, split, ds, y): ``train`` = the ``before`` rows up to the event,
    ``test`` = the ``after`` rows following it.  ``series`` has one row per (keys, date);
    ``events`` carries ``event_col`` (and the series ``keys`` when there are several)."""
    if before < 0 or after < 0:
        raise ValueError("before and after must be >= 0")
    keys = list(keys)
    s = series.select(*keys, F.col(date_col).alias("ds"), F.col(value_col).alias("y"))
    ev = events.select(*keys, F.col(event_col).alias("event_date")).where(
        F.col("event_date").isNotNull()).distinct()

    numbered, anchored = (_number_by_key(s, ev, keys, include_event_day) if keys
                          else _number_by_block(s, ev, include_event_day))

    fan = anchored.select(*keys, "event_date", "anchor", F.explode(
        F.sequence(F.col("anchor") - F.lit(before - 1), F.col("anchor") + F.lit(after))).alias("rn")
    ).where((F.col("rn") >= 1) & F.lit(before + after > 0))
    out = fan.join(numbered, [*keys, "rn"], "inner")
    split = F.when(F.col("rn") <= F.col("anchor"), F.lit("train")).otherwise(F.lit("test"))
    return out.select(*keys, "event_date", split.alias("split"), "ds", "y")

