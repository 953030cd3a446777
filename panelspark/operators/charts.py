"""Chart-ready long tables.  Drawing is left to the caller; these stay DataFrames until a
chart-sized result is brought to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.dates import day_number


NULL_LABEL = "(null)"


def label(columns: Sequence[str]) -> Column:
    """One text of the columns, ``all`` without any; a null shows as ``(null)``."""
    if not columns:
        return F.lit("all")
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_LABEL)) for c in columns])


def panels(df: DataFrame, panel_cols: Sequence[str], date_col: str, measures: Sequence[str],
           panel_name: str = "panel") -> DataFrame:
    """(panel, date, measure, value): one row per panel, day and measure."""
    panel = label(panel_cols)
    base = df.select(panel.alias(panel_name), F.col(date_col).alias("date"),
                     *[F.col(m).cast("double").alias(m) for m in measures])
    return base.unpivot([panel_name, "date"], list(measures), "measure", "value")


def markers(events: DataFrame, date_col: str, kind_col: str, origin: str = "2020-01-01") -> DataFrame:
    """(event_date, day_number, kind) for vertical event lines."""
    return events.select(F.col(date_col).alias("event_date"),
                         day_number(date_col, origin).alias("day_number"),
                         F.col(kind_col).alias("kind"))


def forecast_lines(windows: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, event_date, ds, measure, value): the actual rows, the forecast and its band."""
    g = [*keys, "event_date", "ds"]
    actual = windows.select(*g, F.lit("actual").alias("measure"), F.col("y").cast("double").alias("value"))
    drawn = forecast.select(*g, F.col("yhat").alias("forecast"), F.col("yhat_lower").alias("lower"),
                            F.col("yhat_upper").alias("upper"))
    return actual.unionByName(drawn.unpivot(g, ["forecast", "lower", "upper"], "measure", "value"))
