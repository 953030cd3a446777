"""Forecast scoring: RMSE per (event, split) and summaries over events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ["train", "test"]


def rmse(windows: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, event_date, split, rmse, n, sse): actuals left-joined with the forecast."""
    g = [*keys, "event_date"]
    a = windows.join(forecast.select(*g, "ds", "yhat"), [*g, "ds"], "left")
    sq = F.pow(F.col("yhat") - F.col("y"), 2)
    return a.groupBy(*g, "split").agg(
        F.sqrt(F.avg(sq)).alias("rmse"), F.count(sq).alias("n"), F.sum(sq).alias("sse"))


def rmse_summary(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per event one column per split, then two summary rows: the mean of per-event RMSEs
    (as coded in the source) and the RMSE pooled over all points (as its prose says).

    Columns: kind ('event' | 'mean' | 'pooled'), *keys, event_date, train_rmse, test_rmse.
    One pass: per-event figures, then grouping sets (event) and (all events) over them.
    """
    g = [*keys, "event_date"]

    def by_split(c, s):
        return F.max(F.when(F.col("split") == s, F.col(c)))

    per_event = scores.groupBy(*g).agg(*[by_split(c, s).alias(f"{s}_{c}") for s in SPLITS for c in ("rmse", "sse", "n")])
    agg = per_event.groupingSets([list(g), list(keys)], *g).agg(
        F.grouping("event_date").alias("__total"),
        *[F.avg(f"{s}_rmse").alias(f"{s}_mean") for s in SPLITS],
        *[F.sqrt(F.try_divide(F.sum(f"{s}_sse"), F.sum(f"{s}_n").cast("double"))).alias(f"{s}_pooled")
          for s in SPLITS])
    rows = F.when(F.col("__total") == 0, F.array(F.struct(
        F.lit("event").alias("kind"), *[F.col(f"{s}_mean").alias(f"{s}_rmse") for s in SPLITS]))).otherwise(
        F.array(F.struct(F.lit("mean").alias("kind"), *[F.col(f"{s}_mean").alias(f"{s}_rmse") for s in SPLITS]),
                F.struct(F.lit("pooled").alias("kind"), *[F.col(f"{s}_pooled").alias(f"{s}_rmse") for s in SPLITS])))
    return agg.select(*g, F.inline(rows)).select("kind", *g, *[f"{s}_rmse" for s in SPLITS])
