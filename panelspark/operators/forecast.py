"""Per-event forecast from Spark aggregates: linear trend x multiplicative weekday index.

For every (series, event) at once, over its training rows, with x = days from the event:

* trend ``m*x + b`` by least squares (``regr_slope`` / ``regr_intercept``);
* weekday index ``s(w)`` = mean of ``y / trend`` per weekday (1 where unseen or undefined);
* ``yhat = trend * s``; the band is ``yhat +- 1.96 * stddev_samp(y - yhat)`` of the training fit
  (``interval="constant"``), or the prediction interval of the trend's normal equations
  (``interval="prediction"``): with the training days' mean x and Sxx, n of them and
  s^2 = SSE / (n - 2), ``yhat +- 1.96 * s * sqrt(1 + 1/n + (x - mean)^2 / Sxx)``, which widens
  with the days from the event (null for fewer than three values or only one day);
* predictions for the training days (history) and the ``horizon`` days after the event.

Plan: training rows, test rows and, for a forecast, the future days go into one frame that is
hash-partitioned once by the event key; the trend, the weekday index and the residual
spread are window aggregates over (event) and (event, weekday), which that partitioning
already satisfies, so the whole fit is one shuffle plus sorts -- no aggregate-and-join
round trips.  A partition never exceeds one event's window (``before + after + horizon``
rows), however many events there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96
INTERVALS = ("constant", "prediction")


def _fitted(windows: DataFrame, keys: Sequence[str], future_days: int = 0) -> DataFrame:
    """Every window row, and ``future_days`` after each event, with yhat and the residual spread sd."""
    g = [*keys, "event_date"]
    rows = windows.select(*g, "split", "ds", F.col("y").cast("double").alias("y"))
    if future_days:
        days = F.sequence(F.date_add("event_date", 1), F.date_add("event_date", future_days))
        rows = rows.unionByName(windows.select(*g).distinct().select(
            *g, F.lit("future").alias("split"), F.explode(days).alias("ds"), F.lit(None).cast("double").alias("y")))
    rows = (rows.repartition(*g)
            .withColumn("x", F.datediff("ds", "event_date").cast("double"))
            .withColumn("wd", F.dayofweek("ds")))
    ty = F.when(F.col("split") == "train", F.col("y"))
    ev = Window.partitionBy(*g)
    rows = rows.withColumns({
        "m": F.coalesce(F.regr_slope(ty, F.col("x")).over(ev), F.lit(0.0)),
        "b": F.coalesce(F.regr_intercept(ty, F.col("x")).over(ev), F.avg(ty).over(ev)),
    })
    line = F.col("m") * F.col("x") + F.col("b")
    s = F.avg(F.try_divide(ty, line)).over(Window.partitionBy(*g, "wd"))
    rows = rows.withColumn("yhat", line * F.coalesce(s, F.lit(1.0)))
    resid = F.when(F.col("split") == "train", F.col("y") - F.col("yhat"))
    known = F.when(ty.isNotNull(), F.col("x"))
    return rows.withColumns({
        "sd": F.stddev_samp(resid).over(ev),
        "sse": F.sum(F.pow(resid, 2)).over(ev),
        "n_train": F.count(ty).over(ev),
        "x_mean": F.avg(known).over(ev),
        "sxx": F.regr_sxx(ty, F.col("x")).over(ev),
        "has_train": F.max((F.col("split") == "train").cast("int")).over(ev) == 1,
    })


def _half_width(interval: str, z: float) -> Column:
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {INTERVALS}, not {interval!r}")
    if interval == "constant":
        return F.lit(z) * F.col("sd")
    spread = F.sqrt(F.col("sse") / F.when(F.col("n_train") > 2, F.col("n_train") - 2))
    leverage = 1 / F.when(F.col("n_train") > 0, F.col("n_train")) + F.try_divide(F.pow(F.col("x") - F.col("x_mean"), 2), F.col("sxx"))
    return F.lit(z) * spread * F.sqrt(1 + leverage)


def fit_forecast(windows: DataFrame, keys: Sequence[str] = (), horizon: int = 10,
                 z: float = Z95, interval: str = "constant") -> DataFrame:
    """(*keys, event_date, ds, yhat, yhat_lower, yhat_upper) for the training days and the
    ``horizon`` days after each event that has training rows (predictions are null when
    none of those rows has a value)."""
    g = [*keys, "event_date"]
    if horizon < 0:
        raise ValueError("horizon must be >= 0")
    half = _half_width(interval, z)
    f = _fitted(windows, keys, horizon).where(F.col("split").isin("train", "future") & F.col("has_train"))
    return f.select(*g, "ds", "yhat", (F.col("yhat") - half).alias("yhat_lower"), (F.col("yhat") + half).alias("yhat_upper"))


def interval_coverage(windows: DataFrame, keys: Sequence[str] = (), horizon: int = 10, z: float = Z95,
                      interval: str = "prediction") -> DataFrame:
    """(*keys, event_date, split, n, covered, share, mean_width): how many of the rows with a value and a
    band lie within it, straight from the fitted frame.  A 95 % band should hold 95 % of the test rows."""
    half = _half_width(interval, z)
    f = _fitted(windows, keys).where(F.col("has_train") & ((F.col("split") == "train") | (F.datediff("ds", "event_date") <= horizon)))
    banded = F.col("y").isNotNull() & F.col("yhat").isNotNull() & half.isNotNull()
    inside = banded & (F.abs(F.col("y") - F.col("yhat")) <= half)
    return f.groupBy(*keys, "event_date", "split").agg(
        F.count_if(banded).alias("n"), F.count_if(inside).alias("covered"),
        F.try_divide(F.count_if(inside).cast("double"), F.count_if(banded)).alias("share"),
        F.avg(F.when(banded, 2 * half)).alias("mean_width"))


def forecast_scores(windows: DataFrame, keys: Sequence[str] = (), horizon: int = 10) -> DataFrame:
    """(*keys, event_date, split, rmse, n, sse) straight from the fitted frame: the same
    figures as ``evaluate.rmse(windows, fit_forecast(windows))`` without the join.  Test
    days past the forecast horizon have no prediction and are left out, as in the join."""
    g = [*keys, "event_date"]
    f = _fitted(windows, keys)
    has_pred = (F.col("split") == "train") | (F.datediff("ds", "event_date") <= horizon)
    yhat = F.when(has_pred & F.col("has_train"), F.col("yhat"))
    sq = F.pow(yhat - F.col("y"), 2)
    return f.groupBy(*g, "split").agg(
        F.sqrt(F.avg(sq)).alias("rmse"), F.count(sq).alias("n"), F.sum(sq).alias("sse"))
