"""Stored parts: distinct sketches and baseline sums merged by year, old years unread; forecast bands."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators.baseline import baseline_parts, calendar_baseline, baseline_from_parts, share_from_parts, share_of_baseline
from panelspark.operators.forecast import fit_forecast, interval_coverage
from panelspark.operators.sketches import merged_counts, part_sketches, sketch_report
from panelspark.session import scratch_path
from panelspark.sources.io import write_parts


def test_a_new_year_is_sketched_alone_and_merged(spark):
    path = scratch_path(spark, "sk")

    def year(y, a, b):
        return spark.range(a, b).select(F.lit(y).alias("year"), F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("d"),
                                        F.when(F.col("id") % 2 == 0, "x").alias("s"))

    for y, a, b in ((2019, 0, 3000), (2020, 1000, 5000), (2019, 0, 2000)):     # 2019 comes again, shorter
        write_parts(part_sketches(year(y, a, b), "year", ["k", "d", "s"], keys=[["k", "s"]]), path, "year")
    stored = spark.read.parquet(path)
    got = {r.column: (r.n_distinct, r.n_rows, r.n_known) for r in merged_counts(stored).collect()}
    assert got["d"] == (7, 6000, 6000) and got["s"] == (1, 6000, 3000)
    assert abs(got["k"][0] - 5000) < 250 and got["k"][1:] == (6000, 6000)
    by_year = {(r.year, r.column): r.n_distinct for r in merged_counts(stored, ["year"]).collect()}
    assert abs(by_year[2019, "k"] - 2000) < 100 and by_year[2020, "d"] == 7
    rep = {(r.group, r.check): r.passed for r in sketch_report(stored, "t", [["k", "s"]], ["year"]).collect()}
    assert rep["2019", "unique(k,s)"] and rep["2020", "distinct(k)"] is None
    whole = {r.check: r.passed for r in sketch_report(stored, "t", [["k", "s"]]).collect()}
    assert whole["unique(k,s)"] is False


def _days(spark, rows):
    return spark.createDataFrame(rows, "date date, district string, total_volume double")


def test_share_from_stored_parts_is_the_one_pass_share(spark):
    rng, path = random.Random(1), scratch_path(spark, "parts")
    rows = []
    for i in range(4 * 365):
        day = dt.date(2017, 1, 1) + dt.timedelta(i)
        rows += [(day, d, float(rng.randrange(100)) if rng.random() < 0.9 else None) for d in ("1", "2", None) if rng.random() < 0.95]
    df = _days(spark, rows)
    for y in (2017, 2018, 2019):
        write_parts(baseline_parts(df.where(F.year("date") == y), by=["district"]), path, "year")
    new_only = df.where(F.year("date") == 2020)                          # the old fact years are not there
    parts = spark.read.parquet(path)

    def key(r):
        return (r.date, r.district or "")

    want = sorted(share_of_baseline(df, by=["district"]).collect(), key=key)
    got = sorted(share_from_parts(new_only, parts, by=["district"]).collect(), key=key)
    assert len(got) == len(want) > 900
    for g, w in zip(got, want, strict=True):
        assert (g.date, g.district, g.total_volume) == (w.date, w.district, w.total_volume)
        assert (g.share is None) == (w.share is None) and (g.share is None or math.isclose(g.share, w.share, rel_tol=1e-9))
    base = {(r.week, r.weekday, r.district): (round(r.baseline, 9), r.baseline_days) for r in
            calendar_baseline(df, "date", "total_volume", ["district"], (2017, 2018)).collect() if r.baseline is not None}
    merged = {(r.week, r.weekday, r.district): (round(r.baseline, 9), r.baseline_days) for r in
              baseline_from_parts(parts, ["district"], (2017, 2018)).collect() if r.baseline is not None}
    assert base == merged


def _window(spark, ys):
    e = dt.date(2020, 3, 15)
    rows = [(e, "train" if i <= 0 else "test", e + dt.timedelta(i), y) for i, y in ys]
    return spark.createDataFrame(rows, "event_date date, split string, ds date, y double")


def test_prediction_band_is_the_textbook_one_and_widens(spark):
    rng = random.Random(2)
    ys = [(i, 100 + 2.0 * i + rng.gauss(0, 3)) for i in range(-29, 11)]
    w = _window(spark, ys)
    rows = sorted(fit_forecast(w, horizon=10, interval="prediction").collect(), key=lambda r: r.ds)
    xs = [i for i, _ in ys if i <= 0]
    yhat = {(r.ds - dt.date(2020, 3, 15)).days: r.yhat for r in rows}
    n, mean = len(xs), sum(xs) / len(xs)
    sxx = sum((x - mean) ** 2 for x in xs)
    s = math.sqrt(sum((y - yhat[i]) ** 2 for i, y in ys if i <= 0) / (n - 2))
    for r in rows:
        x = (r.ds - dt.date(2020, 3, 15)).days
        half = 1.96 * s * math.sqrt(1 + 1 / n + (x - mean) ** 2 / sxx)
        assert math.isclose(r.yhat_upper - r.yhat, half, rel_tol=1e-9) and math.isclose(r.yhat - r.yhat_lower, half, rel_tol=1e-9)
    widths = [r.yhat_upper - r.yhat_lower for r in rows if r.ds > dt.date(2020, 3, 15)]
    assert len(widths) == 10 and widths == sorted(widths) and widths[-1] > widths[0]
    flat = [r.yhat_upper - r.yhat_lower for r in fit_forecast(w, horizon=10).collect()]
    assert max(flat) - min(flat) < 1e-9
    band = {(r.ds - dt.date(2020, 3, 15)).days: (r.yhat_lower, r.yhat_upper) for r in rows}
    cover = {r.split: (r.n, r.covered, r.share) for r in interval_coverage(w).collect()}
    inside = sum(band[i][0] <= y <= band[i][1] for i, y in ys if i > 0)
    assert cover["test"] == (10, inside, inside / 10) and cover["train"][0] == 30


def test_bands_without_enough_values_are_null(spark):
    w = _window(spark, [(-1, 5.0), (0, 6.0), (1, 7.0), (2, None)])
    assert {(r.yhat_lower, r.yhat_upper) for r in fit_forecast(w, horizon=2, interval="prediction").collect()} == {(None, None)}
    assert {r.split: (r.n, r.covered, r.share) for r in interval_coverage(w).collect()} == {"train": (0, 0, None), "test": (0, 0, None)}
    with pytest.raises(ValueError):
        fit_forecast(w, interval="other")
