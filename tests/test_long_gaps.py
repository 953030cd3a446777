"""Gap filling, increments, short windows, null labels and the options of the workflow."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark import traffic as T
from panelspark.operators.charts import forecast_lines, panels
from panelspark.operators.events import event_windows
from panelspark.operators.forecast import fit_forecast
from panelspark.operators.panel import daily_from_total, fill_last, fill_mean, gaps, running_total
from tests.test_traffic import _sources

D = dt.date


def test_mean_fills_the_whole_of_a_long_gap(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1), 10.0), ("a", D(2020, 1, 9), 20.0), ("a", D(2020, 1, 10), 60.0)],
                               "e string, date date, v double")
    got = {r.date.day: (r.v, r.filled) for r in fill_mean(df, ["e"], ["v"], k=2).collect()}
    # Before the gap only 10 was seen, after it 20 and 60: every day of it gets 30.
    assert got == {1: (10.0, False), 9: (20.0, False), 10: (60.0, False), **{d: (30.0, True) for d in range(2, 9)}}


def test_mean_takes_k_rows_on_either_side(spark):
    days = [(1, 1.0), (2, 2.0), (3, 3.0), (6, 10.0), (7, 20.0), (8, 90.0)]
    df = spark.createDataFrame([("a", D(2020, 1, d), v) for d, v in days], "e string, date date, v double")
    for k, want in ((1, 6.5), (2, 8.75), (3, 21.0)):
        assert {r.v for r in fill_mean(df, ["e"], ["v"], k=k).where("filled").collect()} == {want}


def test_repeated_days_stay_and_do_not_stop_the_fill(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 1), 2.0), ("a", D(2020, 1, 3), 4.0)],
                               "e string, date date, v double")
    for fill, want in ((fill_last, 2.0), (fill_mean, 7.0 / 3)):
        rows = sorted((r.date.day, r.v, r.filled) for r in fill(df, ["e"], ["v"]).collect())
        assert rows == [(1, 1.0, False), (1, 2.0, False), (2, want, True), (3, 4.0, False)]


def test_increments_pass_over_unknown_totals(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1), None), ("a", D(2020, 1, 2), 100), ("a", D(2020, 1, 3), None),
                                ("a", D(2020, 1, 4), None), ("a", D(2020, 1, 5), 105)], "e string, date date, t int")
    got = [r.t_daily for r in daily_from_total(df, ["e"], ["t"]).orderBy("date").collect()]
    assert got == [None, 100, None, None, 5]


def test_no_entity_means_one_row_a_day(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1), 1), ("b", D(2020, 1, 1), 2), ("a", D(2020, 1, 4), 5)],
                               "e string, date date, v int")
    assert [(r.date.day, r.gap) for r in gaps(df, []).orderBy("date").collect()] == [(1, None), (4, 3)]
    assert [r.v_cum for r in running_total(df, [], ["v"], suffix="_cum").orderBy("date").collect()] == [3, 8]


def test_short_windows_at_the_ends_of_a_series(spark):
    series = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(i), float(i % 7 + 1)) for i in range(20)], "date date, y double")
    events = spark.createDataFrame([(D(2020, 1, 3),), (D(2020, 1, 18),)], "event_date date")
    w = event_windows(series, events, "date", "y", 30, 10)
    n = {(r.event_date.day, r.split): r["count"] for r in w.groupBy("event_date", "split").count().collect()}
    assert n == {(3, "train"): 3, (3, "test"): 10, (18, "train"): 18, (18, "test"): 2}
    lines = forecast_lines(w, fit_forecast(w))
    kinds = {(r.event_date.day, r.measure): r["count"] for r in lines.groupBy("event_date", "measure").count().collect()}
    assert kinds[(3, "actual")] == 13 and kinds[(3, "forecast")] == 13 and kinds[(18, "actual")] == 20
    assert kinds[(18, "lower")] == kinds[(18, "upper")] == 28


def test_null_labels_differ_by_column(spark):
    df = spark.createDataFrame([(None, "x", 1.0), ("x", None, 2.0)], "a string, b string, v double").withColumn(
        "date", F.lit("2020-01-01").cast("date"))
    assert {r.panel for r in panels(df, ["a", "b"], "date", ["v"]).collect()} == {"(null)|x", "x|(null)"}


def test_prepare_fills_on_request_and_model_counts_days(spark):
    src = _sources(spark, "traffic-fill")
    plain, last, mean = (T.prepare(src, **o) for o in ({}, {"fill_volume": "last", "fill_cases": "last"},
                                                       {"fill_volume": "mean", "fill_cases": "mean"}))
    days = (D(2021, 3, 1) - D(2018, 3, 5)).days + 1
    one = F.col("station_id") == 1
    assert plain["county_volume"].where(one).count() == 93
    for t in (last, mean):
        assert t["county_volume"].where(one).count() == days
        assert t["county_volume"].where("total_volume is null").count() == 0
    cases = {r.date: r.cases for r in last["county_cases"].where("county = 'Saint Louis'").collect()}
    assert len(cases) == 365 and cases[D(2020, 6, 1)] == 5
    assert last["county_volume"].schema == plain["county_volume"].schema
    out = T.model(spark, plain, ["2020-02-15"], n_base_dates=1)
    assert {r.cases_daily for r in out["state_daily_cases"].where("date > '2020-01-02'").collect()} == {1}
    assert [r.deaths_daily for r in out["national_daily_cases"].collect()] == [2]
    louis = [(r.cases, r.cases_daily) for r in out["county_daily_cases"].where("county = 'Saint Louis'").orderBy("date").collect()]
    assert louis == [(5, 5), (50, 45)]
    assert {r.measure for r in out["chart_aligned"].select("measure").distinct().collect()} == {"share", "cases", "deaths"}
    assert {r.panel for r in out["chart_state"].select("panel").distinct().collect()} == {"all"}
    assert {r.measure for r in out["chart_covid_forecast"].select("measure").distinct().collect()} == {
        "actual", "forecast", "lower", "upper"}


def test_coverage_shows_raw_spellings_too(spark):
    src = _sources(spark, "traffic-raw")
    cov = {(r.comparison, r.name) for r in T.coverage_report(src).collect()}
    assert {("stations~cases raw", "St. Louis"), ("stations~cases raw", "St Louis"),
            ("cases~districts raw", "St. Louis")} <= cov
    assert not any(c in ("stations~cases", "cases~districts") and n in ("St. Louis", "St Louis") for c, n in cov)
