"""Literal cases with hand-computed answers (FIXTURES.md, cases 1-15)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from panelspark.functions.dates import day_number, parse_mixed_dates
from panelspark.functions.text import (
    COUNTY_CORRECTIONS,
    COUNTY_PREFIX_RULES,
    DISTRICT_OVERRIDES,
    apply_corrections,
    clean_text,
    override,
)
from panelspark.operators import quality as Q
from panelspark.operators.baseline import share_of_baseline
from panelspark.operators.dims import attach, merge_dimension
from panelspark.operators.evaluate import rmse
from panelspark.operators.events import event_windows
from panelspark.operators.forecast import fit_forecast
from panelspark.operators.panel import daily_from_total, fill_last, fill_mean, gaps
from panelspark.operators.relational import anti_join, pivot_count
from panelspark.operators.rollup import hours_to_daily
from panelspark.sources.schemas import HOUR_COLUMNS, HOURLY_VOLUME

D = dt.date
NBSP = "\u00a0"


def _hourly_row(station, direction, lane, date, values):
    return (station, direction, lane, date, *values)


def test_hourly_to_daily(spark):
    rows = [
        _hourly_row(1, 1, 1, "2020-03-02", [10] * 24),
        _hourly_row(1, 5, 1, "2020-03-02", [5] * 24),
        _hourly_row(2, 1, 1, "2020-03-02", [10] * 6 + [None] + [10] * 17),
    ]
    df = spark.createDataFrame(rows, HOURLY_VOLUME)
    strict = {r.station_id: r.total_volume for r in hours_to_daily(df).collect()}
    assert strict == {1: 360, 2: None}
    filled = {r.station_id: r.total_volume for r in hours_to_daily(df, null_as_zero=True).collect()}
    assert filled == {1: 360, 2: 230}
    assert len(HOUR_COLUMNS) == 24


def test_parse_mixed_dates(spark):
    df = spark.createDataFrame([("2020-12-31",), ("1/5/2021",), ("12/31/2021",), ("bad",), (None,)], "s string")
    got = [r.d for r in df.select(parse_mixed_dates("s").alias("d")).collect()]
    assert got == [D(2020, 12, 31), D(2021, 1, 5), D(2021, 12, 31), None, None]


def test_conform_names(spark):
    names = ["St. Louis", "St Louis", "Saint Louis", "Aikin", "Carlson", "Penningham", "Olmsted" + NBSP, "Anoka", None]
    df = spark.createDataFrame([(n,) for n in names], "county string")
    got = [r.c for r in df.select(apply_corrections("county", COUNTY_CORRECTIONS, COUNTY_PREFIX_RULES).alias("c")).collect()]
    assert got == ["Saint Louis"] * 3 + ["Aitkin", "Carlton", "Pennington", "Olmsted", "Anoka", None]


def test_district_override(spark):
    rows = [("Cass", "2" + NBSP + "and" + NBSP + "3"), ("Koochiching", "1 and 2"), ("Itasca", "1 and 2"), ("Anoka", "Metro")]
    df = spark.createDataFrame(rows, "county string, district string")
    got = dict(df.select("county", override("district", "county", DISTRICT_OVERRIDES).alias("d")).collect())
    assert got == {"Cass": "3", "Koochiching": "1", "Itasca": "1", "Anoka": "Metro"}
    # non-breaking spaces are repaired by clean_text
    assert df.select(clean_text(F.lit("2" + NBSP + "and" + NBSP + "3")).alias("x")).first().x == "2 and 3"


def test_station_dimension(spark):
    current = spark.createDataFrame([(1, "Saint Louis"), (2, "Aitkin"), (3, "Hennepin")], "station_id int, county string")
    retired = spark.createDataFrame(
        [(3, "Hennepin", "2015"), (4, "Olmsted" + NBSP, "2012"), (4, "Wrongplace", "2016")],
        "station_id int, county string, status string")
    districts = spark.createDataFrame(
        [("Saint Louis", "1"), ("Aitkin", "1"), ("Hennepin", "Metro"), ("Olmsted", "6")], "county string, district string")
    dim = attach(merge_dimension(current, retired, "station_id", "status", "county"), districts, "county")
    got = sorted(tuple(r) for r in dim.select("station_id", "county", "district").collect())
    assert got == [(1, "Saint Louis", "1"), (2, "Aitkin", "1"), (3, "Hennepin", "Metro"), (4, "Olmsted", "6")]


def test_gaps_and_fills(spark):
    df = spark.createDataFrame([("A", D(2020, 3, 1), 10.0), ("A", D(2020, 3, 2), 12.0), ("A", D(2020, 3, 5), 18.0)],
                               "e string, date date, v double")
    g = [r.gap for r in gaps(df, ["e"], "date").orderBy("date").collect()]
    assert g == [None, 1, 3]
    stats = {r.check: r.observed for r in Q.gap_stats(df, "t", ["e"]).collect()}
    assert stats["gap_share_1"] == 0.5 and stats["gap_mean"] == 2.0
    last = {r.date.day: r.v for r in fill_last(df, ["e"], ["v"]).collect()}
    assert last[3] == 12.0 and last[4] == 12.0 and last[5] == 18.0
    mean = {r.date.day: r.v for r in fill_mean(df, ["e"], ["v"], k=2).collect()}
    assert math.isclose(mean[3], 40 / 3) and math.isclose(mean[4], 40 / 3)
    dup = spark.createDataFrame([("A", D(2020, 3, 1)), ("A", D(2020, 3, 1)), ("A", D(2020, 3, 3))], "e string, date date")
    s2 = {r.check: r.observed for r in Q.gap_stats(dup, "t", ["e"]).collect()}
    assert s2["gap_mean"] == 1.0 and s2["gap_share_1"] == 0.0 and s2["gap_min"] == 0.0


def test_share_of_baseline(spark):
    df = spark.createDataFrame([(D(2018, 3, 5), 100), (D(2019, 3, 4), 200), (D(2020, 3, 2), 75), (D(2020, 12, 30), 50)],
                               "date date, total_volume int")
    out = {r.date: r for r in share_of_baseline(df, baseline_years=(2017, 2019), compare_years=(2020, None)).collect()}
    assert out[D(2020, 3, 2)].baseline == 150.0 and out[D(2020, 3, 2)].share == 0.5
    assert out[D(2020, 3, 2)].pct_diff == -0.5
    assert out[D(2020, 12, 30)].baseline is None and out[D(2020, 12, 30)].share is None
    assert set(out) == {D(2020, 3, 2), D(2020, 12, 30)}


def test_day_number(spark):
    df = spark.createDataFrame([(D(2020, 3, 18),), (D(2020, 12, 31),), (D(2021, 1, 1),)], "d date")
    assert [r.n for r in df.select(day_number("d").alias("n")).collect()] == [78, 366, 367]


def _daily_series(spark, start, end, shuffle=True):
    days = [(start + dt.timedelta(i), float(i)) for i in range((end - start).days + 1)]
    df = spark.createDataFrame(days, "date date, y double")
    return df.repartition(3) if shuffle else df


def test_event_windows(spark):
    s = _daily_series(spark, D(2020, 1, 1), D(2020, 2, 29))
    ev = spark.createDataFrame([(D(2020, 2, 1),)], "event_date date")
    w = event_windows(s, ev, "date", "y", 30, 10).collect()
    train = sorted(r.ds for r in w if r.split == "train")
    test = sorted(r.ds for r in w if r.split == "test")
    assert (train[0], train[-1], len(train)) == (D(2020, 1, 3), D(2020, 2, 1), 30)
    assert (test[0], test[-1], len(test)) == (D(2020, 2, 2), D(2020, 2, 11), 10)


def test_rmse(spark):
    w = spark.createDataFrame([(D(2020, 1, 1), "test", D(2020, 1, 2), 0.0), (D(2020, 1, 1), "test", D(2020, 1, 3), 0.0)],
                              "event_date date, split string, ds date, y double")
    f = spark.createDataFrame([(D(2020, 1, 1), D(2020, 1, 2), 3.0), (D(2020, 1, 1), D(2020, 1, 3), 4.0)],
                              "event_date date, ds date, yhat double")
    r = rmse(w, f).first()
    assert math.isclose(r.rmse, 3.535534, rel_tol=1e-6) and r.n == 2


def test_forecast_exact_line(spark):
    ev = D(2020, 6, 1)
    rows = [(ev, "train", ev + dt.timedelta(x), 1 + 0.01 * x) for x in range(-29, 1)]
    w = spark.createDataFrame(rows, "event_date date, split string, ds date, y double")
    fc = {r.ds: r for r in fit_forecast(w, horizon=10).collect()}
    r = fc[ev + dt.timedelta(10)]
    assert math.isclose(r.yhat, 1.10, abs_tol=1e-9)
    assert abs(r.yhat_upper - r.yhat_lower) < 1e-9
    assert len(fc) == 40


def test_daily_from_total(spark):
    df = spark.createDataFrame([("A", D(2020, 1, 1), 1), ("A", D(2020, 1, 2), 1), ("A", D(2020, 1, 3), 3)],
                               "e string, date date, cases int")
    got = [r.cases_daily for r in daily_from_total(df, ["e"], ["cases"]).orderBy("date").collect()]
    assert got == [1, 0, 2]


def test_share_valid(spark):
    df = spark.createDataFrame([(5, 1), (5, 6), (5, None)], "cases int, deaths int")
    r = Q.share_valid(df, "t", {"deaths_le_cases": F.col("deaths") <= F.col("cases")}).first()
    assert r.observed == 0.5 and r.passed is False


def test_pivot(spark):
    df = spark.createDataFrame([("R",), ("R",), ("U",)], "t string")
    r = pivot_count(df, "t", ["R", "U"]).collect()
    assert len(r) == 1 and r[0].R == 2 and r[0].U == 1


def test_anti_and_except(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")
    b = spark.createDataFrame([(1,)], "id int")
    assert sorted(r.id for r in anti_join(a, b, "id").collect()) == [2, 2, 3]
    assert sorted(r.id for r in a.subtract(b).collect()) == [2, 3]
