"""Per-operator tests for the rows of SURVEY §2 not covered by the literal cases."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.functions.dates import calendar_keys
from panelspark.functions.text import conform_with_table
from panelspark.operators import quality as Q
from panelspark.operators.charts import markers, panels
from panelspark.operators.dims import first_per_key
from panelspark.operators.evaluate import rmse, rmse_summary
from panelspark.operators.events import align, event_axis, event_windows, sample_events, select_events
from panelspark.operators.relational import broadcast_if_bounded, sample_n, top_k
from panelspark.operators.rollup import group_count, minmax, wide_by_hour

D = dt.date


def _report(df):
    return {(r.group, r.check): (r.observed, r.expected, r.passed) for r in df.collect()}


def test_profile_sign_distinct(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, None, -1.0), (2, "b", None)], "y int, s string, v double")
    p = _report(Q.profile(df, "t", ["s", "v"], ["y"]))
    assert p[("1", "not_null(s)")] == (1.0, 2.0, False) and p[("2", "not_null(v)")] == (0.0, 1.0, False)
    s = _report(Q.sign_check(df, "t", ["v"]))
    assert s[("all", "non_negative(v)")] == (1.0, 3.0, False)       # a null is not a valid value
    one = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert _report(Q.sign_check(one, "t", ["v"]))[("all", "non_negative(v)")] == (1.0, 2.0, False)
    d = _report(Q.distinct_counts(df, "t", ["y", "s"]))
    assert d[("all", "distinct(y)")] == (2.0, 3.0, None) and d[("all", "distinct(s)")] == (2.0, 2.0, None)
    a = _report(Q.distinct_counts(df, "t", ["y"], approx=True))
    assert a[("all", "distinct(y)")][0] == 2.0


def test_unique_groups_key_unique_unmatched(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), "A"), (D(2020, 1, 1), "B"), (D(2020, 1, 2), "A"), (D(2020, 1, 2), "A")],
                               "date date, county string")
    u = _report(Q.unique_groups(df, "t", ["date"], "county"))
    assert u[("all", "unique_within(county by date)")][0] == 0.5
    k = _report(Q.key_unique(df, "t", ["date", "county"]))
    assert k[("all", "unique(date,county)")] == (3.0, 4.0, False)
    nulls = spark.createDataFrame([(None,), (None,)], "k int")
    assert _report(Q.key_unique(nulls, "t", ["k"]))[("all", "unique(k)")] == (1.0, 2.0, False)
    # A null date counts as a row without a value of its own.
    gap = spark.createDataFrame([("a", D(2020, 1, 1)), ("a", None), ("b", D(2020, 1, 1))], "e string, date date")
    assert _report(Q.unique_groups(gap, "t", ["e"], "date"))[("all", "unique_within(date by e)")][0] == 0.5
    g = _report(Q.gap_stats(gap, "t", ["e"], "date", unique_days=True))
    assert g[("all", "unique_within(date by e)")] == (0.5, 1.0, False)
    assert g[("all", "gap_count")][0] == 0.0


def test_exact_distinct_and_keys_never_expand_or_carry_sketches(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, None, 5), (2, "b", 7)], "y int, s string, k int")
    rep = Q.suite(df, "t", ["y"], not_null=["s"], distinct=["s"], approx=True, unique=[["k"], ["s", "k"]])
    plan = rep._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    for line in plan.splitlines():
        assert not ("approx_count_distinct" in line and "k#" in line.split("functions=")[0]), line
    got = {(r.group, r.check): (r.observed, r.expected) for r in rep.collect()}
    assert got[("1", "unique(k)")] == (1.0, 2.0) and got[("1", "unique(s,k)")] == (2.0, 2.0)
    exact = Q.distinct_counts(df, "t", ["s", "k"])
    assert "Expand" not in exact._jdf.queryExecution().executedPlan().toString()


def test_coverage_both_sides(spark):
    left = spark.createDataFrame([("Aitkin",), ("Anoka",), ("Saint Louis",)], "n string")
    right = spark.createDataFrame([("Aikin",), ("Anoka",), ("St. Louis",)], "n string")
    got = {(r.name, r.in_left, r.in_right) for r in Q.coverage(left, right, "n").collect()}
    assert got == {("Aitkin", True, False), ("Saint Louis", True, False), ("Aikin", False, True), ("St. Louis", False, True)}


def test_group_count_top_k_minmax(spark):
    df = spark.createDataFrame([("R", 1), ("R", 2), ("U", 3)], "t string, v int")
    assert [tuple(r) for r in group_count(df, ["t"]).collect()] == [("R", 2), ("U", 1)]
    assert [r.v for r in top_k(df, 2, [F.desc("v")]).collect()] == [3, 2]
    m = minmax(df, ["v"]).first()
    assert (m.min_v, m.max_v) == (1, 3)


def test_sample_is_repeatable_and_partition_free(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r.k for r in sample_n(df, 7, "k", "seed").collect()]
    b = [r.k for r in sample_n(df.repartition(13), 7, "k", "seed").collect()]
    c = [r.k for r in sample_n(df, 7, "k", "other").collect()]
    assert a == b and len(a) == 7 and a != c


def test_calendar_keys_week53(spark):
    df = spark.createDataFrame([(D(2020, 12, 30),), (D(2021, 1, 3),), (D(2020, 3, 1),)], "date date")
    r = {x.date: (x.year, x.week, x.weekday) for x in calendar_keys(df).collect()}
    assert r[D(2020, 12, 30)] == (2020, "53", "04") and r[D(2021, 1, 3)] == (2021, "53", "01")
    assert r[D(2020, 3, 1)] == (2020, "09", "01")
    r2 = {x.date: x.week for x in calendar_keys(df, week53_to_52=True).collect()}
    assert r2[D(2020, 12, 30)] == "52"


def test_events_selection_axis_markers_align(spark):
    tl = spark.createDataFrame([
        (D(2020, 3, 18), "Schools", "Restriction", "Effective"),
        (D(2020, 3, 16), "Schools", "Restriction", "Announced"),
        (D(2021, 1, 1), "Vaccination", "Relaxation", "Effective"),
        (D(2020, 6, 1), "Business", "Relaxation", "Effective")], "date date, category string, order_type string, event_type string")
    r = event_axis(select_events(tl, "Restriction"), "date").collect()
    assert [(x.date, x.day_number) for x in r] == [(D(2020, 3, 18), 78)]
    assert select_events(tl, "Relaxation", exclude_category="Vaccination").count() == 1
    m = markers(tl, "date", "order_type").where("kind = 'Relaxation'").orderBy("event_date").collect()
    assert [x.day_number for x in m] == [153, 367]
    a = spark.createDataFrame([(D(2020, 1, 1), 1.0), (D(2022, 1, 1), 2.0)], "date date, share double")
    b = spark.createDataFrame([(D(2020, 1, 2), 5)], "date date, cases int")
    got = sorted((x.date, x.share, x.cases) for x in align(a, b, "date", "2022-01-01").collect())
    assert got == [(D(2020, 1, 1), 1.0, None), (D(2020, 1, 2), None, 5)]


def test_event_windows_multi_series_and_exclusive(spark):
    rows = [(s, D(2020, 1, 1) + dt.timedelta(i), float(i)) for s in ("a", "b") for i in range(0, 60, 2 if s == "b" else 1)]
    series = spark.createDataFrame(rows, "s string, date date, y double")
    ev = spark.createDataFrame([("a", D(2020, 1, 20)), ("b", D(2020, 1, 20)), ("b", D(2020, 1, 20))], "s string, event_date date")
    w = event_windows(series, ev, "date", "y", 5, 3, keys=["s"]).collect()
    a = sorted(x.ds.day for x in w if x.s == "a" and x.split == "train")
    b = sorted(x.ds.day for x in w if x.s == "b" and x.split == "train")
    assert a == [16, 17, 18, 19, 20] and b == [11, 13, 15, 17, 19]          # rows, not days
    assert sorted(x.ds.day for x in w if x.s == "b" and x.split == "test") == [21, 23, 25]
    ex = event_windows(series, ev.where("s = 'a'"), "date", "y", 2, 1, keys=["s"], include_event_day=False).collect()
    assert sorted((x.split, x.ds.day) for x in ex) == [("test", 20), ("train", 18), ("train", 19)]


def test_sample_events_bounds(spark):
    s = spark.createDataFrame([(D(2019, 1, 1) + dt.timedelta(i),) for i in range(365)], "date date")
    e = [r.event_date for r in sample_events(s, "date", 4, "x", "2019-02-10", "2019-11-20").collect()]
    assert len(e) == 4 and all(D(2019, 2, 10) < d < D(2019, 11, 20) for d in e)


def test_rmse_summary_mean_and_pooled(spark):
    w = spark.createDataFrame([
        (D(2020, 1, 1), "test", D(2020, 1, 2), 0.0), (D(2020, 1, 1), "test", D(2020, 1, 3), 0.0),
        (D(2020, 2, 1), "test", D(2020, 2, 2), 0.0)], "event_date date, split string, ds date, y double")
    f = spark.createDataFrame([(D(2020, 1, 1), D(2020, 1, 2), 3.0), (D(2020, 1, 1), D(2020, 1, 3), 4.0),
                               (D(2020, 2, 1), D(2020, 2, 2), 1.0)], "event_date date, ds date, yhat double")
    s = {(r.kind, r.event_date): r.test_rmse for r in rmse_summary(rmse(w, f)).collect()}
    assert abs(s[("mean", None)] - (12.5 ** 0.5 + 1.0) / 2) < 1e-12
    assert abs(s[("pooled", None)] - (26 / 3) ** 0.5) < 1e-12


def test_panels_long(spark):
    df = spark.createDataFrame([("1", D(2020, 1, 1), 10, 0.5)], "district string, date date, v int, share double")
    got = {(r.panel, r.measure, r.value) for r in panels(df, ["district"], "date", ["v", "share"]).collect()}
    assert got == {("1", "v", 10.0), ("1", "share", 0.5)}


def test_wide_by_hour_and_first_per_key_desc(spark):
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 1, 0, 5)), (1, dt.datetime(2020, 1, 1, 0, 50)),
                                (1, dt.datetime(2020, 1, 1, 23, 0))], "s int, ts timestamp")
    r = wide_by_hour(df, ["s"], "ts").first()
    assert r.h01 == 2 and r.h24 == 1 and r.h02 is None
    k = spark.createDataFrame([(1, "2012"), (1, "2016")], "id int, status string")
    assert first_per_key(k, ["id"], ["status"], descending=True).first().status == "2016"


def test_correction_table_and_checked_broadcast(spark):
    df = spark.createDataFrame([("Aikin",), ("Anoka",), (None,)], "county string")
    table = spark.createDataFrame([("Aikin", "Aitkin")], "src string, dst string")
    got = sorted((r.county or "") for r in conform_with_table(df, "county", table).collect())
    assert got == ["", "Aitkin", "Anoka"]
    big = spark.range(50)
    assert "Broadcast" not in broadcast_if_bounded(big, 10).join(spark.range(5), "id")._jdf.queryExecution().logical().toString()


def test_unmatched_both_counts_rows_and_suite_one_pass(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1,), (4,), (4,), (4,)], "k int")
    r = {r.table: r.observed for r in Q.unmatched_both(left, right, ["k"], "L", "R").collect()}
    assert r == {"L": 3.0, "R": 3.0}
    df = spark.createDataFrame([(1, -1.0, "a"), (2, None, "a"), (None, 3.0, "b")], "id int, v double, s string")
    rep = _report(Q.suite(df, "t", not_null=["id"], non_negative=["v"], rules={"pos": F.col("v") > 0}, distinct=["s"]))
    assert rep[("all", "not_null(id)")] == (2.0, 3.0, False)
    assert rep[("all", "non_negative(v)")] == (1.0, 3.0, False)
    assert rep[("all", "share_valid(pos)")] == (0.5, 1.0, False)
    assert rep[("all", "distinct(s)")] == (2.0, 3.0, None)
    plan = Q.suite(df, "t", not_null=["id"], non_negative=["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2          # one partial + one final aggregation


def test_merge_dimension_numeric_status_order(spark):
    from panelspark.operators.dims import merge_dimension
    cur = spark.createDataFrame([(1, "A")], "id int, county string")
    ret = spark.createDataFrame([(2, "B", 10), (2, "C", 9), (1, "Z", 1)], "id int, county string, status int")
    got = sorted(tuple(r) for r in merge_dimension(cur, ret, "id", "status", "county", None, ()).collect())
    assert got == [(1, "A"), (2, "C")]


def test_correction_table_duplicates_are_deterministic(spark):
    df = spark.createDataFrame([("Aikin",)], "county string")
    table = spark.createDataFrame([("Aikin", "Aitkin"), ("Aikin", "Aitkin2")], "src string, dst string")
    for _ in range(2):
        assert conform_with_table(df, "county", table.repartition(2)).first().county == "Aitkin"


def test_edge_cases_zero_lengths_and_null_dates(spark):
    from panelspark.operators.forecast import fit_forecast
    from panelspark.operators.panel import fill_last
    s = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(i), float(i)) for i in range(20)], "date date, y double")
    ev = spark.createDataFrame([(D(2020, 1, 10),)], "event_date date")
    assert event_windows(s, ev, "date", "y", 0, 0).count() == 0
    assert sorted(r.ds.day for r in event_windows(s, ev, "date", "y", 0, 2).collect()) == [11, 12]
    w = event_windows(s, ev, "date", "y", 5, 2)
    assert fit_forecast(w, horizon=0).count() == 5
    df = spark.createDataFrame([("A", D(2020, 1, 1), 1.0), ("A", None, 9.0), ("A", D(2020, 1, 3), 3.0)],
                               "e string, date date, v double")
    got = sorted(((r.date.day if r.date else 0), r.v, r.filled) for r in fill_last(df, ["e"], ["v"]).collect())
    assert got == [(0, 9.0, False), (1, 1.0, False), (2, 1.0, True), (3, 3.0, False)]


def test_broadcast_bound_counts_bytes(spark):
    from panelspark.operators.relational import estimated_row_bytes
    narrow = spark.range(100)
    assert estimated_row_bytes(narrow.schema) == 24
    plan = lambda d: d.join(spark.range(3), "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(broadcast_if_bounded(narrow, 1000)).lower()
    assert "broadcast" not in plan(broadcast_if_bounded(narrow, 1000, max_bytes=24 * 50)).lower()
