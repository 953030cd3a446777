"""Running aggregates by blocks of the calendar against a plain loop, and their plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import prefix
from panelspark.operators.events import event_windows
from panelspark.operators.panel import gaps, running_total


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def days(seed, n, span):
    rng = random.Random(seed)
    return sorted({dt.date(1900, 1, 1) + dt.timedelta(rng.randrange(span)) for _ in range(n)})


def test_running_sum_max_min_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(d, rng.choice([None, -3, 2, 7])) for d in days(3, 300, 60_000)] + [(None, 5)]
    got = prefix.running(spark.createDataFrame(rows, "d date, v long"), "d", ["d"],
                         {"s": (F.sum, "v"), "hi": (F.max, "v"), "lo": (F.min, "v")})
    seen, want = [], []
    for d, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or dt.date.min)):
        seen += [] if v is None else [v]
        want.append((d, v, *((sum(seen), max(seen), min(seen)) if seen else (None,) * 3)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "SinglePartition" not in plan(got)


def test_every_block_is_before_the_later_ones(spark):
    totals = spark.range(200).selectExpr("cast(id as int) b", "id + 1 as n")
    got = {r.b: r.n for r in prefix.before_blocks(totals, "b", {"n": F.sum}).collect()}
    assert got == {b: b * (b + 1) // 2 for b in range(1, 200)}


def test_a_function_that_does_not_merge_is_refused(spark):
    with pytest.raises(ValueError):
        prefix.running(spark.createDataFrame([], "d date, v long"), "d", ["d"], {"m": (F.avg, "v")})


def test_keyless_running_total_keeps_types_and_has_no_single_partition(spark):
    d = days(5, 40, 9_000)
    df = spark.createDataFrame([(x, i) for i, x in enumerate(d)] * 2, "date date, n long").withColumn(
        "m", F.col("n").cast("decimal(18,2)"))
    got = running_total(df, [], ["n", "m"], suffix="_cum")
    assert got.columns == ["date", "n", "m", "n_cum", "m_cum"] and got.schema["n_cum"].dataType.simpleString() == "bigint"
    assert [(r.date, r.n_cum, int(r.m_cum)) for r in got.orderBy("date").collect()] == [
        (x, i * (i + 1), i * (i + 1)) for i, x in enumerate(d)]
    assert "SinglePartition" not in plan(got)
    assert running_total(df, [], ["n"]).columns == ["date", "n"]
    assert running_total(df.limit(0), [], ["n"]).count() == 0


def test_keyless_gaps_over_block_ends(spark):
    d = days(6, 60, 40_000)
    got = gaps(spark.createDataFrame([(x,) for x in d] * 2, "date date"), [])
    rows = got.orderBy("date").collect()
    assert [(r.date, r.prev_date) for r in rows] == list(zip(d, [None, *d], strict=False))
    assert [r.gap for r in rows[1:]] == [(b - a).days for a, b in zip(d, d[1:], strict=False)]
    assert "SinglePartition" not in plan(got)


@pytest.mark.parametrize("include", [True, False])
def test_keyless_event_windows_equal_those_of_one_key(spark, include):
    d = days(7, 150, 30_000)
    series = spark.createDataFrame([(x, float(i)) for i, x in enumerate(d)], "date date, y double")
    events = [*d[::17], d[0] - dt.timedelta(9), d[-1] + dt.timedelta(900), d[40] + dt.timedelta(1), None] * 2
    ev = spark.createDataFrame([(x,) for x in events], "event_date date")
    one = event_windows(series, ev, "date", "y", 12, 5, include_event_day=include)
    keyed = event_windows(series.withColumn("k", F.lit(1)), ev.withColumn("k", F.lit(1)), "date", "y", 12, 5, ["k"],
                          include_event_day=include).drop("k")
    assert one.columns == keyed.columns and one.count() > 100
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, keyed.collect()))
    assert "SinglePartition" not in plan(one)
