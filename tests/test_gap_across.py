"""Gaps over the ends of groups: stitched segments against each entity's whole series."""

import datetime as dt
import random

import pytest

from panelspark.operators import quality as Q


def report(df, **more):
    return {(r.group, r.check): r.observed for r in Q.gap_stats(df, "t", ["e"], "date", ["year"], **more).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(e, d, d.year if d else 2020) for e, d in rows], "e string, date date, year int")


def test_a_gap_from_december_to_january_is_seen(spark):
    d = dt.date
    df = frame(spark, [("a", d(2019, 12, 30)), ("a", d(2019, 12, 31)), ("a", d(2020, 1, 20)), ("a", d(2020, 1, 21)),
                       ("b", d(2019, 12, 31)), ("b", d(2020, 1, 1)), ("c", d(2018, 5, 1)), ("c", d(2020, 5, 1)), ("d", None)])
    got, plain = report(df, across=True), report(df)
    assert {k: v for k, v in got.items() if "across" not in k[1]} == plain and plain["2020", "gap_max"] == 1
    assert got["2020", "gap_across_max"] == 731 and got["2020", "gap_across_min"] == 1
    assert got["2020", "gap_across_count"] == 3 and got["2020", "gap_across_share_1"] == pytest.approx(1 / 3)
    assert got["2019", "gap_across_count"] == 0 and got["2019", "gap_across_max"] is None
    with pytest.raises(ValueError):
        Q.gap_stats(df, "t", ["e"], across=True)


def test_stitched_steps_are_those_of_the_whole_series(spark):
    rng = random.Random(3)
    start = dt.date(2018, 1, 1)
    rows = [(f"e{rng.randrange(5)}", start + dt.timedelta(rng.randrange(1500))) for _ in range(120)]
    want = {}
    for e in {e for e, _ in rows}:
        days = sorted({d for x, d in rows if x == e})
        for a, b in zip(days[:-1], days[1:], strict=True):
            if a.year != b.year:
                want.setdefault(str(b.year), []).append((b - a).days)
    got = report(frame(spark, rows), across=True)
    for year, steps in want.items():
        assert (got[year, "gap_across_max"], got[year, "gap_across_min"], got[year, "gap_across_count"]) == (max(steps), min(steps), len(steps))
