"""Randomised brute-force checks of the custom operators against pandas / numpy."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from panelspark.operators.baseline import share_of_baseline
from panelspark.operators.events import event_windows
from panelspark.operators.forecast import fit_forecast

D0 = dt.date(2020, 1, 1)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def _brute_windows(days, values, events, before, after, include):
    s = pd.DataFrame({"ds": days, "y": values}).sort_values("ds").reset_index(drop=True)
    out = []
    for e in sorted(set(events)):
        mask = s.ds <= e if include else s.ds < e
        train, test = s[mask].tail(before), s[~mask].head(after)
        out += [(e, "train", r.ds, r.y) for r in train.itertuples()]
        out += [(e, "test", r.ds, r.y) for r in test.itertuples()]
    return sorted(out)


@SETTINGS
@given(st.sets(st.integers(0, 80), min_size=1, max_size=40), st.lists(st.integers(-10, 95), min_size=1, max_size=6),
       st.integers(1, 8), st.integers(1, 5), st.booleans())
def test_event_windows_match_pandas(spark, day_offsets, event_offsets, before, after, include):
    days = [D0 + dt.timedelta(d) for d in sorted(day_offsets)]
    values = [float(i) for i in range(len(days))]
    events = [D0 + dt.timedelta(e) for e in event_offsets]
    series = spark.createDataFrame(list(zip(days, values)), "date date, y double")
    ev = spark.createDataFrame([(e,) for e in events], "event_date date")
    got = sorted(tuple(r) for r in event_windows(series, ev, "date", "y", before, after,
                                                 include_event_day=include).collect())
    assert got == _brute_windows(days, values, events, before, after, include)


@SETTINGS
@given(st.floats(-2, 2), st.floats(0.5, 3), st.lists(st.floats(0.8, 1.2), min_size=7, max_size=7),
       st.integers(8, 30))
def test_forecast_matches_numpy(spark, slope, intercept, weekly, n):
    ev = dt.date(2021, 6, 1)
    xs = np.arange(-n + 1, 1)
    ds = [ev + dt.timedelta(int(x)) for x in xs]
    wd = [(d.isoweekday() % 7) + 1 for d in ds]                # Spark dayofweek: Sunday = 1
    ys = (slope * 0.01 * xs + intercept) * np.array([weekly[w - 1] for w in wd])
    w = spark.createDataFrame([(ev, "train", d, float(y)) for d, y in zip(ds, ys)],
                              "event_date date, split string, ds date, y double")
    fc = {r.ds: r for r in fit_forecast(w, horizon=10).collect()}
    m, b = np.polyfit(xs.astype(float), ys, 1)
    trend = m * xs + b
    ratio = pd.Series(ys / trend).groupby(wd).mean()
    yhat_hist = trend * np.array([ratio[k] for k in wd])
    sd = np.std(ys - yhat_hist, ddof=1)
    for x in range(1, 11):
        d = ev + dt.timedelta(x)
        k = (d.isoweekday() % 7) + 1
        want = (m * x + b) * ratio.get(k, 1.0)
        assert abs(fc[d].yhat - want) < 1e-9 * max(1.0, abs(want))
        assert abs((fc[d].yhat_upper - fc[d].yhat) - 1.96 * sd) < 1e-9
    assert len(fc) == n + 10


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 4 * 365), st.integers(1, 1000)), min_size=5, max_size=80,
                unique_by=lambda t: t[0]))
def test_share_of_baseline_matches_pandas(spark, rows):
    start = dt.date(2017, 1, 1)
    df = pd.DataFrame({"date": [start + dt.timedelta(d) for d, _ in rows], "v": [v for _, v in rows]})
    iso = pd.to_datetime(df.date).dt.isocalendar()
    df["week"], df["wd"] = iso.week.astype(int), (pd.to_datetime(df.date).dt.dayofweek + 1) % 7 + 1
    df["year"] = pd.to_datetime(df.date).dt.year
    base = df[df.year <= 2019].groupby(["week", "wd"]).v.mean()
    cmp_ = df[df.year >= 2020]
    want = sorted((r.date, None if (r.week, r.wd) not in base.index else r.v / base[(r.week, r.wd)])
                  for r in cmp_.itertuples())
    sdf = spark.createDataFrame(df[["date", "v"]].values.tolist(), "date date, v long")
    got = sorted((r.date, r.share) for r in share_of_baseline(sdf, "date", "v", (), (2017, 2019), (2020, None)).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    for (_, a), (_, b) in zip(got, want):
        assert (a is None and b is None) or abs(a - b) < 1e-12


@SETTINGS
@given(st.sets(st.integers(0, 60), min_size=3, max_size=45), st.lists(st.integers(0, 70), min_size=1, max_size=4))
def test_forecast_scores_equal_join_based_rmse(spark, day_offsets, event_offsets):
    from panelspark.operators.evaluate import rmse
    from panelspark.operators.forecast import forecast_scores
    days = [D0 + dt.timedelta(d) for d in sorted(day_offsets)]
    series = spark.createDataFrame([(d, float((i * 7) % 5) + 1.0) for i, d in enumerate(days)], "date date, y double")
    ev = spark.createDataFrame([(D0 + dt.timedelta(e),) for e in event_offsets], "event_date date")
    w = event_windows(series, ev, "date", "y", 12, 6)
    a = {(r.event_date, r.split): (r.rmse, r.n) for r in forecast_scores(w, horizon=6).collect()}
    b = {(r.event_date, r.split): (r.rmse, r.n) for r in rmse(w, fit_forecast(w, horizon=6)).collect()}
    assert a.keys() == b.keys()
    for k in a:
        (ra, na), (rb, nb) = a[k], b[k]
        assert na == nb and ((ra is None and rb is None) or abs(ra - rb) < 1e-9), (k, a[k], b[k])


def _brute_fills(rows, k):
    """pandas: reindex each entity to every day between its first and last row; an added
    day takes the last observed non-null value, or the mean of the values of the last k rows before
    its gap and the first k after it."""
    last, mean = [], []
    df = pd.DataFrame(rows, columns=["e", "date", "v"])
    for e, g in df.groupby("e"):
        s = g.set_index(pd.to_datetime(g["date"]))["v"].astype("float64")
        full = s.reindex(pd.date_range(s.index.min(), s.index.max(), freq="D"))
        added = ~full.index.isin(s.index)
        ffill = full.ffill()
        for d, a, v, f in zip(full.index, added, full, ffill):
            day = d.date()
            near = pd.concat([s[s.index < d].sort_index().tail(k), s[s.index > d].sort_index().head(k)])
            m = near.mean()
            last.append((e, day, f if a else v, bool(a)))
            mean.append((e, day, m if a else v, bool(a)))
    return last, mean


def _norm(rows):
    return sorted((e, d, None if v is None or (isinstance(v, float) and np.isnan(v)) else round(v, 9), f)
                  for e, d, v, f in rows)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.one_of(st.none(), st.integers(-50, 50))),
                min_size=1, max_size=40, unique_by=lambda t: (t[0], t[1])),
       st.integers(1, 3))
def test_fills_match_pandas(spark, raw, k):
    from panelspark.operators.panel import fill_last, fill_mean
    rows = [(f"e{e}", D0 + dt.timedelta(d), None if v is None else float(v)) for e, d, v in raw]
    df = spark.createDataFrame(rows, "e string, date date, v double")
    want_last, want_mean = _brute_fills(rows, k)
    got_last = [tuple(r) for r in fill_last(df, ["e"], ["v"]).select("e", "date", "v", "filled").collect()]
    got_mean = [tuple(r) for r in fill_mean(df, ["e"], ["v"], k=k).select("e", "date", "v", "filled").collect()]
    assert _norm(got_last) == _norm(want_last)
    assert _norm(got_mean) == _norm(want_mean)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30)), min_size=2, max_size=60))
def test_gap_stats_match_pandas(spark, raw):
    """Gaps between consecutive rows of each entity in date order (a repeated day is a
    0-day gap), pooled over entities: min, max, mean, share of 1-day gaps, count."""
    from panelspark.operators import quality as Q
    rows = [(f"e{e}", D0 + dt.timedelta(d)) for e, d in raw]
    df = spark.createDataFrame(rows, "e string, date date")
    rep = {r.check: r.observed for r in Q.gap_stats(df, "t", ["e"]).collect()}
    p = pd.DataFrame(rows, columns=["e", "date"]).assign(date=lambda x: pd.to_datetime(x["date"]))
    g = p.sort_values(["e", "date"]).groupby("e")["date"].diff().dropna().dt.days
    if len(g) == 0:
        assert rep["gap_count"] == 0
        return
    assert rep["gap_count"] == len(g)
    assert rep["gap_min"] == g.min() and rep["gap_max"] == g.max()
    assert abs(rep["gap_mean"] - g.mean()) < 1e-9
    assert abs(rep["gap_share_1"] - (g == 1).mean()) < 1e-9


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 6))), min_size=1, max_size=40))
def test_unique_groups_match_pandas(spark, raw):
    """Share of groups whose values never repeat and are never null."""
    from panelspark.operators import quality as Q
    df = spark.createDataFrame([(f"g{g}", v) for g, v in raw], "g string, v int")
    rep = {r.check: r.observed for r in Q.unique_groups(df, "t", ["g"], "v").collect()}
    p = pd.DataFrame(raw, columns=["g", "v"])
    want = p.groupby("g")["v"].apply(lambda s: s.notna().all() and s.is_unique).mean()
    assert abs(rep["unique_within(v by g)"] - want) < 1e-9
