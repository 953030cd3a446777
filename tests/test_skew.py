"""A hot key holding about a third of all rows: results stay exact (checked against a
pandas brute force on the small driver tables), and the operators aggregate map-side."""

import pandas as pd
from pyspark.sql import functions as F

from panelspark.operators import quality as Q
from panelspark.operators.dims import first_per_key
from panelspark.operators.rollup import hours_to_daily, wide_by_hour

SF = "/root/testdata/sf0.001"


def _skewed_orders(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    hot = F.col("o_orderstatus") == "F"            # about a third of the rows
    return o.select(F.when(hot, F.lit(0)).otherwise(F.col("o_custkey")).alias("o_custkey"),
                    "o_orderkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")


def test_first_per_key_hot_key(spark):
    df = _skewed_orders(spark)
    pdf = df.toPandas()
    assert (pdf.o_custkey == 0).mean() > 0.25
    want = (pdf.sort_values(["date", "o_orderkey"]).groupby("o_custkey", as_index=False).first()
            .sort_values("o_custkey").reset_index(drop=True))
    got = (first_per_key(df, ["o_custkey"], ["date", "o_orderkey"]).toPandas()
           .sort_values("o_custkey").reset_index(drop=True))
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
    plan = first_per_key(df, ["o_custkey"], ["date"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan                  # combined map-side before the shuffle


def test_gap_stats_and_unique_groups_hot_key(spark):
    df = _skewed_orders(spark)
    pdf = df.toPandas()
    pdf["date"] = pd.to_datetime(pdf["date"])
    pdf = pdf.sort_values(["o_custkey", "date"])
    pdf["gap"] = pdf.groupby("o_custkey")["date"].diff().dt.days
    gaps = pdf["gap"].dropna()
    rep = {r.check: r.observed for r in Q.gap_stats(df, "o", ["o_custkey"]).collect()}
    assert rep["gap_count"] == len(gaps)
    assert abs(rep["gap_mean"] - gaps.mean()) < 1e-12
    assert abs(rep["gap_share_1"] - (gaps == 1).mean()) < 1e-12
    per = pdf.groupby("o_custkey")["date"].agg(["nunique", "count"])
    u = Q.unique_groups(df, "o", ["o_custkey"], "date").first().observed
    assert abs(u - (per["nunique"] == per["count"]).mean()) < 1e-12


def test_hourly_rollup_hot_station(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    hot = F.col("event_type").isin("view", "click")
    ev = ev.select(F.when(hot, F.lit(0)).otherwise(F.col("user_id")).alias("station_id"),
                   "event_type", F.col("ts").cast("date").alias("date"), "ts")
    wide = wide_by_hour(ev, ["station_id", "event_type", "date"], "ts")
    got = hours_to_daily(wide, ["station_id", "date"], null_as_zero=True).toPandas()
    want = ev.toPandas().groupby(["station_id", "date"]).size().rename("want").reset_index()
    m = got.merge(want, on=["station_id", "date"])
    assert len(m) == len(want) == len(got) and (m.total_volume == m.want).all()


def test_session_enables_skew_handling(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
