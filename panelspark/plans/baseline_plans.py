"""Calendar keys, baseline and share of expected volume (the flagship)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.dates import between_dates, calendar_keys, year_bounds
from panelspark.operators.baseline import baseline_parts, calendar_baseline, share_from_parts, share_of_baseline
from panelspark.operators.rollup import group_sum
from panelspark.plans.common import (
    BASELINE_YEARS,
    COMPARE_YEARS,
    SQL_CAL,
    SQL_DAILY,
    SQL_GEO,
    checkpointed,
    customer_geo,
    daily_orders,
    money_sum,
    r6,
    table,
)
from panelspark.plans.registry import register, sql_of
from panelspark.session import scratch_path
from panelspark.sources.io import write_parts


def district_daily(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    j = o.join(customer_geo(spark, sf_dir), "o_custkey", "inner")
    return j.groupBy("date", "district").agg(money_sum("o_totalprice").alias("total_volume"))


def _rounded(df, by=()):
    return df.select("date", *by, "total_volume", r6("baseline").alias("baseline"),
                     r6("share").alias("share"), r6("pct_diff").alias("pct_diff"))


@register("share_of_baseline", sql=f"""
WITH {SQL_DAILY}, {SQL_CAL},
base AS (SELECT week, weekday, avg(total_volume) AS baseline FROM cal
         WHERE date >= DATE '1995-01-01' AND date < DATE '1998-01-01' GROUP BY 1, 2)
SELECT c.date, c.total_volume, round(b.baseline, 6) AS baseline,
       round(c.total_volume / b.baseline, 6) AS share,
       round(c.total_volume / b.baseline - 1, 6) AS pct_diff
FROM cal c LEFT JOIN base b USING (week, weekday)
WHERE c.date >= DATE '1998-01-01'
""")
def q_share_of_baseline(spark, sf_dir):
    daily = daily_orders(spark, sf_dir).select("date", "total_volume")
    return _rounded(share_of_baseline(daily, "date", "total_volume", (), BASELINE_YEARS, COMPARE_YEARS))


@register("share_by_district", sql=f"""
WITH {SQL_GEO},
daily AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date, g.district,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_volume
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN geo g ON c.c_nationkey = g.c_nationkey GROUP BY 1, 2), {SQL_CAL},
base AS (SELECT week, weekday, district, avg(total_volume) AS baseline FROM cal
         WHERE date >= DATE '1995-01-01' AND date < DATE '1998-01-01' GROUP BY 1, 2, 3)
SELECT c.date, c.district, c.total_volume, round(b.baseline, 6) AS baseline,
       round(c.total_volume / b.baseline, 6) AS share,
       round(c.total_volume / b.baseline - 1, 6) AS pct_diff
FROM cal c LEFT JOIN base b USING (week, weekday, district)
WHERE c.date >= DATE '1998-01-01'
""")
def q_share_by_district(spark, sf_dir):
    d = district_daily(spark, sf_dir)
    return _rounded(share_of_baseline(d, "date", "total_volume", ["district"], BASELINE_YEARS,
                                      COMPARE_YEARS), ["district"])


@register("share_base_year", sql=f"""
WITH {SQL_DAILY}, {SQL_CAL},
base AS (SELECT week, weekday, avg(total_volume) AS baseline FROM cal
         WHERE date >= DATE '1995-01-01' AND date < DATE '1997-01-01' GROUP BY 1, 2)
SELECT c.date, c.total_volume, round(b.baseline, 6) AS baseline,
       round(c.total_volume / b.baseline, 6) AS share,
       round(c.total_volume / b.baseline - 1, 6) AS pct_diff
FROM cal c LEFT JOIN base b USING (week, weekday)
WHERE c.date >= DATE '1997-01-01' AND c.date < DATE '1998-01-01'
""")
def q_share_base_year(spark, sf_dir):
    daily = daily_orders(spark, sf_dir).select("date", "total_volume")
    return _rounded(share_of_baseline(daily, "date", "total_volume", (), (1995, 1996), (1997, 1997)))


@register("calendar_baseline", sql=f"""
WITH {SQL_DAILY}, {SQL_CAL}
SELECT week, weekday, round(avg(total_volume), 6) AS baseline, COUNT(total_volume) AS baseline_days
FROM cal WHERE date >= DATE '1995-01-01' AND date < DATE '1998-01-01' GROUP BY 1, 2
""")
def q_calendar_baseline(spark, sf_dir):
    daily = daily_orders(spark, sf_dir)
    b = calendar_baseline(daily, "date", "total_volume", (), BASELINE_YEARS)
    return b.select("week", "weekday", r6("baseline").alias("baseline"), "baseline_days")


@register("calendar_keys", sql=f"""
WITH {SQL_DAILY}, {SQL_CAL}
SELECT date, year, week, weekday, total_volume FROM cal
""")
def q_calendar_keys(spark, sf_dir):
    return calendar_keys(daily_orders(spark, sf_dir), "date").select(
        "date", "year", "week", "weekday", "total_volume")


@register("join_left_multi", sql=f"""
WITH {SQL_GEO},
daily AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date, g.district,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_volume
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN geo g ON c.c_nationkey = g.c_nationkey GROUP BY 1, 2), {SQL_CAL},
base AS (SELECT week, weekday, district, avg(total_volume) AS baseline FROM cal
         WHERE date >= DATE '1995-01-01' AND date < DATE '1998-01-01' GROUP BY 1, 2, 3)
SELECT week, weekday, district, c.date, c.total_volume, round(b.baseline, 6) AS baseline
FROM cal c LEFT JOIN base b USING (week, weekday, district)
WHERE c.date >= DATE '1998-01-01'
""")
def q_join_left_multi(spark, sf_dir):
    # Both join sides derive from the district-daily table (one row per day and district);
    # checkpointing it scans and joins the fact once instead of once per side.
    d = calendar_keys(checkpointed(district_daily(spark, sf_dir)), "date")
    base = (d.where(F.col("date") < F.lit("1998-01-01").cast("date"))
            .where(F.col("date") >= F.lit("1995-01-01").cast("date"))
            .groupBy("week", "weekday", "district").agg(F.avg("total_volume").alias("baseline")))
    cur = d.where(F.col("date") >= F.lit("1998-01-01").cast("date"))
    j = cur.join(base, ["week", "weekday", "district"], "left")
    return j.select("week", "weekday", "district", "date", "total_volume", r6("baseline").alias("baseline"))


@register("group_sum", sql=f"""
WITH {SQL_GEO}
SELECT CAST(o.o_orderdate AS DATE) AS date, g.district,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_volume
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN geo g ON c.c_nationkey = g.c_nationkey GROUP BY 1, 2
""")
def q_group_sum(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    j = o.join(customer_geo(spark, sf_dir), "o_custkey", "inner")
    return group_sum(j, ["date", "district"], "price", "total_volume").withColumn(
        "total_volume", F.col("total_volume").cast("double"))


@register("share_merged", sql=sql_of("share_by_district"))
def q_share_merged(spark, sf_dir):
    """The share by district from baseline sums stored year by year; the last step reads the compared
    years of the fact only."""
    path = scratch_path(spark, "baseline_parts")
    daily = district_daily(spark, sf_dir)
    for year in range(BASELINE_YEARS[0], BASELINE_YEARS[1] + 1):
        lo, hi = year_bounds(year, year)
        write_parts(baseline_parts(daily.where(between_dates("date", lo, hi)), by=["district"]), path, "year")
    return _rounded(share_from_parts(daily, spark.read.parquet(path), by=["district"], baseline_years=BASELINE_YEARS,
                                     compare_years=COMPARE_YEARS), ["district"])
