"""Gaps, gap filling and daily-from-running-total on daily panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators.panel import daily_from_total, fill_last, fill_mean, gap_list, gaps, running_total
from panelspark.plans.common import daily_orders, money_sum, r6, table
from panelspark.plans.registry import register

_NATION_PANEL_SQL = """
panel AS (SELECT c.c_nationkey, CAST(o.o_orderdate AS DATE) AS date, COUNT(*) AS n_orders,
                 CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
          FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)"""

_SPINE_SQL = """
spine AS (SELECT c_nationkey, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
          FROM panel GROUP BY 1),
j AS (SELECT s.c_nationkey, s.date, p.total, p.n_orders, p.date IS NULL AS filled
      FROM spine s LEFT JOIN panel p ON s.c_nationkey = p.c_nationkey AND s.date = p.date)"""


def nation_panel(spark, sf_dir):
    """(c_nationkey, date, n_orders, total): one row per nation and day with orders."""
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return (o.join(c, "o_custkey").groupBy("c_nationkey", "date")
            .agg(F.count(F.lit(1)).alias("n_orders"), money_sum("o_totalprice").alias("total")))


@register("gap_global", sql="""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date, lag(date) OVER (ORDER BY date) AS prev_date,
       CAST(datediff('day', lag(date) OVER (ORDER BY date), date) AS INTEGER) AS gap
FROM d
""")
def q_gap_global(spark, sf_dir):
    # One series: windows by blocks of the calendar.
    d = daily_orders(spark, sf_dir).select("date")
    return gaps(d, [], "date")


@register("gap_by_entity", sql=f"""
WITH {_NATION_PANEL_SQL}
SELECT c_nationkey, date, lag(date) OVER w AS prev_date, CAST(datediff('day', lag(date) OVER w, date) AS INTEGER) AS gap
FROM panel WINDOW w AS (PARTITION BY c_nationkey ORDER BY date)
""")
def q_gap_by_entity(spark, sf_dir):
    return gaps(nation_panel(spark, sf_dir).select("c_nationkey", "date"), ["c_nationkey"], "date")


@register("gap_list", sql=f"""
WITH {_NATION_PANEL_SQL},
g AS (SELECT c_nationkey, date, lag(date) OVER w AS prev_date, CAST(datediff('day', lag(date) OVER w, date) AS INTEGER) AS gap
      FROM panel WINDOW w AS (PARTITION BY c_nationkey ORDER BY date))
SELECT * FROM g WHERE gap <> 1 AND c_nationkey <> 0
""")
def q_gap_list(spark, sf_dir):
    p = nation_panel(spark, sf_dir).select("c_nationkey", "date")
    return gap_list(p, ["c_nationkey"], "date", keep=F.col("c_nationkey") != 0)


@register("gap_fill_last", sql=f"""
WITH {_NATION_PANEL_SQL}, {_SPINE_SQL}
SELECT c_nationkey, date,
       CASE WHEN filled THEN last_value(total IGNORE NULLS) OVER w ELSE total END AS total,
       CASE WHEN filled THEN last_value(n_orders IGNORE NULLS) OVER w ELSE n_orders END AS n_orders, filled
FROM j WINDOW w AS (PARTITION BY c_nationkey ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def q_gap_fill_last(spark, sf_dir):
    p = nation_panel(spark, sf_dir)
    return fill_last(p, ["c_nationkey"], ["total", "n_orders"], "date").select(
        "c_nationkey", "date", "total", "n_orders", "filled")


@register("gap_fill_mean", sql=f"""
WITH {_NATION_PANEL_SQL},
obs AS (SELECT c_nationkey, date, total, row_number() OVER w AS rn, lead(date) OVER w AS next_date
        FROM panel WINDOW w AS (PARTITION BY c_nationkey ORDER BY date)),
hole AS (SELECT c_nationkey, rn, date, next_date FROM obs WHERE next_date > date + 1),
near AS (SELECT h.c_nationkey, h.rn, avg(o.total) AS total
         FROM hole h JOIN obs o ON o.c_nationkey = h.c_nationkey AND o.rn > h.rn - 2 AND o.rn <= h.rn + 2
         GROUP BY 1, 2)
SELECT c_nationkey, date, round(total, 6) AS total, false AS filled FROM panel
UNION ALL
SELECT h.c_nationkey, CAST(unnest(generate_series(h.date + INTERVAL 1 DAY, h.next_date - INTERVAL 1 DAY,
                                                  INTERVAL 1 DAY)) AS DATE), round(n.total, 6), true
FROM hole h JOIN near n USING (c_nationkey, rn)
""")
def q_gap_fill_mean(spark, sf_dir):
    p = nation_panel(spark, sf_dir).select("c_nationkey", "date", "total")
    f = fill_mean(p, ["c_nationkey"], ["total"], "date", k=2)
    return f.select("c_nationkey", "date", r6("total").alias("total"), "filled")


_RUN_SQL = """
run AS (SELECT c_nationkey, date, n_orders,
               SUM(n_orders) OVER (PARTITION BY c_nationkey ORDER BY date
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_orders
        FROM panel)"""


def running_orders(spark, sf_dir):
    p = nation_panel(spark, sf_dir).select("c_nationkey", "date", "n_orders")
    return running_total(p, ["c_nationkey"], ["n_orders"], "date", suffix="_cum") \
        .withColumnRenamed("n_orders_cum", "cum_orders")


@register("daily_from_total", sql=f"""
WITH {_NATION_PANEL_SQL}, {_RUN_SQL}
SELECT c_nationkey, date, n_orders, CAST(cum_orders AS BIGINT) AS cum_orders, n_orders AS cum_orders_daily
FROM run
""")
def q_daily_from_total(spark, sf_dir):
    return daily_from_total(running_orders(spark, sf_dir), ["c_nationkey"], ["cum_orders"], "date").select(
        "c_nationkey", "date", "n_orders", "cum_orders", "cum_orders_daily")


@register("daily_from_total_nulls", sql=f"""
WITH {_NATION_PANEL_SQL}, {_RUN_SQL},
known AS (SELECT c_nationkey, date, CASE WHEN day(date) % 3 <> 0 THEN CAST(cum_orders AS BIGINT) END AS cum_orders
          FROM run),
step AS (SELECT c_nationkey, date, cum_orders - lag(cum_orders, 1, 0) OVER (PARTITION BY c_nationkey ORDER BY date) AS d
         FROM known WHERE cum_orders IS NOT NULL)
SELECT k.c_nationkey, k.date, k.cum_orders, CAST(s.d AS BIGINT) AS cum_orders_daily
FROM known k LEFT JOIN step s ON k.c_nationkey = s.c_nationkey AND k.date = s.date
""")
def q_daily_from_total_nulls(spark, sf_dir):
    """Totals unknown on every day of the month that 3 divides."""
    known = running_orders(spark, sf_dir).withColumn(
        "cum_orders", F.when(F.dayofmonth("date") % 3 != 0, F.col("cum_orders")))
    return daily_from_total(known, ["c_nationkey"], ["cum_orders"], "date").select(
        "c_nationkey", "date", "cum_orders", "cum_orders_daily")
