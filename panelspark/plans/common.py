"""Shared inputs derived from the driver tables (all lazy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.relational import broadcast_if_bounded
from panelspark.session import ensure_checkpoint_dir

BASELINE_YEARS = (1995, 1997)
COMPARE_YEARS = (1998, None)
ORIGIN = "1998-01-01"
# Dimensions whose size the data model fixes (25 nations, 5 regions); the check in
# broadcast_if_bounded still guards the hint.
SMALL_DIM_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise a small derived table in the session's checkpoint folder (lineage cut)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def money_sum(c: str) -> Column:
    """Order-independent sum of a 2-decimal money column (decimal sum, then double)."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, total_volume, n_orders): the statewide daily series."""
    o = table(spark, sf_dir, "orders")
    return (o.select(F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
            .groupBy("date").agg(money_sum("o_totalprice").alias("total_volume"),
                                 F.count(F.lit(1)).alias("n_orders")))


def nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_nationkey, county, district): nation -> region names; tiny, broadcast after a check."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    geo = n.join(r, n.n_regionkey == r.r_regionkey, "inner").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("county"),
        F.col("r_name").alias("district"))
    # region is keyed by r_regionkey, so the mapping has at most as many rows as nation:
    # one early-stopping count on nation bounds it.
    return broadcast_if_bounded(geo, SMALL_DIM_ROWS, probe=n)


def customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, c_nationkey, county, district) per customer."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return c.join(nation_region(spark, sf_dir), "c_nationkey", "inner")


def timeline_columns(orders: DataFrame) -> DataFrame:
    """Orders read as events: adds date, category, order_type, event_type, description."""
    order_type = (F.when(F.col("o_orderstatus") == "F", "Restriction")
                  .when(F.col("o_orderstatus") == "O", "Relaxation").otherwise("Other"))
    event_type = F.when(F.col("o_totalprice") > 300000, "Effective").otherwise("Announced")
    return orders.withColumns({
        "date": F.col("o_orderdate").cast("date"),
        "category": F.col("o_orderpriority"),
        "order_type": order_type,
        "event_type": event_type,
        "description": F.concat(F.lit("order "), F.col("o_orderkey").cast("string")),
    })


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as an event timeline: (date, category, order_type, event_type, description)."""
    return timeline_columns(table(spark, sf_dir, "orders")).select(
        "date", "category", "order_type", "event_type", "description")


# SQL fragments shared by the oracle texts.
SQL_DAILY = """
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_volume,
         COUNT(*) AS n_orders
  FROM orders GROUP BY 1)"""

SQL_CAL = """
cal AS (
  SELECT *, lpad(CAST(weekofyear(date) AS VARCHAR), 2, '0') AS week,
            lpad(CAST(dayofweek(date) + 1 AS VARCHAR), 2, '0') AS weekday,
            CAST(year(date) AS INTEGER) AS year
  FROM daily)"""

SQL_GEO = """
geo AS (
  SELECT n.n_nationkey AS c_nationkey, n.n_name AS county, r.r_name AS district
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""

SQL_TIMELINE = """
timeline AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS category,
         CASE WHEN o_orderstatus = 'F' THEN 'Restriction'
              WHEN o_orderstatus = 'O' THEN 'Relaxation' ELSE 'Other' END AS order_type,
         CASE WHEN o_totalprice > 300000 THEN 'Effective' ELSE 'Announced' END AS event_type,
         'order ' || CAST(o_orderkey AS VARCHAR) AS description
  FROM orders)"""
