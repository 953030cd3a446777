"""Hourly-to-daily roll-up, the station dimension, the daily fact and the county panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.text import override, regex_conform
from panelspark.operators.dims import attach, merge_candidates
from panelspark.operators.rollup import hours_to_daily, wide_by_hour
from panelspark.plans.common import SQL_GEO, money_sum, nation_region, table
from panelspark.plans.conform_plans import DISTRICT_BY_COUNTY, NATION_PAD_PATTERN
from panelspark.plans.registry import register
from panelspark.sources.schemas import HOUR_COLUMNS


def _hourly_sql() -> str:
    wide = ",\n    ".join(
        f"SUM(CASE WHEN hour(ts) = {i} THEN 1 END) AS {h}" for i, h in enumerate(HOUR_COLUMNS))
    sums = ",\n    ".join(f"SUM({h}) AS {h}" for h in HOUR_COLUMNS)
    strict = " + ".join(HOUR_COLUMNS)
    filled = " + ".join(f"COALESCE({h}, 0)" for h in HOUR_COLUMNS)
    return f"""
WITH wide AS (
  SELECT user_id AS station_id, event_type AS dir_of_travel, CAST(ts AS DATE) AS date,
    {wide}
  FROM events GROUP BY 1, 2, 3),
daily AS (
  SELECT station_id, date,
    {sums}
  FROM wide GROUP BY 1, 2)
SELECT station_id, date, CAST({strict} AS BIGINT) AS total_volume,
       CAST({filled} AS BIGINT) AS total_volume_zero_filled
FROM daily"""


@register("hourly_daily_total", sql=_hourly_sql())
def q_hourly_daily_total(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("station_id"), F.col("event_type").alias("dir_of_travel"),
        F.col("ts").cast("date").alias("date"), "ts")
    wide = wide_by_hour(ev, ["station_id", "dir_of_travel", "date"], "ts")
    return hours_to_daily(wide, ["station_id", "date"], out="total_volume",
                          out_zero_filled="total_volume_zero_filled")


# Fixed values of the key: spellings that the rules change.
NATION_CORRECTIONS = {"NATION_5": "FIFTH NATION"}
NATION_PREFIX_RULES = (("NATION_2", "NATION TWENTY"),)


def station_dimension(spark, sf_dir):
    """(station_id, county, district), unique by station_id.

    Customers are read once: each row becomes a current candidate (priority 0, outside the
    AUTOMOBILE segment) and/or a retired candidate (priority 1, AUTOMOBILE or BUILDING,
    status = segment); suppliers are retired candidates with status 'SUPPLIER'."""
    geo = nation_region(spark, sf_dir)
    cust = table(spark, sf_dir, "customer").join(geo, "c_nationkey", "inner")
    seg = F.col("c_mktsegment")
    roles = F.array(
        F.when(seg != "AUTOMOBILE", F.struct(F.lit(0).alias("prio"), F.lit(None).cast("string").alias("status"))),
        F.when(seg.isin("AUTOMOBILE", "BUILDING"), F.struct(F.lit(1).alias("prio"), seg.alias("status"))))
    cust_cand = (cust.select(F.col("c_custkey").alias("station_id"), "county", "district", F.explode(roles).alias("r"))
                 .where(F.col("r").isNotNull()).select("station_id", "county", "district", "r.prio", "r.status"))
    supp = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "c_nationkey")
    supp_cand = supp.join(geo, "c_nationkey", "inner").select(
        F.col("s_suppkey").alias("station_id"), "county", "district", F.lit(1).alias("prio"),
        F.lit("SUPPLIER").alias("status"))
    # The district comes with the candidate's nation; names are conformed after the merge.
    return merge_candidates(cust_cand.unionByName(supp_cand), "station_id", "county", carry=["district"],
                            corrections=NATION_CORRECTIONS, prefix_rules=NATION_PREFIX_RULES).select(
        "station_id", "county", "district")


_STATION_DIM_SQL = f"""
{SQL_GEO},
cust AS (SELECT c.c_custkey AS station_id, g.county, c.c_mktsegment AS seg
         FROM customer c JOIN geo g ON c.c_nationkey = g.c_nationkey),
cur AS (SELECT station_id, county FROM cust WHERE seg <> 'AUTOMOBILE'),
ret AS (SELECT station_id, county, seg AS status FROM cust WHERE seg IN ('AUTOMOBILE', 'BUILDING')
        UNION ALL
        SELECT s.s_suppkey, g.county, 'SUPPLIER' FROM supplier s JOIN geo g ON s.s_nationkey = g.c_nationkey),
ret1 AS (SELECT station_id, county FROM (
           SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY status, county) AS rn FROM ret)
         WHERE rn = 1),
dim0 AS (SELECT * FROM cur
         UNION ALL
         SELECT * FROM ret1 WHERE station_id NOT IN (SELECT station_id FROM cur)),
dim AS (SELECT d.station_id, g.district,
               CASE WHEN d.county LIKE 'NATION_2%' THEN 'NATION TWENTY'
                    WHEN d.county = 'NATION_5' THEN 'FIFTH NATION' ELSE d.county END AS county
        FROM dim0 d LEFT JOIN geo g ON d.county = g.county)"""


@register("station_dim", sql=f"WITH {_STATION_DIM_SQL}\nSELECT station_id, county, district FROM dim")
def q_station_dim(spark, sf_dir):
    return station_dimension(spark, sf_dir)


@register("fact_with_geo", sql=f"""
WITH {_STATION_DIM_SQL},
sd AS (SELECT o_custkey AS station_id, CAST(o_orderdate AS DATE) AS date,
              CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_volume
       FROM orders GROUP BY 1, 2)
SELECT d.county, d.district, sd.station_id, sd.date, sd.total_volume
FROM sd JOIN dim d ON sd.station_id = d.station_id
""")
def q_fact_with_geo(spark, sf_dir):
    sd = (table(spark, sf_dir, "orders")
          .groupBy(F.col("o_custkey").alias("station_id"), F.col("o_orderdate").cast("date").alias("date"))
          .agg(money_sum("o_totalprice").alias("total_volume")))
    dim = station_dimension(spark, sf_dir)
    return attach(sd, dim, "station_id", "inner").select(
        "county", "district", "station_id", "date", "total_volume")


@register("county_panel", sql=f"""
WITH {SQL_GEO},
per AS (SELECT CAST(o.o_orderdate AS DATE) AS date, g.county, g.district AS state,
               COUNT(*) AS cases, COUNT(*) FILTER (WHERE o.o_orderstatus = 'F') AS deaths
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN geo g ON c.c_nationkey = g.c_nationkey
        WHERE g.district = 'AMERICA' AND g.county <> 'NATION_1'
        GROUP BY 1, 2, 3)
SELECT date, regexp_replace(county, '^NATION_(\\d)$', 'NATION_0\\1') AS county, state, cases, deaths,
       CASE county WHEN 'NATION_3' THEN 'AFRICA' WHEN 'NATION_7' THEN 'EUROPE' ELSE state END AS district
FROM per
""")
def q_county_panel(spark, sf_dir):
    # One state without its unknown county, filtered before the fact is read: the customers of
    # the kept nations are joined to the orders, not the other way round.
    geo = nation_region(spark, sf_dir).withColumnRenamed("district", "state").where(
        (F.col("state") == "AMERICA") & (F.col("county") != "NATION_1"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(
        geo.select("c_nationkey"), "c_nationkey", "left_semi")
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_orderstatus")
    # Aggregate to nation x day before attaching names: the shuffle carries counts only.
    per = (o.join(c, "o_custkey").groupBy("c_nationkey", "date")
           .agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("o_orderstatus") == "F").alias("deaths")))
    return per.join(geo, "c_nationkey").select("date", regex_conform("county", NATION_PAD_PATTERN, "NATION_0$1").alias("county"),
                    "state", "cases", "deaths",
                    override("state", "county", DISTRICT_BY_COUNTY).alias("district"))
