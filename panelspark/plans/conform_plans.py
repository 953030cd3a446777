"""Date parsing, regex rewrites, correction tables and overrides on driver data."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.dates import parse_mixed_dates
from panelspark.functions.text import apply_corrections, override, regex_conform
from panelspark.plans.common import SQL_GEO, customer_geo, table
from panelspark.plans.registry import register

# Fixed values used by the conformity keys on the driver tables.
SEGMENT_CORRECTIONS = {"AUTOMOBILE": "AUTO", "HOUSEHOLD": "HOME"}
SEGMENT_PREFIX_RULES = (("MACH", "MACHINERY"),)
NATION_PAD_PATTERN = r"^NATION_(\d)$"
DISTRICT_BY_COUNTY = {"NATION_3": "AFRICA", "NATION_7": "EUROPE"}


@register("parse_mixed_dates", sql="""
WITH raw AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'bad'
              WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')
              ELSE strftime(CAST(o_orderdate AS DATE), '%-m/%-d/%Y') END AS raw
  FROM orders)
SELECT o_orderkey, raw,
       CAST(COALESCE(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%m/%d/%Y')) AS DATE) AS date
FROM raw
""")
def q_parse_mixed_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("date")
    raw = (F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), F.lit("bad"))
           .when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), F.date_format(d, "yyyy-MM-dd"))
           .otherwise(F.date_format(d, "M/d/yyyy")))
    return (o.select("o_orderkey", raw.alias("raw"))
            .withColumn("date", parse_mixed_dates("raw")))


@register("regex_conform", sql=f"""
WITH {SQL_GEO}
SELECT c.c_custkey, regexp_replace(g.county, '^NATION_(\\d)$', 'NATION_0\\1') AS county
FROM customer c JOIN geo g ON c.c_nationkey = g.c_nationkey
""")
def q_regex_conform(spark, sf_dir):
    g = customer_geo(spark, sf_dir)
    return g.select(F.col("o_custkey").alias("c_custkey"),
                    regex_conform("county", NATION_PAD_PATTERN, "NATION_0$1").alias("county"))


@register("spelling_conform", sql="""
WITH raw AS (
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ' ' || c_mktsegment || chr(160) ELSE c_mktsegment END AS raw
  FROM customer),
clean AS (SELECT c_custkey, raw, trim(regexp_replace(raw, '[\\s\\x{00A0}]+', ' ', 'g')) AS x FROM raw)
SELECT c_custkey, raw,
       CASE WHEN starts_with(x, 'MACH') THEN 'MACHINERY'
            WHEN x = 'AUTOMOBILE' THEN 'AUTO'
            WHEN x = 'HOUSEHOLD' THEN 'HOME'
            ELSE x END AS segment
FROM clean
""")
def q_spelling_conform(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_acctbal") < 0,
                 F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" "))).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", raw.alias("raw")).withColumn(
        "segment", apply_corrections("raw", SEGMENT_CORRECTIONS, SEGMENT_PREFIX_RULES))


@register("map_override", sql=f"""
WITH {SQL_GEO}
SELECT c.c_custkey, g.county,
       CASE g.county WHEN 'NATION_3' THEN 'AFRICA' WHEN 'NATION_7' THEN 'EUROPE' ELSE g.district END AS district
FROM customer c JOIN geo g ON c.c_nationkey = g.c_nationkey
""")
def q_map_override(spark, sf_dir):
    g = customer_geo(spark, sf_dir)
    return g.select(F.col("o_custkey").alias("c_custkey"), "county",
                    override("district", "county", DISTRICT_BY_COUNTY).alias("district"))
