"""Sources, sinks and catalog: CSV scans, yearly file families, managed tables, views.

Intermediate files go under the shared checkpoint folder of the session
(``spark.checkpoint.dir``), never a machine-local temp folder.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from panelspark.functions.dates import parse_mixed_dates
from panelspark.sources.intake import scan_intake
from panelspark.sources.io import (
    drop_table,
    empty_frame,
    list_catalog,
    read_csv,
    read_table,
    register_views,
    scan_family,
    union_all,
    write_table,
)
from panelspark.sources.versions import publish, read_published
from panelspark.plans.common import SQL_DAILY, daily_orders, table
from panelspark.plans.registry import register
from panelspark.session import scratch_path

ORDERS_CSV_SCHEMA = StructType([
    StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()),
    StructField("o_orderstatus", StringType()), StructField("o_totalprice", DoubleType()),
    StructField("date", StringType()), StructField("o_orderpriority", StringType()),
])
FAMILY_SCHEMA = StructType([StructField("o_orderkey", LongType()), StructField("date", StringType()),
                            StructField("o_totalprice", DoubleType())])
PARTY_SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType()),
                           StructField("nationkey", LongType()), StructField("kind", StringType())])
VIEW_PREFIX = "ps_v_"
DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@register("scan_csv", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS date, o_orderpriority
FROM orders
""")
def q_scan_csv(spark, sf_dir):
    path = scratch_path(spark, "orders_csv")
    src = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority")
    # Header names deliberately differ from the schema: binding is by position.
    src.write.mode("overwrite").option("header", "true").csv(path)
    df = read_csv(spark, path, ORDERS_CSV_SCHEMA)
    return df.withColumn("date", parse_mixed_dates("date"))


@register("scan_family", sql="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders
""")
def q_scan_family(spark, sf_dir):
    """Write orders as one CSV folder per year (ISO dates before 1999, M/d/yyyy after,
    like the source's two file layouts), then read the whole family in one scan."""
    path = scratch_path(spark, "orders_family")
    d = F.col("o_orderdate").cast("date")
    raw = F.when(F.year(d) < 1999, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "M/d/yyyy"))
    src = table(spark, sf_dir, "orders").select(
        "o_orderkey", raw.alias("date"), "o_totalprice", F.year(d).alias("year"))
    (src.hint("rebalance", F.col("year")).write.mode("overwrite").partitionBy("year")
     .option("header", "true").csv(path))
    fam = scan_family(spark, path, FAMILY_SCHEMA, strict=True)
    return fam.withColumn("date", parse_mixed_dates("date")).select("o_orderkey", "date", "o_totalprice", "year")


@register("family_layouts", sql="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders
""")
def q_family_layouts(spark, sf_dir):
    """Orders as one CSV folder a year, with other column orders, header spellings and an extra column
    from 1996 on, read as one family by the headers."""
    path = scratch_path(spark, "orders_layouts")
    d = F.col("o_orderdate").cast("date")
    src = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("date"), "o_totalprice", "o_orderstatus", F.year(d).alias("year"))
    early = src.where(F.col("year") < 1996).select("o_orderkey", "date", "o_totalprice", "year")
    late = src.where(F.col("year") >= 1996).select(
        F.col("o_totalprice").alias("O Totalprice"), "o_orderstatus", F.col("o_orderkey").alias("Order Key"), "date", "year")
    for part in (early, late):
        part.hint("rebalance", F.col("year")).write.mode("append").partitionBy("year").option("header", "true").csv(path)
    fam = scan_intake(spark, path, FAMILY_SCHEMA, {"o_orderkey": ["order key"]}, year_col="year",
                      dates={"date": parse_mixed_dates}).good()
    return fam.select("o_orderkey", parse_mixed_dates("date").alias("date"), "o_totalprice", "year")


@register("scan_quarantine", sql="""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS rows_in,
       COUNT(*) FILTER (WHERE NOT (o_orderkey % 7 = 0 OR o_custkey % 11 = 0)) AS rows_good,
       COUNT(*) FILTER (WHERE o_orderkey % 7 = 0 OR o_custkey % 11 = 0) AS rows_quarantined
FROM orders GROUP BY 1
""")
def q_scan_quarantine(spark, sf_dir):
    """Orders as a yearly CSV family in which some prices are no numbers and some dates no dates; the rows
    of every year, the good ones and those set apart."""
    path = scratch_path(spark, "orders_quarantine")
    d = F.col("o_orderdate").cast("date")
    src = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 11 == 0, F.lit("31/31/31")).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("date"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.year(d).alias("year"))
    (src.hint("rebalance", F.col("year")).write.mode("overwrite").partitionBy("year").option("header", "true").csv(path))
    fam = scan_intake(spark, path, FAMILY_SCHEMA, year_col="year", dates={"date": parse_mixed_dates})
    return fam.counts(["year"])


@register("table_roundtrip", sql=f"WITH {SQL_DAILY}\nSELECT date, total_volume, n_orders, "
                                 "CAST(year(date) AS INTEGER) AS year FROM daily WHERE year(date) >= 1998")
def q_table_roundtrip(spark, sf_dir):
    """Write the daily series as a year-partitioned Parquet table (dropping any previous
    one first), read it back by name; the year filter prunes partitions at the scan."""
    name = "ps_daily_orders"
    drop_table(spark, name)
    d = daily_orders(spark, sf_dir).withColumn("year", F.year("date"))
    write_table(d, name, partition_by=["year"], path=scratch_path(spark, name))
    return (read_table(spark, name).where(F.col("year") >= 1998)
            .select("date", "total_volume", "n_orders", "year"))


@register("published_set", sql=f"""
WITH {SQL_DAILY}, yearly AS (SELECT CAST(year(date) AS INTEGER) AS year, COUNT(*) AS n_days FROM daily GROUP BY 1)
SELECT date, total_volume, n_orders, CAST(year(date) AS INTEGER) AS year, n_days
FROM daily JOIN yearly ON yearly.year = year(date)
""")
def q_published_set(spark, sf_dir):
    """Two tables published as one set, then a second run whose second table fails: readers still see
    both tables of the first."""
    root = scratch_path(spark, "published")
    daily = daily_orders(spark, sf_dir).withColumn("year", F.year("date"))

    def yearly(staged):
        return staged("daily").groupBy("year").agg(F.count(F.lit(1)).alias("n_days"))

    def broken(staged):
        return yearly(staged).withColumn("n_days", F.raise_error(F.lit("stopped on purpose")).cast("long"))

    publish(spark, root, {"daily": daily, "yearly": yearly}, {"daily": ["year"]})
    try:
        publish(spark, root, {"daily": daily.withColumn("n_orders", F.lit(0)), "yearly": broken}, {"daily": ["year"]})
    except PySparkException as e:
        if "stopped on purpose" not in str(e):
            raise
    now = read_published(spark, root)
    return now["daily"].join(now["yearly"], "year").select("date", "total_volume", "n_orders", "year", "n_days")


@register("view_query", sql="""
SELECT n.n_name AS county, COUNT(*) AS n_customers,
       CAST(SUM(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_acctbal
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1
""")
def q_view_query(spark, sf_dir):
    register_views({f"{VIEW_PREFIX}customer": table(spark, sf_dir, "customer"),
                    f"{VIEW_PREFIX}nation": table(spark, sf_dir, "nation")})
    return spark.sql(f"""
        SELECT n.n_name AS county, COUNT(*) AS n_customers,
               CAST(SUM(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_acctbal
        FROM {VIEW_PREFIX}customer c JOIN {VIEW_PREFIX}nation n ON c.c_nationkey = n.n_nationkey
        GROUP BY n.n_name""")


@register("catalog_list", sql="\nUNION ALL\n".join(
    f"SELECT '{VIEW_PREFIX}{t}' AS tableName, true AS isTemporary, COUNT(*) AS n_rows FROM {t}"
    for t in DRIVER_TABLES))
def q_catalog_list(spark, sf_dir):
    """Register every driver table as a view, list the views from the catalog and attach
    each one's row count (read through the view by name)."""
    register_views({f"{VIEW_PREFIX}{t}": table(spark, sf_dir, t) for t in DRIVER_TABLES})
    listed = list_catalog(spark, f"{VIEW_PREFIX}*").select("tableName", "isTemporary")
    counts = union_all(
        spark.table(f"{VIEW_PREFIX}{t}").agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(f"{VIEW_PREFIX}{t}").alias("tableName"), "n_rows")
        for t in DRIVER_TABLES)
    return listed.join(counts, "tableName", "inner")


@register("union_seeded", sql="""
SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nationkey, 'customer' AS kind FROM customer
UNION ALL
SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT), 'supplier' FROM supplier
""")
def q_union_seeded(spark, sf_dir):
    seed = empty_frame(spark, PARTY_SCHEMA)
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("bigint").alias("nationkey"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("bigint").alias("nationkey"), F.lit("supplier").alias("kind"))
    return union_all([c, s], seed=seed)
