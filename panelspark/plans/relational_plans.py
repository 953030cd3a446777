"""Projections, filters, joins, set operations, sorting, sampling and small aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators.dims import first_per_key
from panelspark.operators.relational import (
    anti_join,
    broadcast_if_bounded,
    full_outer_distinct,
    pivot_count,
    sample_n,
    top_k,
)
from panelspark.operators.rollup import group_count, group_mean, minmax
from panelspark.plans.common import SMALL_DIM_ROWS, money_sum, r6, table
from panelspark.plans.registry import register

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _current(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "AUTOMOBILE")


@register("project", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q_project(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@register("rename_drop", sql="""
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice FROM orders
""")
def q_rename_drop(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return (o.withColumnsRenamed({"o_orderkey": "order_id", "o_custkey": "customer_id"})
            .drop("o_orderpriority", "o_orderdate"))


@register("computed_column", sql="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INTEGER) AS year,
       o_totalprice / 1000 AS price_k, o_orderstatus = 'O' AS is_open
FROM orders
""")
def q_computed_column(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return (o.withColumn("date", F.col("o_orderdate").cast("date"))
            .withColumns({"year": F.year("date"), "price_k": F.col("o_totalprice") / 1000,
                          "is_open": F.col("o_orderstatus") == "O"})
            .select("o_orderkey", "date", "year", "price_k", "is_open"))


@register("filter_eq", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def q_filter_eq(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")


@register("filter_ne", sql="SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'")
def q_filter_ne(spark, sf_dir):
    return _current(spark, sf_dir).select("c_custkey", "c_mktsegment")


@register("filter_null", sql="""
SELECT c.c_custkey, c.c_name FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey
WHERE s.s_suppkey IS NULL
""")
def q_filter_null(spark, sf_dir):
    """Customers without a supplier of the same id: the null side of an outer join."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    j = c.join(s, c.c_custkey == s.s_suppkey, "left")
    return j.where(F.col("s_suppkey").isNull()).select("c_custkey", "c_name")


@register("filter_col_compare", sql="""
SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount
""")
def q_filter_col_compare(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.where(F.col("l_tax") > F.col("l_discount")).select("l_orderkey", "l_linenumber", "l_tax", "l_discount")


@register("filter_and", sql="""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000
""")
def q_filter_and(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return (o.where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 200000))
            .select("o_orderkey", "o_totalprice"))


@register("filter_range", sql="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
""")
def q_filter_range(spark, sf_dir):
    # Bounds on the raw column (not year(...)) so the scan receives the pushed filter.
    o = table(spark, sf_dir, "orders")
    lo, hi = F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")
    return (o.where((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi))
            .select("o_orderkey", F.col("o_orderdate").cast("date").alias("date")))


@register("join_inner", sql="""
SELECT c.c_custkey, c.c_name, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def q_join_inner(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = broadcast_if_bounded(table(spark, sf_dir, "nation"), SMALL_DIM_ROWS)
    return c.join(n, c.c_nationkey == n.n_nationkey, "inner").select("c_custkey", "c_name", "n_name")


@register("join_left", sql="""
SELECT o.o_orderkey, o.o_custkey, c.c_nationkey, c.c_mktsegment
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def q_join_left(spark, sf_dir):
    # customer grows with the data: no hint; the planner's size estimate (and AQE at run
    # time) choose between a broadcast and a shuffle join.
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        "o_orderkey", "o_custkey", "c_nationkey", "c_mktsegment")


@register("join_full_expr", sql="""
SELECT DISTINCT a.cust_nation, b.supp_nation
FROM (SELECT DISTINCT n.n_name AS cust_nation FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
      WHERE c.c_acctbal < 0) a
FULL OUTER JOIN
     (SELECT DISTINCT n.n_name AS supp_nation FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
      WHERE s.s_acctbal < 0) b
ON a.cust_nation = b.supp_nation
""")
def q_join_full_expr(spark, sf_dir):
    n = broadcast_if_bounded(table(spark, sf_dir, "nation"), SMALL_DIM_ROWS)
    # Nations with customers in debt against nations with suppliers in debt.
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0)
    s = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") < 0)
    a = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("cust_nation")).distinct()
    b = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("supp_nation")).distinct()
    return full_outer_distinct(a, b, a.cust_nation == b.supp_nation, ["cust_nation", "supp_nation"])


@register("join_full_using", sql="""
SELECT date, o.n_orders, l.n_shipped
FROM (SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n_orders FROM orders GROUP BY 1) o
FULL OUTER JOIN (SELECT CAST(l_shipdate AS DATE) AS date, COUNT(*) AS n_shipped FROM lineitem GROUP BY 1) l
USING (date)
""")
def q_join_full_using(spark, sf_dir):
    o = (table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"))
         .agg(F.count(F.lit(1)).alias("n_orders")))
    li = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
          .agg(F.count(F.lit(1)).alias("n_shipped")))
    return o.join(li, "date", "full_outer").select("date", "n_orders", "n_shipped")


@register("join_anti", sql="""
SELECT s.s_suppkey, s.s_name FROM supplier s
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_mktsegment <> 'AUTOMOBILE' AND c.c_custkey = s.s_suppkey)
""")
def q_join_anti(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    cur = _current(spark, sf_dir).select(F.col("c_custkey").alias("s_suppkey"))
    return anti_join(s, cur, "s_suppkey")


@register("except_distinct", sql="""
SELECT o_custkey FROM orders
EXCEPT
SELECT c_custkey FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'
""")
def q_except_distinct(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    cur = _current(spark, sf_dir).select(F.col("c_custkey").alias("o_custkey"))
    return o.subtract(cur)


@register("union_by_name", sql="""
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, 'customer' AS kind
FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier
""")
def q_union_by_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
        F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("acctbal"),
        F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"),
        F.col("s_suppkey").alias("id"))
    return c.unionByName(s)


@register("union_distinct", sql="""
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier
""")
def q_union_distinct(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = table(spark, sf_dir, "supplier").select("s_nationkey")
    return c.union(s).distinct()


@register("distinct_rows", sql="SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def q_distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()


@register("group_count", sql="""
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS count FROM orders GROUP BY 1, 2
""")
def q_group_count(spark, sf_dir):
    return group_count(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("group_mean", sql="""
WITH per AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date, c.c_nationkey, COUNT(*) AS n_orders,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT date, round(avg(n_orders), 6) AS avg_orders, round(avg(total), 6) AS avg_total
FROM per GROUP BY 1
""")
def q_group_mean(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    per = (o.join(c, "o_custkey").groupBy("date", "c_nationkey")
           .agg(F.count(F.lit(1)).alias("n_orders"), money_sum("o_totalprice").alias("total")))
    m = group_mean(per, ["date"], {"avg_orders": "n_orders", "avg_total": "total"})
    return m.select("date", r6("avg_orders").alias("avg_orders"), r6("avg_total").alias("avg_total"))


@register("global_minmax", sql="""
SELECT min(CAST(o_orderdate AS DATE)) AS min_date, max(CAST(o_orderdate AS DATE)) AS max_date,
       min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice
FROM orders
""")
def q_global_minmax(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    return minmax(o, ["date", "o_totalprice"])


@register("pivot_count", sql="""
SELECT COUNT(*) FILTER (WHERE event_type = 'click') AS click,
       COUNT(*) FILTER (WHERE event_type = 'error') AS error,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchase,
       COUNT(*) FILTER (WHERE event_type = 'signup') AS signup,
       COUNT(*) FILTER (WHERE event_type = 'view') AS view
FROM events
""")
def q_pivot_count(spark, sf_dir):
    return pivot_count(table(spark, sf_dir, "events"), "event_type", EVENT_TYPES)


@register("sort_multi", sql="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice FROM orders
ORDER BY date, o_totalprice DESC, o_orderkey
""")
def q_sort_multi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    return o.orderBy("date", F.desc("o_totalprice"), "o_orderkey")


@register("top_k", sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
""")
def q_top_k(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return top_k(o, 10, [F.desc("o_totalprice"), F.col("o_orderkey")])


@register("sample_n", sql="""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders
WHERE o_orderdate > TIMESTAMP '1996-02-10' AND o_orderdate < TIMESTAMP '1996-11-20'
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || 'panel'), o_orderkey LIMIT 20
""")
def q_sample_n(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lo, hi = F.lit("1996-02-10").cast("timestamp_ntz"), F.lit("1996-11-20").cast("timestamp_ntz")
    o = o.where((F.col("o_orderdate") > lo) & (F.col("o_orderdate") < hi)).select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return sample_n(o, 20, "o_orderkey", "panel")


@register("first_per_key", sql="""
SELECT o_custkey, o_orderkey, date, o_orderstatus FROM (
  SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderstatus,
         row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS rn
  FROM orders) WHERE rn = 1
""")
def q_first_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("date"), "o_orderstatus")
    return first_per_key(o, ["o_custkey"], ["date", "o_orderkey"])
