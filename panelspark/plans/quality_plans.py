"""Data-quality keys over whole tables.

The given tables have no nulls, so ``dq_sign`` and ``dq_unique_groups`` blank some values first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import quality as Q
from panelspark.operators.sketches import merged_counts, part_sketches
from panelspark.operators.spelling import propose_spellings
from panelspark.plans.common import table
from panelspark.plans.registry import register
from panelspark.session import scratch_path
from panelspark.sources.io import write_parts

ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _long_sql(source: str, table_name: str, group_expr: str, rows) -> str:
    """UNION ALL of one SELECT per check over an aggregated CTE named ``a``."""
    parts = []
    for check, observed, expected, passed in rows:
        passed = passed or f"(CAST({observed} AS DOUBLE) = CAST({expected} AS DOUBLE))"
        parts.append(
            f"SELECT '{table_name}' AS \"table\", {group_expr} AS \"group\", '{check}' AS \"check\", "
            f"CAST({observed} AS DOUBLE) AS observed, CAST({expected} AS DOUBLE) AS expected, "
            f"CAST({passed} AS BOOLEAN) AS passed FROM a")
    return f"WITH {source}\n" + "\nUNION ALL\n".join(parts)


def _orders_with_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))


_PROFILE_SQL = _long_sql(
    "a AS (SELECT year(o_orderdate) AS year, COUNT(*) AS n, "
    + ", ".join(f"COUNT({c}) AS nn_{c}" for c in ORDERS_COLS) + " FROM orders GROUP BY 1)",
    "orders", "CAST(year AS VARCHAR)",
    [(f"not_null({c})", f"nn_{c}", "n", None) for c in ORDERS_COLS])


@register("dq_profile", sql=_PROFILE_SQL)
def q_dq_profile(spark, sf_dir):
    return Q.profile(_orders_with_year(spark, sf_dir), "orders", ORDERS_COLS, ["year"])


_SIGN_COLS = ["c_acctbal", "c_custkey"]
_SIGN_SQL = _long_sql(
    "c AS (SELECT c_mktsegment, c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal FROM customer), "
    "a AS (SELECT c_mktsegment, COUNT(*) AS n, "
    + ", ".join(f"SUM(CASE WHEN {c} >= 0 THEN 1 ELSE 0 END) AS ok_{c}" for c in _SIGN_COLS)
    + " FROM c GROUP BY 1)",
    "customer", "c_mktsegment",
    [(f"non_negative({c})", f"ok_{c}", "n", None) for c in _SIGN_COLS])


@register("dq_sign", sql=_SIGN_SQL)
def q_dq_sign(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn(
        "c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    return Q.sign_check(c, "customer", _SIGN_COLS, ["c_mktsegment"])


@register("dq_share_valid", sql=_long_sql(
    "a AS (SELECT year(l_shipdate) AS year, avg(CAST(l_discount <= l_tax AS INTEGER)) AS s "
    "FROM lineitem GROUP BY 1)",
    "lineitem", "CAST(year AS VARCHAR)", [("share_valid(discount_le_tax)", "s", "1.0", None)]))
def q_dq_share_valid(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    return Q.share_valid(li, "lineitem", {"discount_le_tax": F.col("l_discount") <= F.col("l_tax")}, ["year"])


_DISTINCT_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@register("dq_distinct", sql=_long_sql(
    "a AS (SELECT " + ", ".join(f"COUNT(DISTINCT {c}) AS d_{c}, COUNT({c}) AS nn_{c}" for c in _DISTINCT_COLS)
    + " FROM orders)",
    "orders", "'all'", [(f"distinct({c})", f"d_{c}", f"nn_{c}", "NULL") for c in _DISTINCT_COLS]))
def q_dq_distinct(spark, sf_dir):
    return Q.distinct_counts(table(spark, sf_dir, "orders"), "orders", _DISTINCT_COLS)


@register("dq_unique_groups", sql=_long_sql(
    "o AS (SELECT o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders), "
    "g AS (SELECT o_custkey, COUNT(DISTINCT date) AS d, COUNT(*) AS c FROM o GROUP BY 1), a AS (SELECT avg(CAST(d = c AS INTEGER)) AS s FROM g)",
    "orders", "'all'", [("unique_within(date by o_custkey)", "s", "1.0", None)]))
def q_dq_unique_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn(
        "date", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("date")))
    return Q.unique_groups(o, "orders", ["o_custkey"], "date")


@register("dq_key_unique", sql="\nUNION ALL\n".join([
    _long_sql("a AS (SELECT COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS d FROM orders)",
              "orders", "'all'", [("unique(o_orderkey)", "d", "n", None)]),
    "(" + _long_sql("a AS (SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT o_custkey, "
                    "CAST(o_orderdate AS DATE) FROM orders)) AS d FROM orders)",
                    "orders", "'all'", [("unique(o_custkey,date)", "d", "n", None)]) + ")",
    "(" + _long_sql("a AS (SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, "
                    "l_linenumber FROM lineitem)) AS d FROM lineitem)",
                    "lineitem", "'all'", [("unique(l_orderkey,l_linenumber)", "d", "n", None)]) + ")",
]))
def q_dq_key_unique(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    li = table(spark, sf_dir, "lineitem")
    return Q.key_unique(o, "orders", [["o_orderkey"], ["o_custkey", "date"]]).unionByName(
        Q.key_unique(li, "lineitem", ["l_orderkey", "l_linenumber"]))


@register("dq_unmatched", sql="\nUNION ALL\n".join([
    _long_sql("a AS (SELECT COUNT(*) AS m FROM documents d WHERE NOT EXISTS "
              "(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))",
              "documents", "'all'", [("unmatched(doc_id)", "m", "0.0", None)]),
    "(" + _long_sql("a AS (SELECT COUNT(*) AS m FROM labels l WHERE NOT EXISTS "
                    "(SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id))",
                    "labels", "'all'", [("unmatched(doc_id)", "m", "0.0", None)]) + ")",
]))
def q_dq_unmatched(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id")
    return Q.unmatched_both(d, lab, ["doc_id"], "documents", "labels")


_GAP_SQL = _long_sql(
    """d AS (SELECT year(l_shipdate) AS year, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS date,
                COUNT(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT *, datediff('day', lag(date) OVER (PARTITION BY year, l_returnflag, l_linestatus ORDER BY date),
                         date) AS gap FROM d),
a AS (SELECT year, SUM(n - 1) AS zeros, COUNT(gap) AS steps, SUM(gap) AS s,
             COUNT(*) FILTER (WHERE gap = 1) AS ones, MIN(gap) AS mn, MAX(gap) AS mx FROM g GROUP BY year)""",
    "lineitem", "CAST(year AS VARCHAR)",
    [("gap_mean", "CAST(COALESCE(s, 0) AS DOUBLE) / NULLIF(zeros + steps, 0)", "1.0", None),
     ("gap_share_1", "CAST(ones AS DOUBLE) / NULLIF(zeros + steps, 0)", "1.0", None),
     ("gap_min", "CASE WHEN zeros > 0 THEN 0 ELSE mn END", "1.0", None),
     ("gap_max", "COALESCE(mx, CASE WHEN zeros > 0 THEN 0 END)", "1.0", None),
     ("gap_count", "zeros + steps", "NULL", "NULL")])


@register("dq_gap_stats", sql=_GAP_SQL)
def q_dq_gap_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"), "l_returnflag", "l_linestatus",
        F.col("l_shipdate").cast("date").alias("date"))
    return Q.gap_stats(li, "lineitem", ["l_returnflag", "l_linestatus"], "date", ["year"])


_ACROSS_SQL = _long_sql(
    """d AS (SELECT year(o_orderdate) AS year, o_custkey, CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n FROM orders GROUP BY ALL),
g AS (SELECT *, datediff('day', lag(date) OVER (PARTITION BY year, o_custkey ORDER BY date), date) AS gap FROM d),
f AS (SELECT year, o_custkey, MIN(date) AS first, MAX(date) AS last FROM d GROUP BY ALL),
x AS (SELECT year, datediff('day', lag(last) OVER (PARTITION BY o_custkey ORDER BY first), first) AS step FROM f),
y AS (SELECT year, MAX(step) AS xma, MIN(step) AS xmi, COUNT(step) AS xn, avg(CAST(step = 1 AS INTEGER)) AS xs FROM x GROUP BY year),
a AS (SELECT year, xma, xmi, xn, xs, SUM(n - 1) AS zeros, COUNT(gap) AS steps, SUM(gap) AS s,
             COUNT(*) FILTER (WHERE gap = 1) AS ones, MIN(gap) AS mn, MAX(gap) AS mx FROM g JOIN y USING (year) GROUP BY ALL)""",
    "orders", "CAST(year AS VARCHAR)",
    [("gap_mean", "CAST(COALESCE(s, 0) AS DOUBLE) / NULLIF(zeros + steps, 0)", "1.0", None),
     ("gap_share_1", "CAST(ones AS DOUBLE) / NULLIF(zeros + steps, 0)", "1.0", None),
     ("gap_min", "CASE WHEN zeros > 0 THEN 0 ELSE mn END", "1.0", None),
     ("gap_max", "COALESCE(mx, CASE WHEN zeros > 0 THEN 0 END)", "1.0", None),
     ("gap_count", "zeros + steps", "NULL", "NULL"),
     ("gap_across_max", "xma", "1.0", None), ("gap_across_min", "xmi", "1.0", None),
     ("gap_across_share_1", "xs", "1.0", None), ("gap_across_count", "xn", "NULL", "NULL")])


@register("gap_across_years", sql=_ACROSS_SQL)
def q_gap_across_years(spark, sf_dir):
    """Days between a customer's orders, within each year and from one year's last to the next one's first."""
    o = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"), "o_custkey", F.col("o_orderdate").cast("date").alias("date"))
    return Q.gap_stats(o, "orders", ["o_custkey"], "date", ["year"], across=True)


@register("coverage_check", sql="""
WITH l AS (SELECT DISTINCT n_name AS name FROM nation),
     r AS (SELECT DISTINCT 'NATION_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS name FROM customer)
SELECT name, l.name IS NOT NULL AS in_left, r.name IS NOT NULL AS in_right
FROM l FULL OUTER JOIN r USING (name)
WHERE l.name IS NULL OR r.name IS NULL
""")
def q_coverage_check(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name")
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("NATION_"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("n_name"))
    return Q.coverage(n, c, "n_name")


# Part names as a second list with typing errors would have them: small parts lose a character, large
# ones get another one, and some names are in capitals.
_DAMAGED_SQL = """CASE WHEN p_size < 10 THEN substr(p_name, 1, 2) || substr(p_name, 4)
                      WHEN p_size > 40 THEN substr(p_name, 1, 4) || 'e' || substr(p_name, 5)
                      WHEN p_size = 25 THEN upper(p_name) ELSE p_name END"""


@register("spelling_proposals", sql=f"""
WITH l AS (SELECT {_DAMAGED_SQL} AS name, COUNT(*) AS n FROM part GROUP BY 1),
r AS (SELECT p_name AS name, COUNT(*) AS n FROM part GROUP BY 1),
alone AS (SELECT name, true AS in_left, n FROM l WHERE name NOT IN (SELECT name FROM r)
          UNION ALL SELECT name, false, n FROM r WHERE name NOT IN (SELECT name FROM l)),
other AS (SELECT name, true AS in_left, n FROM l UNION ALL SELECT name, false, n FROM r),
near AS (SELECT a.name, a.in_left, a.n AS n_rows, o.name AS proposal, o.n AS proposal_rows,
                CAST(levenshtein(lower(a.name), lower(o.name)) AS INTEGER) AS distance
         FROM alone a JOIN other o ON a.in_left <> o.in_left
         WHERE levenshtein(lower(a.name), lower(o.name)) <= least(2, length(a.name) // 3, length(o.name) // 3))
SELECT *, distance = min(distance) OVER (PARTITION BY name, in_left) AS best FROM near
""")
def q_spelling_proposals(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_name").isNotNull())
    return propose_spellings(p.select(F.expr(_DAMAGED_SQL).alias("name")), p.select(F.col("p_name").alias("name")), "name")


_SUITE_SQL = _long_sql(
    "a AS (SELECT year(o_orderdate) AS year, COUNT(*) AS n, "
    + ", ".join(f"COUNT({c}) AS nn_{c}" for c in ORDERS_COLS)
    + ", COUNT(*) FILTER (WHERE o_totalprice >= 0) AS ok_price"
    + ", avg(CAST(o_orderstatus IN ('F', 'O', 'P') AS INTEGER)) AS s_status"
    + ", COUNT(DISTINCT o_orderpriority) AS d_prio, COUNT(o_orderpriority) AS dn_prio"
    + " FROM orders GROUP BY 1)",
    "orders", "CAST(year AS VARCHAR)",
    [(f"not_null({c})", f"nn_{c}", "n", None) for c in ORDERS_COLS]
    + [("non_negative(o_totalprice)", "ok_price", "n", None),
       ("share_valid(known_status)", "s_status", "1.0", None),
       ("distinct(o_orderpriority)", "d_prio", "dn_prio", "NULL")])


@register("dq_suite", sql=_SUITE_SQL)
def q_dq_suite(spark, sf_dir):
    """All check families of the orders table, per year."""
    return Q.suite(_orders_with_year(spark, sf_dir), "orders", ["year"], not_null=ORDERS_COLS,
                   non_negative=["o_totalprice"],
                   rules={"known_status": F.col("o_orderstatus").isin("F", "O", "P")},
                   distinct=["o_orderpriority"])


_STATUSES = ["F", "O", "P"]


@register("dq_on_write", sql=_long_sql(
    "a AS (SELECT o_orderstatus AS s, COUNT(*) AS n, "
    + ", ".join(f"COUNT({c}) AS nn_{c}" for c in ORDERS_COLS)
    + ", COUNT(*) FILTER (WHERE o_totalprice >= 0) AS ok_price, avg(CAST(o_totalprice < 200000 AS INTEGER)) AS s_low"
    + " FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1)",
    "orders", "s", [(f"not_null({c})", f"nn_{c}", "n", None) for c in ORDERS_COLS]
    + [("non_negative(o_totalprice)", "ok_price", "n", None), ("share_valid(low_price)", "s_low", "1.0", None)])
    + """
UNION ALL SELECT 'orders', 'all', 'listed_groups', CAST(COUNT(*) FILTER (WHERE o_orderstatus IN ('F', 'O', 'P')) AS DOUBLE),
                 CAST(COUNT(*) AS DOUBLE), COUNT(*) FILTER (WHERE o_orderstatus IN ('F', 'O', 'P')) = COUNT(*) FROM orders""")
def q_dq_on_write(spark, sf_dir):
    """The checks of the orders table, by status, counted while it is written as Parquet."""
    orders = table(spark, sf_dir, "orders").select(*ORDERS_COLS)
    checks = Q.WriteChecks("orders", ORDERS_COLS, ["o_totalprice"], {"low_price": F.col("o_totalprice") < 200000},
                           "o_orderstatus", _STATUSES)
    checks.watch(orders).write.parquet(scratch_path(spark, "observed"))
    return checks.report(spark)


_SKETCHED = ["o_custkey", "o_orderstatus", "o_totalprice"]


@register("distinct_sketches", sql="\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", COUNT({c}) AS n_known, CAST(COUNT(*) AS BIGINT) AS n_rows, COUNT(DISTINCT {c}) AS n_exact, "
    "true AS close FROM orders" for c in _SKETCHED))
def q_distinct_sketches(spark, sf_dir):
    """Sketches stored year by year and merged, next to the exact distinct counts: close within 5 %."""
    path = scratch_path(spark, "sketches")
    o = _orders_with_year(spark, sf_dir)
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("date")
    for part in (o.where(early), o.where(~early)):
        write_parts(part_sketches(part, "year", _SKETCHED), path, "year")
    merged = merged_counts(spark.read.parquet(path))
    exact = Q.distinct_counts(o, "orders", _SKETCHED).select(
        F.regexp_extract("check", r"\((.*)\)", 1).alias("column"), F.col("observed").cast("long").alias("n_exact"))
    close = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 0.05 * F.col("n_exact")
    return merged.join(exact, "column").select("column", "n_known", "n_rows", "n_exact", close.alias("close"))
