"""Plan properties that matter at scale, checked on the executed plans of the keys."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
WRITES = {"scan_csv", "scan_family", "table_roundtrip", "family_layouts", "scan_quarantine", "published_set"}
FORBIDDEN = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"]


def _plan(spark, key):
    return E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


def _scans(plan, table):
    return len(re.findall(rf"/{table}\.parquet\]", plan))


def test_no_nested_loop_cartesian_or_python(spark):
    for key in E.queries():
        if key in WRITES:
            continue
        plan = _plan(spark, key)
        bad = [f for f in FORBIDDEN if f in plan]
        assert not bad, (key, bad)


@pytest.mark.parametrize("key", ["share_of_baseline", "share_by_district", "share_base_year",
                                 "gap_fill_last", "gap_fill_mean", "event_axis", "dq_profile", "dq_unmatched",
                                 "station_dim"])
def test_single_scan_per_table(spark, key):
    plan = _plan(spark, key)
    tables = set(re.findall(r"/(\w+)\.parquet\]", plan)) - {"nation", "region"}
    assert tables and all(_scans(plan, t) == 1 for t in tables), (key, {t: _scans(plan, t) for t in tables})


@pytest.mark.parametrize("key", ["event_windows", "forecast_seasonal", "forecast_rmse", "join_left_multi"])
def test_checkpointed_keys_read_no_source_in_final_plan(spark, key):
    # Their small derived input was materialised once (one scan) into the checkpoint folder.
    assert not re.findall(r"/(\w+)\.parquet\]", _plan(spark, key))


def test_flagship_pushes_date_ranges_and_prunes_columns(spark):
    plan = _plan(spark, "share_of_baseline")
    # Baseline 1995-97 and compared 1998- touch: one range reaches the scan.
    assert re.search(r"PushedFilters: \[IsNotNull\(o_orderdate\), GreaterThanOrEqual\(o_orderdate,1995-01-01", plan)
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    assert "partial_sum" in plan and "SortMergeJoin" not in plan


def test_disjoint_year_ranges_reach_scan_as_or(spark):
    from pyspark.sql import functions as F

    from panelspark.operators.baseline import share_of_baseline
    daily = (spark.read.parquet(f"{SF}/orders.parquet")
             .groupBy(F.col("o_orderdate").cast("date").alias("date"))
             .agg(F.sum("o_totalprice").alias("total_volume")))
    out = share_of_baseline(daily, baseline_years=(1993, 1994), compare_years=(1996, 1997))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*Or\(And\(GreaterThanOrEqual\(o_orderdate,1993", plan)
    got = out.agg(F.min("date"), F.max("date")).first()
    assert str(got[0]) >= "1996-01-01" and str(got[1]) < "1998-01-01"


def test_range_filter_reaches_scan(spark):
    plan = _plan(spark, "filter_range")
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in plan and "LessThan(o_orderdate," in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_projection_prunes_columns(spark):
    plan = _plan(spark, "project")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


def test_first_per_key_combines_map_side(spark):
    plan = _plan(spark, "first_per_key")
    assert "partial_min" in plan and "Window" not in plan
