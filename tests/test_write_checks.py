"""Counters taken during a write against those of a scan of the same rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from panelspark.operators import quality as Q
from panelspark.session import scratch_path
from panelspark.sources.io import drop_table, read_table, write_table

def rules():
    return {"small": F.col("v") < 5}


def frame(spark, n=200):
    g = F.when(F.col("id") % 5 == 4, F.lit(None)).otherwise((F.col("id") % 5).cast("int"))
    return spark.range(n).select(g.alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 11 - 3).alias("v"), F.col("id").alias("w"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("parts", [None, ["g"]])
def test_counters_equal_those_of_a_scan(spark, parts):
    name = f"t_{uuid.uuid4().hex[:8]}"
    checks = Q.WriteChecks("t", ["g", "v"], ["v", "w"], rules())
    write_table(frame(spark), name, partition_by=parts, path=scratch_path(spark, "t"), watch=checks.watch)
    written = read_table(spark, name)
    assert written.count() == 200
    assert rows(checks.report(spark)) == rows(Q.suite(written, "t", [], ["g", "v"], ["v", "w"], rules()))
    drop_table(spark, name)


def test_counters_by_listed_groups_and_rows_outside_them(spark):
    df = frame(spark)
    checks = Q.WriteChecks("t", ["v"], ["v"], rules(), "g", [0, 1, 2, None, 77])
    checks.watch(df).write.parquet(scratch_path(spark, "g"))
    got = rows(checks.report(spark))
    want = rows(Q.suite(df.where("g is null or g < 3"), "t", ["g"], ["v"], ["v"], rules()))
    assert [r for r in got if r[2] != "listed_groups"] == want
    assert [r for r in got if r[2] == "listed_groups"] == [("t", "all", "listed_groups", 160.0, 200.0, False)]


def test_an_empty_table_has_counters_of_zero(spark):
    df = spark.createDataFrame([], "g int, v long, w long")
    checks = Q.WriteChecks("t", ["v"], ["v"], rules())
    checks.watch(df).write.parquet(scratch_path(spark, "none"))
    assert rows(checks.report(spark)) == rows(Q.suite(df, "t", [], ["v"], ["v"], rules()))


def test_groups_need_their_column():
    with pytest.raises(ValueError):
        Q.WriteChecks("t", groups=[1])
