"""Published sets of tables: all old or all new, whatever fails."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelspark import traffic as T
from panelspark.session import scratch_path
from panelspark.sources.versions import publish, read_published, restore, versions


def _set(spark, v, fail=None):
    def table(name):
        df = spark.range(4).select(F.lit(v).alias("v"), (F.col("id") % 2).alias("year"))
        return df.withColumn("v", F.raise_error(F.lit("boom")).cast("int")) if name == fail else df

    return {n: table(n) for n in ("a", "b", "c")}


def seen(tables):
    return {n: sorted({r.v for r in df.collect()}) for n, df in tables.items()}


def test_a_failed_run_leaves_the_old_set_and_a_full_one_replaces_it(spark):
    root = scratch_path(spark, "set")
    with pytest.raises(LookupError):
        read_published(spark, root)
    first = publish(spark, root, _set(spark, 1), {"a": ["year"]})
    old = read_published(spark, root)
    assert seen(old) == {"a": [1], "b": [1], "c": [1]}
    for fail in ("a", "b", "c"):
        with pytest.raises(PySparkException, match="boom"):
            publish(spark, root, _set(spark, 2, fail))
        assert seen(read_published(spark, root)) == {"a": [1], "b": [1], "c": [1]}
    second = publish(spark, root, {k: v for k, v in _set(spark, 3).items() if k != "c"})
    assert seen(read_published(spark, root)) == {"a": [3], "b": [3]}
    assert seen(old) == {"a": [1], "b": [1], "c": [1]}             # readers of the old set are not disturbed
    assert seen(read_published(spark, root, first)) == seen(old)
    third = restore(spark, root, first)
    assert seen(read_published(spark, root)) == {"a": [1], "b": [1], "c": [1]}
    assert [r.version for r in versions(spark, root).select("version").distinct().orderBy("version").collect()] == [first, second, third]
    with pytest.raises(LookupError):
        read_published(spark, root, "none")


def test_later_tables_derive_from_staged_files(spark):
    root = scratch_path(spark, "derived")
    publish(spark, root, {"a": spark.range(10), "b": lambda staged: staged("a").agg(F.sum("id").alias("s"))})
    assert read_published(spark, root)["b"].first().s == 45


def test_outputs_of_the_application_are_one_set(spark):
    root = scratch_path(spark, "outputs")
    day = spark.sql("SELECT DATE'2020-03-01' AS date")
    tables = {k: day.withColumn("total_volume", F.lit(2)) for k in T.TABLE_NAMES}
    T.publish_outputs(spark, tables, root)
    bad = {**tables, "timeline": day.withColumn("x", F.raise_error(F.lit("boom")))}
    bad["county_volume"] = day.withColumn("total_volume", F.lit(9))
    with pytest.raises(PySparkException, match="boom"):
        T.publish_outputs(spark, bad, root)
    got = T.read_published_outputs(spark, root)
    assert set(got) == set(T.TABLE_NAMES)
    assert got["county_volume"].first().total_volume == 2 and got["county_volume"].first().year == 2020
    assert got["state_volume"].first().total_volume == 2
