"""CSV traits of the source files, yearly families, table sink and catalog."""

import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelspark.functions.dates import parse_mixed_dates
from panelspark.sources.io import list_catalog, read_csv, read_table, scan_family, union_all, write_table
from panelspark.sources.schemas import COUNTY_DISTRICTS, EVENT_TIMELINE, HOURLY_VOLUME
from panelspark.session import scratch_path


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def _write(path, text):
    os.makedirs(os.path.dirname(_local(path)), exist_ok=True)
    with open(_local(path), "wb") as f:
        f.write(text.encode("utf-8"))


def test_csv_bom_crlf_quotes_nbsp(spark):
    base = scratch_path(spark, "csv")
    text = ("\ufeffDate,Category,Order Type,Event Type,Description\r\n"
            "3/18/2020,Schools,Restriction,Effective,\"Schools closed, statewide\"\r\n"
            "2020-05-18,Business,Relaxation,Effective,Retail reopens\r\n")
    _write(f"{base}/timeline.csv", text)
    df = read_csv(spark, f"{base}/timeline.csv", EVENT_TIMELINE)
    rows = df.orderBy("category").collect()
    assert len(rows) == 2
    assert rows[1].description == "Schools closed, statewide"
    assert rows[1].event_type == "Effective"      # no stray \r at the line end
    dates = sorted(r.d for r in df.select(parse_mixed_dates("date").alias("d")).collect())
    assert [d.isoformat() for d in dates] == ["2020-03-18", "2020-05-18"]

    _write(f"{base}/counties.csv", "\ufeffCounty,MnDOT district(s)\r\nOlmsted ,6\r\nCass,2 and 3\r\n")
    c = read_csv(spark, f"{base}/counties.csv", COUNTY_DISTRICTS).collect()
    assert c[0].county == "Olmsted " and c[1].district == "2 and 3"


def test_scan_family_one_scan_year_from_path(spark):
    base = scratch_path(spark, "family")
    hours = ",".join(["1"] * 24)
    for year, date in [(2019, "2019-06-01"), (2021, "6/1/2021")]:
        _write(f"{base}/volume_{year}.csv", "header\n" + f"7,1,1,{date},{hours}\n")
    fam = scan_family(spark, base, HOURLY_VOLUME)
    rows = sorted((r.year, r.d.isoformat()) for r in fam.select("year", parse_mixed_dates("date").alias("d")).collect())
    assert rows == [(2019, "2019-06-01"), (2021, "2021-06-01")]


def test_table_sink_roundtrip_and_catalog(spark):
    name = f"ps_test_{uuid.uuid4().hex[:8]}"
    df = spark.range(10).withColumn("year", (F.col("id") % 2 + 2020).cast("int"))
    write_table(df, name, partition_by=["year"], path=scratch_path(spark, name))
    write_table(df, name, partition_by=["year"], path=scratch_path(spark, name))   # overwrite, no error
    assert read_table(spark, name).count() == 10
    assert read_table(spark, name).where("year = 2021").count() == 5
    assert name in [r.tableName for r in list_catalog(spark).collect()]


def test_union_seeded(spark):
    seed = spark.createDataFrame([], "a int, b string")
    u = union_all([spark.createDataFrame([(1, "x")], "a int, b string"),
                   spark.createDataFrame([("y", 2)], "b string, a int")], seed=seed)
    assert sorted(tuple(r) for r in u.collect()) == [(1, "x"), (2, "y")]


def test_headerless_csv_strips_bom(spark):
    base = scratch_path(spark, "nohdr")
    _write(f"{base}/c.csv", "\ufeffAnoka,Metro\r\nCass,3\r\n")
    rows = sorted(tuple(r) for r in read_csv(spark, f"{base}/c.csv", COUNTY_DISTRICTS, header=False).collect())
    assert rows == [("Anoka", "Metro"), ("Cass", "3")]


def test_scan_family_parquet(spark):
    base = scratch_path(spark, "pqfam")
    for year in (2020, 2021):
        spark.createDataFrame([(year, f"{year}-01-01")], "v int, date string") \
            .write.mode("overwrite").parquet(f"{base}/cases_{year}.parquet")
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType
    schema = StructType([StructField("v", IntegerType()), StructField("date", StringType())])
    fam = scan_family(spark, base, schema, fmt="parquet", year_pattern=r"cases_(\d{4})")
    assert sorted((r.year, r.v) for r in fam.collect()) == [(2020, 2020), (2021, 2021)]


def test_family_year_ignores_part_file_names(spark):
    """Folders that Spark wrote: the digits of part-file names are no years."""
    base = scratch_path(spark, "family_parts")
    schema = StructType([StructField("v", LongType())])
    for year in (2019, 2020):
        spark.range(5).select(F.lit(year).cast("bigint").alias("v")).write.option("header", "true").csv(
            f"{base}/us-counties-{year}")
    got = {(r.v, r.year) for r in scan_family(spark, base, schema, strict=True).collect()}
    assert got == {(2019, 2019), (2020, 2020)}


def test_family_file_without_year_is_null_or_stops(spark):
    base = scratch_path(spark, "family_none").replace("19", "xx").replace("20", "yy")
    schema = StructType([StructField("v", LongType())])
    spark.range(1).select(F.lit(1).cast("bigint").alias("v")).write.option("header", "true").csv(f"{base}/counts")
    assert [r.year for r in scan_family(spark, base, schema).collect()] == [None]
    with pytest.raises(Exception, match="no year in"):
        scan_family(spark, base, schema, strict=True).collect()
