"""Header binding and quarantine: layouts, unknown headers, rows in = rows good + rows set apart."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from panelspark import traffic as T
from panelspark.functions.dates import parse_mixed_dates
from panelspark.session import scratch_path
from panelspark.sources.intake import header_lines, layout_of, scan_intake
from panelspark.sources.schemas import COUNTY_DISTRICTS, HEADER_ALIASES, HOURLY_VOLUME
from tests.test_sources import _local, _write
from tests.test_traffic import _write_sources

CASES = StructType([StructField("county", StringType()), StructField("cases", IntegerType()), StructField("date", StringType())])


def test_columns_are_bound_by_header_whatever_their_order(spark):
    base = scratch_path(spark, "layouts")
    _write(f"{base}/c_2019.csv", "﻿County,Cases,Date\r\n\"Cass, N\",7,2019-01-02\r\n")
    _write(f"{base}/c_2020.csv", "cases,note,county,date\n8,x,B,1/2/2020\n")
    _write(f"{base}/deep/c_2021.csv", "\n\ndate;x,cases,county\n")
    _write(f"{base}/deep/empty_2022.csv", "\n \n")
    with pytest.raises(ValueError, match="deep/c_2021.csv.*missing: date"):
        scan_intake(spark, base, CASES)
    got = scan_intake(spark, base, CASES, unknown="skip", year_col="year")
    assert sorted(map(tuple, got.good().collect())) == [("B", 8, "1/2/2020", 2020), ("Cass, N", 7, "2019-01-02", 2019)]
    files = {r.path.rsplit("/", 1)[1]: (r.layout, r.problem) for r in got.files.collect()}
    assert files == {"c_2019.csv": (0, None), "c_2020.csv": (1, None), "c_2021.csv": (None, "missing: date"),
                     "empty_2022.csv": (None, "no header")}
    report = {r.group.rsplit("/", 1)[1]: (r.observed, r.passed) for r in got.report("t").collect()}
    assert report["c_2021.csv"] == (None, False) and report["c_2020.csv"] == (0.0, True)


def test_a_column_named_twice_and_aliases():
    assert layout_of("county,cases,County,date", CASES).twice == ("county",)
    assert layout_of("County,MnDOT district(s)", COUNTY_DISTRICTS, HEADER_ALIASES["county_districts"]).known
    hours = "station_id,dir_of_travel,lane_of_travel,date," + ",".join(map(str, range(1, 25)))
    assert layout_of(hours, HOURLY_VOLUME, HEADER_ALIASES["hourly_volume"]).columns == tuple(HOURLY_VOLUME.names)
    assert not layout_of(None, CASES).known


def test_first_lines_of_many_files_folders_with_spaces_and_gzip(spark):
    base = scratch_path(spark, "first lines")
    for i in range(40):
        _write(f"{base}/p{i % 3}/f{i}.csv", f"h{i},x\n" + "1,2\n" * (i * 10))
    with gzip.open(f"{_local(base)}/z.csv.gz", "wt") as f:
        f.write("county,cases,date\nZ,1,2020-01-01\n")
    got = {p.rsplit("/", 1)[1]: h for p, h in header_lines(spark, base)}
    assert got == {**{f"f{i}.csv": f"h{i},x" for i in range(40)}, "z.csv.gz": "county,cases,date"}
    rows = scan_intake(spark, base, CASES, unknown="skip").good().collect()
    assert [tuple(r) for r in rows] == [("Z", 1, "2020-01-01")]


def test_every_row_is_good_or_quarantined(spark):
    base = scratch_path(spark, "quarantine")
    _write(f"{base}/a_2019.csv", "county,cases,date\nA,1,2019-01-01\nB,many,2019-01-02\nC,3\nD,4,2019-01-04,5\nE,,\n")
    _write(f"{base}/b_2020.csv", "date,county,cases\n31/31/2020,A,1\n1/2/2020,B,2\n,C,99999999999\n")
    got = scan_intake(spark, base, CASES, dates={"date": parse_mixed_dates})
    assert sorted(r.county for r in got.good().collect()) == ["A", "B", "E"]
    bad = {(r.file[-10:], r.reason, r.record) for r in got.quarantine("cases").collect()}
    assert bad == {("a_2019.csv", "malformed", "B,many,2019-01-02"), ("a_2019.csv", "malformed", "C,3"),
                   ("a_2019.csv", "malformed", "D,4,2019-01-04,5"), ("b_2020.csv", "bad date", "A,1,31/31/2020"),
                   ("b_2020.csv", "malformed", ",C,99999999999")}
    counts = {r._file[-10:]: (r.rows_in, r.rows_good, r.rows_quarantined) for r in got.counts().collect()}
    assert counts == {"a_2019.csv": (5, 2, 3), "b_2020.csv": (3, 1, 2)}
    # The same rows are set apart when only some columns are asked for.
    assert got.good().select("county").count() == 3 and got.rows.select("cases").count() == 8
    assert got.rows.select(F.count("_reason")).first()[0] == 5


def test_sources_of_the_application_and_their_report(spark):
    base = scratch_path(spark, "traffic_intake")
    _write_sources(base)
    _write(f"{base}/counties/us-counties-2022.csv",
           "state,county,deaths,cases,date,fips\r\nMinnesota,Olmsted,4,90,2022-01-05,27109\r\nMinnesota,Olmsted,4,?,2022-01-06,27109\r\n")
    paths = T.SourcePaths(
        hourly_volume=f"{base}/wim", current_stations=f"{base}/current.csv", retired_stations=f"{base}/retired.csv",
        county_districts=f"{base}/districts.csv", county_cases=f"{base}/counties", state_cases=f"{base}/us-states.csv",
        national_cases=f"{base}/us.csv", timeline=f"{base}/timeline.csv")
    intake = T.load_intake(spark, paths)
    src = T.sources_of(intake)
    row = src["county_cases"].where("year = 2022").collect()
    assert [(r.county, r.state, r.cases, r.deaths, r.date.isoformat()) for r in row] == [("Olmsted", "Minnesota", 90, 4, "2022-01-05")]
    report = [r for r in T.quality_report(src, intake).collect() if r.check == "rows_quarantined"]
    assert len(report) == 4 + 3 + 6 and {(r.table, r.group[-8:]) for r in report if not r.passed} == {("county_cases", "2022.csv")}
    assert [(r.table, r.record) for r in T.quarantine_table(intake).collect()] == [
        ("county_cases", "Minnesota,Olmsted,4,?,2022-01-06,27109")]


def test_a_folder_without_usable_files_gives_no_rows(spark):
    base = scratch_path(spark, "nothing")
    _write(f"{base}/a.csv", "")
    got = scan_intake(spark, base, CASES, year_col="year")
    assert got.good().count() == 0 and got.quarantine("t").count() == 0
