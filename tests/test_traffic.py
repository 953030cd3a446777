"""End-to-end: made-up source files in the source layouts -> seven tables -> model outputs."""

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from panelspark import traffic as T
from panelspark.session import scratch_path

NBSP = "\u00a0"
BOM = "\ufeff"


def _w(path, text):
    p = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def _hours(v):
    return ",".join(str(v) for _ in range(24))


def _write_sources(base):
    hdr = "station_id,dir_of_travel,lane_of_travel,date," + ",".join(str(i) for i in range(1, 25)) + "\r\n"
    # 2018 and 2019: Mondays of ISO week 10; 2020: two Mondays; 2021 uses M/d/yyyy.
    _w(f"{base}/wim/2018_wim_atr_volume.csv", hdr + f"1,1,1,2018-03-05,{_hours(10)}\r\n4,1,1,2018-03-05,{_hours(5)}\r\n")
    _w(f"{base}/wim/2019_wim_atr_volume.csv", hdr + f"1,1,1,2019-03-04,{_hours(20)}\r\n4,1,1,2019-03-04,{_hours(5)}\r\n")
    days2020 = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(90)]
    rows = "".join(f"1,1,1,{d.isoformat()},{_hours(5)}\r\n1,5,1,{d.isoformat()},{_hours(5)}\r\n" for d in days2020)
    _w(f"{base}/wim/2020_wim_atr_volume.csv", hdr + rows + f"9,1,1,2020-03-02,{_hours(1)}\r\n")
    _w(f"{base}/wim/2021_wim_atr_volume.csv", hdr + f"1,1,1,3/1/2021,{_hours(7)}\r\n")
    _w(f"{base}/current.csv", BOM + "Continuous Number,Sequence Number,Collection Type,Route,Pos Dir Dir,"
       "Pos Lanes,Neg Lanes,Urban/Rural,Functional Class,County Name,Location Text\r\n"
       "1,1,ATR,I-35,N,2,2,Urban,1,St. Louis,\"Near Duluth, MN\"\r\n")
    _w(f"{base}/retired.csv", "Continuous Number,Collection Type,Measurement,Route,Pos Lanes,Pos Dir Dir,Ref Post,"
       "True Mile,Location,County,Closest City,Status\r\n"
       f"4,ATR,Vol,US-52,2,N,1,1.5,x,Olmsted{NBSP},Rochester,2012\r\n"
       "4,ATR,Vol,US-52,2,N,1,1.5,x,Wrongplace,Nowhere,2016\r\n"
       "1,ATR,Vol,I-35,2,N,1,1.5,x,Hennepin,Minneapolis,2010\r\n")
    _w(f"{base}/districts.csv", BOM + "County,MnDOT district(s)\r\nSt. Louis,1\r\n"
       f"Olmsted{NBSP},6\r\nCass,2{NBSP}and{NBSP}3\r\n")
    cases_hdr = "date,county,state,fips,cases,deaths\r\n"
    _w(f"{base}/counties/us-counties-2020.csv", cases_hdr + "2020-03-02,St Louis,Minnesota,27137,5,0\r\n"
       "2020-03-02,Olmsted,Minnesota,27109,3,1\r\n2020-03-02,San Juan,Puerto Rico,72127,9,\r\n"
       "2020-03-02,Unknown,Minnesota,,1,0\r\n2020-03-02,King,Washington,53033,7,2\r\n")
    _w(f"{base}/counties/us-counties-2021.csv", cases_hdr + "2021-03-01,Saint Louis,Minnesota,27137,50,2\r\n")
    _w(f"{base}/us-states.csv", "date,state,fips,cases,deaths\r\n" + "".join(
        f"{d.isoformat()},Minnesota,27,{i},{i // 10}\r\n" for i, d in enumerate(days2020)))
    _w(f"{base}/us.csv", "date,cases,deaths\r\n2020-03-02,100,2\r\n")
    _w(f"{base}/timeline.csv", BOM + "Date,Category,Order Type,Event Type,Description\r\n"
       "2020-02-15,Schools,Restriction,Effective,\"Schools closed, statewide\"\r\n"
       "2020-03-01,Vaccination,Relaxation,Effective,Shots\r\n2020-03-05,Business,Relaxation,Effective,Reopen\r\n")


def test_prepare_write_read_model(spark):
    base = scratch_path(spark, "traffic")
    _write_sources(base)
    paths = T.SourcePaths(
        hourly_volume=f"{base}/wim", current_stations=f"{base}/current.csv",
        retired_stations=f"{base}/retired.csv", county_districts=f"{base}/districts.csv",
        county_cases=f"{base}/counties", state_cases=f"{base}/us-states.csv",
        national_cases=f"{base}/us.csv", timeline=f"{base}/timeline.csv")
    tables = T.prepare(T.load_sources(spark, paths))

    cv = tables["county_volume"]
    assert cv.select("station_id").distinct().count() == 2          # station 9 has no dimension row
    dims = {(r.station_id, r.county, r.district) for r in cv.select("station_id", "county", "district").distinct().collect()}
    assert dims == {(1, "Saint Louis", "1"), (4, "Olmsted", "6")}
    d = {r.date: r.total_volume for r in cv.where("station_id = 1").collect()}
    assert d[dt.date(2020, 3, 2)] == 240 and d[dt.date(2021, 3, 1)] == 168 and d[dt.date(2019, 3, 4)] == 480

    cc = {(r.county, r.district) for r in tables["county_cases"].collect()}
    assert cc == {("Saint Louis", "1"), ("Olmsted", "6")}
    avg = {r.date: r.cases for r in tables["average_county_cases"].collect()}
    assert avg[dt.date(2020, 3, 2)] == 5.0                          # (5 + 3 + 7) / 3, PR and Unknown dropped

    names = {k: f"ps_t_{k}_{uuid.uuid4().hex[:6]}" for k in T.TABLE_NAMES}
    seen = {(r.table, r.check): r.observed for r in T.write_outputs(tables, names, {k: scratch_path(spark, k) for k in names}).collect()}
    assert {t for t, _ in seen} == set(names) and all(
        seen[k, "not_null(date)"] == T.read_table(spark, names[k]).count() for k in ("county_volume", "county_cases"))
    back = T.read_outputs(spark, names)
    assert back["county_volume"].where(F.col("year") == 2020).count() == 90

    out = T.model(spark, back, ["2020-02-15", "2020-03-18"], n_base_dates=1, seed="s")
    st = {r.date: r for r in out["state_share"].collect()}
    # 2020-03-02 (Mon, ISO week 10): 240 + 240(station 4 absent) -> baseline mean of 2018 (360) and 2019 (600)
    assert st[dt.date(2020, 3, 2)].baseline == 480.0 and st[dt.date(2020, 3, 2)].share == 0.5
    assert out["restrictions"].first().day_number == 46
    assert out["relaxations"].count() == 1
    w = out["covid_windows"]
    assert w.where("split = 'train' and event_date = date'2020-02-15'").count() == 30
    assert w.where("split = 'test' and event_date = date'2020-02-15'").count() == 10
    assert out["covid_forecast"].where("event_date = date'2020-02-15'").count() == 40
    kinds = {r.kind for r in out["covid_rmse_summary"].collect()}
    assert kinds == {"event", "mean", "pooled"}
    assert out["chart_district"].select("measure").distinct().count() == 3


def _schema(df):
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def test_intermediate_schemas(spark):
    """Output schemas of the prepared tables and model outputs (FIXTURES intermediate schemas)."""
    base = scratch_path(spark, "traffic-schema")
    _write_sources(base)
    paths = T.SourcePaths(
        hourly_volume=f"{base}/wim", current_stations=f"{base}/current.csv",
        retired_stations=f"{base}/retired.csv", county_districts=f"{base}/districts.csv",
        county_cases=f"{base}/counties", state_cases=f"{base}/us-states.csv",
        national_cases=f"{base}/us.csv", timeline=f"{base}/timeline.csv")
    tables = T.prepare(T.load_sources(spark, paths))
    assert _schema(tables["county_volume"]) == [
        ("county", "string"), ("district", "string"), ("station_id", "int"), ("date", "date"), ("total_volume", "bigint")]
    assert _schema(tables["state_volume"]) == [("date", "date"), ("total_volume", "bigint")]
    assert _schema(tables["county_cases"]) == [
        ("date", "date"), ("county", "string"), ("state", "string"), ("cases", "int"), ("deaths", "int"),
        ("district", "string")]
    assert _schema(tables["average_county_cases"]) == [("date", "date"), ("cases", "double"), ("deaths", "double")]
    out = T.model(spark, tables, ["2020-02-15"], n_base_dates=1)
    assert _schema(out["state_share"]) == [("date", "date"), ("total_volume", "bigint"), ("baseline", "double"),
                                           ("share", "double"), ("pct_diff", "double")]
    assert _schema(out["covid_windows"]) == [("event_date", "date"), ("split", "string"), ("ds", "date"), ("y", "double")]
    assert _schema(out["covid_forecast"]) == [("event_date", "date"), ("ds", "date"), ("yhat", "double"),
                                              ("yhat_lower", "double"), ("yhat_upper", "double")]
    # every null audit of the source's outputs: no null keys after the inner join
    assert tables["county_volume"].where("county is null or district is null or station_id is null").count() == 0


def test_cli_prepare_then_model(spark):
    base = scratch_path(spark, "traffic-cli")
    _write_sources(base)
    T.main(["prepare", "--hourly-volume", f"{base}/wim", "--current-stations", f"{base}/current.csv",
            "--retired-stations", f"{base}/retired.csv", "--county-districts", f"{base}/districts.csv",
            "--county-cases", f"{base}/counties", "--state-cases", f"{base}/us-states.csv",
            "--national-cases", f"{base}/us.csv", "--timeline", f"{base}/timeline.csv",
            "--table-root", f"{base}/tables"])
    assert spark.table(T.TABLE_NAMES["county_volume"]).count() == 95      # station 1: 93 days, station 4: 2
    out = T.model(spark, T.read_outputs(spark), ["2020-02-15"], n_base_dates=1)
    assert out["covid_windows"].count() == 40


def _sources(spark, name):
    base = scratch_path(spark, name)
    _write_sources(base)
    return T.load_sources(spark, T.SourcePaths(
        hourly_volume=f"{base}/wim", current_stations=f"{base}/current.csv",
        retired_stations=f"{base}/retired.csv", county_districts=f"{base}/districts.csv",
        county_cases=f"{base}/counties", state_cases=f"{base}/us-states.csv",
        national_cases=f"{base}/us.csv", timeline=f"{base}/timeline.csv"))


def test_quality_and_coverage_reports(spark):
    src = _sources(spark, "traffic-dq")
    rep = {(r.table, r.group, r.check): (r.observed, r.expected, r.passed) for r in T.quality_report(src).collect()}
    assert rep[("county_cases", "2020", "not_null(deaths)")] == (4.0, 5.0, False)       # Puerto Rico
    assert rep[("county_cases", "2020", "share_valid(deaths_le_cases)")] == (1.0, 1.0, True)
    assert rep[("hourly_volume", "2020", "unique(station_id,dir_of_travel,lane_of_travel,date)")][2] is True
    assert rep[("hourly_volume", "2020", "gap_share_1")] == (1.0, 1.0, True)
    assert rep[("hourly_volume", "2020", "unmatched(station_id)")] == (1.0, 0.0, False)    # station 9
    assert rep[("hourly_volume", "2019", "unmatched(station_id)")] == (0.0, 0.0, True)
    assert rep[("county_cases", "2020", "unique_within(date by county,state)")] == (1.0, 1.0, True)
    assert rep[("state_cases", "all", "gap_mean")] == (1.0, 1.0, True)
    assert rep[("current_stations", "all", "unique(continuous_number)")][2] is True
    cov = {(r.comparison, r.name, r.in_left, r.in_right) for r in T.coverage_report(src).collect()}
    assert ("stations~cases", "Hennepin", True, False) in cov and ("cases~districts", "Saint Louis", True, True) not in cov
    split = T.urban_rural_split(src).first()
    assert (split.Rural, split.Urban) == (0, 1)
