"""SURVEY §2.12 decisions not already covered elsewhere.

Where the others are tested: D1 station dimension unique by id (test_fixtures_literal
::test_station_dimension, test_operators::test_merge_dimension_numeric_status_order);
D2 deterministic survivor (test_properties::test_first_per_key_nulls_first_and_ties);
D3 anti-join counts (test_operators::test_unique_groups_key_unique_unmatched); D4 parse
(test_fixtures_literal::test_parse_mixed_dates); D5 gap report (test_fixtures_literal
::test_gaps_and_fills); D9 day number (test_day_number); D10 ordered windows
(test_event_windows, test_bruteforce); D11 week 53 (test_operators::test_calendar_keys_week53,
test_share_of_baseline); D14 null_as_zero (test_hourly_to_daily); D15/D16 corrections and
U+00A0 (test_conform_names, test_district_override); D17 daily from totals
(test_daily_from_total); D18 both fills (test_gaps_and_fills); D19 seeded sample
(test_operators::test_sample_is_repeatable_and_partition_free); D20 event dates as data
(test_traffic); D21 mean and pooled RMSE (test_operators::test_rmse_summary_mean_and_pooled);
D22 include_event_day (test_operators::test_event_windows_multi_series_and_exclusive);
D23 pct_diff (test_fixtures_literal::test_share_of_baseline).
"""

import datetime as dt

from panelspark import traffic as T
from panelspark.operators import quality as Q
from panelspark.operators.panel import gaps
from panelspark.session import scratch_path

D = dt.date


def test_d6_county_gaps_keyed_by_county_and_state(spark):
    df = spark.createDataFrame([("Clay", "Minnesota", D(2020, 3, 1)), ("Clay", "Iowa", D(2020, 3, 2)),
                                ("Clay", "Minnesota", D(2020, 3, 2)), ("Clay", "Iowa", D(2020, 3, 3))],
                               "county string, state string, date date")
    g = [r.gap for r in gaps(df, ["county", "state"], "date").collect() if r.gap is not None]
    assert g == [1, 1]
    rep = {r.check: r.observed for r in Q.gap_stats(df, "t", ["county", "state"]).collect()}
    assert rep["gap_share_1"] == 1.0
    mixed = [r.gap for r in gaps(df, ["county"], "date").collect() if r.gap is not None]
    assert sorted(mixed) == [0, 1, 1]          # what partitioning by county alone would report


def test_d8_d12_state_filter_and_mixed_date_years(spark):
    from tests.test_traffic import _write_sources
    base = scratch_path(spark, "decisions")
    _write_sources(base)
    src = T.load_sources(spark, T.SourcePaths(
        hourly_volume=f"{base}/wim", current_stations=f"{base}/current.csv",
        retired_stations=f"{base}/retired.csv", county_districts=f"{base}/districts.csv",
        county_cases=f"{base}/counties", state_cases=f"{base}/us-states.csv",
        national_cases=f"{base}/us.csv", timeline=f"{base}/timeline.csv"))
    years = {r.year: r.n for r in src["hourly_volume"].groupBy("year").count().withColumnRenamed("count", "n").collect()}
    assert years == {2018: 2, 2019: 2, 2020: 181, 2021: 1}
    assert src["hourly_volume"].where("date is null").count() == 0      # both layouts parsed before use
    tables = T.prepare(src)
    assert {r.state for r in tables["county_cases"].select("state").distinct().collect()} == {"Minnesota"}


def test_d13_state_table_is_one_aggregation_of_the_written_county_table(spark):
    from tests.test_traffic import _write_sources
    base = scratch_path(spark, "decisions13")
    _write_sources(base)
    src = T.load_sources(spark, T.SourcePaths(
        hourly_volume=f"{base}/wim", current_stations=f"{base}/current.csv",
        retired_stations=f"{base}/retired.csv", county_districts=f"{base}/districts.csv",
        county_cases=f"{base}/counties", state_cases=f"{base}/us-states.csv",
        national_cases=f"{base}/us.csv", timeline=f"{base}/timeline.csv"))
    tables = T.prepare(src)
    names = {k: f"ps_d13_{k}" for k in T.TABLE_NAMES}
    T.write_outputs(tables, names, {k: scratch_path(spark, k) for k in names})
    state = {r.date: r.total_volume for r in spark.table(names["state_volume"]).collect()}
    county = spark.table(names["county_volume"]).groupBy("date").sum("total_volume").collect()
    assert state == {r[0]: r[1] for r in county}
