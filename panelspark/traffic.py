"""The analysed application's two stages as library calls.

``load_sources`` reads the raw files (yearly families as one scan each), ``prepare`` builds
the seven output tables, ``write_outputs`` / ``read_outputs`` move them through managed
Parquet tables, and ``model`` derives the share-of-baseline series, the event timeline,
train/test windows, forecasts, scores and chart tables.  Every step is lazy; only the
sinks (and the checkpoint of the small window table) run jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from panelspark.functions.dates import parse_mixed_dates
from panelspark.functions.text import (
    COUNTY_CORRECTIONS,
    COUNTY_PREFIX_RULES,
    DISTRICT_OVERRIDES,
    SAINT_LOUIS_PATTERN,
    apply_corrections,
    clean_text,
    override,
    regex_conform,
)
from panelspark.operators import quality as Q
from panelspark.operators.baseline import share_of_baseline
from panelspark.operators.charts import forecast_lines, markers, panels
from panelspark.operators.dims import attach, merge_dimension
from panelspark.operators.evaluate import rmse_summary
from panelspark.operators.events import align, event_axis, event_windows, sample_events, select_events
from panelspark.operators.forecast import fit_forecast, forecast_scores, interval_coverage
from panelspark.operators.panel import daily_from_total, fill_last, fill_mean
from panelspark.operators.relational import pivot_count
from panelspark.operators.rollup import hours_to_daily
from panelspark.operators.spelling import propose_spellings
from panelspark.session import ensure_checkpoint_dir
from panelspark.sources import schemas as S
from panelspark.sources.intake import Intake, scan_intake
from panelspark.sources.io import read_table, write_table
from panelspark.sources.versions import publish, read_published

# The output table names of the analysed application, the state it
# studies, the rows it drops, and its modelling constants.
TABLE_NAMES = {
    "county_volume": "county_wim_2017_2022",
    "state_volume": "state_wim_2017_2022",
    "county_cases": "mn_county_covid_2020_2022",
    "average_county_cases": "average_county_covid_2020_2022",
    "national_cases": "total_us_covid_2020_2022",
    "state_cases": "total_state_covid_2020_2022",
    "timeline": "mn_covid_timeline",
}
STATE = "Minnesota"
EXCLUDED_STATE = "Puerto Rico"
UNKNOWN_COUNTY = "Unknown"
EXCLUDED_CATEGORY = "Vaccination"
BASELINE_YEARS = (2017, 2019)
COMPARE_YEARS = (2020, None)
BASE_TEST_BASELINE_YEARS = (2017, 2018)
BASE_TEST_YEAR = 2019
ALIGN_UNTIL = "2022-01-01"
DAY_ORIGIN = "2020-01-01"
TRAIN_LENGTH, TEST_LENGTH = 30, 10
URBAN_RURAL = ["Rural", "Urban"]


@dataclass
class SourcePaths:
    hourly_volume: str | Sequence[str]
    current_stations: str
    retired_stations: str
    county_districts: str
    county_cases: str | Sequence[str]
    state_cases: str
    national_cases: str
    timeline: str


FAMILIES = ("hourly_volume", "county_cases")
DATED = ("hourly_volume", "county_cases", "state_cases", "national_cases", "timeline")


def load_intake(spark: SparkSession, paths: SourcePaths, unknown: str = "raise") -> dict[str, Intake]:
    """Every source bound by its files' headers, bad rows kept apart (one look at first lines each)."""
    return {name: scan_intake(spark, getattr(paths, name), S.ALL["event_timeline" if name == "timeline" else name],
                              S.HEADER_ALIASES.get(name), unknown, dates={"date": parse_mixed_dates} if name in DATED else None,
                              year_col="year" if name in FAMILIES else None)
            for name in SourcePaths.__dataclass_fields__}


def sources_of(intake: Mapping[str, Intake]) -> dict[str, DataFrame]:
    """The good rows of every source with dates parsed (both layouts)."""
    return {name: i.good().withColumn("date", parse_mixed_dates("date")) if name in DATED else i.good()
            for name, i in intake.items()}


def load_sources(spark: SparkSession, paths: SourcePaths) -> dict[str, DataFrame]:
    """Raw sources with dates parsed at the edge: columns bound by header, without quarantined rows."""
    return sources_of(load_intake(spark, paths))


def quarantine_table(intake: Mapping[str, Intake]) -> DataFrame:
    """(table, file, reason, record) of every row that no source uses."""
    return reduce(DataFrame.unionByName, [i.quarantine(name) for name, i in intake.items()])


def quality_report(src: Mapping[str, DataFrame], intake: Mapping[str, Intake] | None = None) -> DataFrame:
    """The source checks of the preparation stage as one long report (table, group, check,
    observed, expected, passed): completeness, sign, deaths <= cases, key uniqueness,
    unique dates per entity and time-step continuity for every source -- per year for the
    yearly families, with the gaps over the year ends -- plus volume stations missing from both station lists and, with ``intake``, the
    quarantined rows of every file.

    Each source is read by its ``suite`` (one aggregation over every counter, one per exact
    distinct count or key, of its own columns only) and by its continuity pipeline
    (``gap_stats``), which also yields the unique-days share and, for the volume data, the
    stations missing from both lists.
    """
    cases_rule = {"deaths_le_cases": F.col("deaths") <= F.col("cases")}
    counts = ["cases", "deaths"]
    nat, st, cc = src["national_cases"], src["state_cases"], src["county_cases"]
    hv = src["hourly_volume"]
    hv_cols = [c for c in hv.columns if c != "year"]
    hv_keys = ["station_id", "dir_of_travel", "lane_of_travel"]
    cur, ret, cd = src["current_stations"], src["retired_stations"], src["county_districts"]
    known = cur.select(F.col("continuous_number").alias("station_id")).unionByName(
        ret.select(F.col("continuous_number").alias("station_id")))
    parts = [
        Q.suite(nat, "national_cases", not_null=nat.columns, non_negative=counts, rules=cases_rule,
                unique=[["date"]]),
        Q.gap_stats(nat, "national_cases", [], "date"),
        Q.suite(st, "state_cases", not_null=st.columns, non_negative=counts, rules=cases_rule,
                distinct=["state"], unique=[["state", "date"]]),
        Q.gap_stats(st, "state_cases", ["state"], "date", unique_days=True),
        Q.suite(cc, "county_cases", ["year"], not_null=[c for c in cc.columns if c != "year"],
                non_negative=counts, rules=cases_rule, unique=[["county", "state", "date"]]),
        Q.gap_stats(cc, "county_cases", ["county", "state"], "date", ["year"], unique_days=True, across=True),
        # approx: an informational station count, sketched along with the counters.
        Q.suite(hv, "hourly_volume", ["year"], not_null=hv_cols, non_negative=[*hv_keys, *S.HOUR_COLUMNS],
                distinct=["station_id"], approx=True, unique=[[*hv_keys, "date"]]),
        Q.gap_stats(hv, "hourly_volume", hv_keys, "date", ["year"], listed_in=("station_id", known), across=True),
        Q.suite(cur, "current_stations", not_null=cur.columns, distinct=cur.columns,
                unique=[["continuous_number"]]),
        Q.suite(ret, "retired_stations", not_null=ret.columns, distinct=ret.columns),
        Q.suite(cd, "county_districts", not_null=cd.columns, distinct=cd.columns, unique=[["county"]]),
        *[i.report(name) for name, i in (intake or {}).items()],
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def coverage_report(src: Mapping[str, DataFrame]) -> DataFrame:
    """(comparison, name, in_left, in_right) for county names present on one side only:
    station lists vs the state's case counties, and case counties vs the district list.

    Each comparison is made twice: on the names as they come (``raw``), which shows every spelling
    that differs, and conformed as the preparation stage does, which shows what the rules miss."""
    return _compared(src, Q.coverage)


def spelling_report(src: Mapping[str, DataFrame]) -> DataFrame:
    """For the same comparisons, the other side's names that an unmatched name may be a misspelling of
    (``operators.spelling``): proposals for new entries of the correction table, or for review."""
    return _compared(src, propose_spellings)


def _compared(src: Mapping[str, DataFrame], compare) -> DataFrame:
    def conformed(c):
        return apply_corrections(regex_conform(c, SAINT_LOUIS_PATTERN, "Saint Louis"),
                                 COUNTY_CORRECTIONS, COUNTY_PREFIX_RULES)

    raw_districts = src["county_districts"].select("county")
    return (_county_pairs(src, F.col, raw_districts, " raw", compare)
            .unionByName(_county_pairs(src, conformed, county_district_table(src["county_districts"]), "", compare)))


def _county_pairs(src: Mapping[str, DataFrame], conform, districts: DataFrame, suffix: str, compare) -> DataFrame:
    stations = src["current_stations"].select(conform("county_name").alias("county")).unionByName(
        src["retired_stations"].select(conform("county").alias("county")))
    cases = (src["county_cases"].where((F.col("state") == STATE) & (F.col("county") != UNKNOWN_COUNTY))
             .select(conform("county").alias("county")))
    return (compare(stations, cases, "county").select(F.lit(f"stations~cases{suffix}").alias("comparison"), "*")
            .unionByName(compare(cases, districts.select("county"), "county")
                         .select(F.lit(f"cases~districts{suffix}").alias("comparison"), "*")))


def urban_rural_split(src: Mapping[str, DataFrame]) -> DataFrame:
    """One row: current stations per Urban/Rural class (values given, so no discovery pass)."""
    return pivot_count(src["current_stations"], "urban_rural", URBAN_RURAL)


def county_district_table(county_districts: DataFrame) -> DataFrame:
    """(county, district): names conformed, multi-district counties overridden."""
    c = county_districts.select(
        apply_corrections("county", COUNTY_CORRECTIONS, COUNTY_PREFIX_RULES).alias("county"),
        clean_text("district").alias("district"))
    return c.select("county", override("district", "county", DISTRICT_OVERRIDES).alias("district"))


def station_dimension(current: DataFrame, retired: DataFrame, county_district: DataFrame) -> DataFrame:
    """(station_id, county, district): current stations plus retired ids not current."""
    cur = current.select(F.col("continuous_number").alias("station_id"), F.col("county_name").alias("county"))
    ret = retired.select(F.col("continuous_number").alias("station_id"), "county", "status")
    dim = merge_dimension(cur, ret, "station_id", "status", "county")
    return attach(dim, county_district, "county", "left")


def state_volume_from(county_volume: DataFrame) -> DataFrame:
    return county_volume.groupBy("date").agg(F.sum("total_volume").alias("total_volume"))


def filled(df: DataFrame, how: str | None, entity_cols: Sequence[str], value_cols: Sequence[str], k: int) -> DataFrame:
    """``df`` with the missing days of its entities filled: by the ``last`` value, by the ``mean`` around
    the gap, or (None) left out."""
    if how is None:
        return df
    if how not in ("last", "mean"):
        raise ValueError(f"fill must be None, 'last' or 'mean', not {how!r}")
    full = (fill_last(df, entity_cols, value_cols) if how == "last"
            else fill_mean(df, entity_cols, value_cols, k=k))
    return full.drop("filled")


def prepare(src: Mapping[str, DataFrame], null_as_zero: bool = False, fill_volume: str | None = None,
            fill_cases: str | None = None, fill_k: int = 2) -> dict[str, DataFrame]:
    """The seven output tables of the preparation stage.

    ``fill_volume`` and ``fill_cases`` add the missing days of each station's volumes and of each
    county's and state's totals (see ``filled``); by default nothing is filled.
    """
    county_district = county_district_table(src["county_districts"])
    daily = hours_to_daily(src["hourly_volume"], ["station_id", "date"], null_as_zero=null_as_zero)
    daily = filled(daily, fill_volume, ["station_id"], ["total_volume"], fill_k)
    dim = station_dimension(src["current_stations"], src["retired_stations"], county_district)
    county_volume = daily.join(dim, "station_id", "inner").select(
        "county", "district", "station_id", "date", "total_volume")
    state_volume = state_volume_from(county_volume)

    cases = src["county_cases"].where(
        (F.col("state") != EXCLUDED_STATE) & (F.col("county") != UNKNOWN_COUNTY))
    state_counties = cases.where(F.col("state") == STATE).withColumn(
        "county", apply_corrections(regex_conform("county", SAINT_LOUIS_PATTERN, "Saint Louis"),
                                    COUNTY_CORRECTIONS, COUNTY_PREFIX_RULES))
    state_counties = filled(state_counties.select("county", "state", "date", "cases", "deaths"), fill_cases,
                            ["county", "state"], ["cases", "deaths"], fill_k)
    county_cases = attach(state_counties, county_district, "county", "left").select(
        "date", "county", "state", "cases", "deaths", "district")
    filled_states = src["state_cases"] if fill_cases is None else filled(
        src["state_cases"], fill_cases, ["state"], ["cases", "deaths"], fill_k).select(*src["state_cases"].columns)
    average = cases.groupBy("date").agg(F.avg("cases").alias("cases"), F.avg("deaths").alias("deaths"))
    return {
        "county_volume": county_volume,
        "state_volume": state_volume,
        "county_cases": county_cases,
        "average_county_cases": average,
        "national_cases": src["national_cases"],
        "state_cases": filled_states,
        "timeline": src["timeline"],
    }


def write_outputs(tables: Mapping[str, DataFrame], names: Mapping[str, str] = TABLE_NAMES,
                  paths: Mapping[str, str] | None = None) -> DataFrame:
    """Overwrite each output table; dated facts are partitioned by year for pruning.  Returns the
    completeness and sign checks of every table, counted during the writes.

    The county volume table is written first and the state table is then aggregated from
    the *written* table, so the hourly roll-up (the largest input) is computed once.
    """
    order, reports = sorted(tables, key=lambda k: (k != "county_volume", k)), []
    for key in order:
        df = tables[key]
        if key == "state_volume" and "county_volume" in tables:
            df = state_volume_from(read_table(tables[key].sparkSession, names["county_volume"])
                                   .drop("year"))
        part = None
        if "date" in df.columns and key in ("county_volume", "county_cases"):
            df = df.withColumn("year", F.year("date"))
            part = ["year"]
        numbers = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name != "year"]
        checks = Q.WriteChecks(key, not_null=[c for c in df.columns if c != "year"], non_negative=numbers)
        write_table(df, names[key], partition_by=part, path=(paths or {}).get(key), watch=checks.watch)
        reports.append(checks.report(df.sparkSession))
    return reduce(lambda a, b: a.unionByName(b), reports)


YEARLY = ("county_volume", "county_cases")


def publish_outputs(spark: SparkSession, tables: Mapping[str, DataFrame], root: str,
                    names: Mapping[str, str] = TABLE_NAMES) -> str:
    """Replace the output tables under ``root`` as one set: a reader (``read_published_outputs``) sees all
    old or all new ones, also if this run fails.  Returns the version."""
    order = sorted(tables, key=lambda k: (k != "county_volume", k))
    made = {}
    for key in order:
        df = tables[key]
        if key == "state_volume" and "county_volume" in tables:
            made[names[key]] = lambda staged: state_volume_from(staged(names["county_volume"]))
        else:
            made[names[key]] = df.withColumn("year", F.year("date")) if key in YEARLY else df
    return publish(spark, root, made, {names[k]: ["year"] for k in YEARLY if k in tables})


def read_published_outputs(spark: SparkSession, root: str, names: Mapping[str, str] = TABLE_NAMES,
                           version: str | None = None) -> dict[str, DataFrame]:
    found = read_published(spark, root, version)
    return {k: found[v] for k, v in names.items()}


def read_outputs(spark: SparkSession, names: Mapping[str, str] = TABLE_NAMES) -> dict[str, DataFrame]:
    return {k: read_table(spark, v) for k, v in names.items()}


def _dates_frame(spark: SparkSession, dates: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in dates], "event_date string").select(
        F.col("event_date").cast("date").alias("event_date"))


def model(spark: SparkSession, tables: Mapping[str, DataFrame], policy_dates: Sequence[str],
          n_base_dates: int = 4, seed: str = "0") -> dict[str, DataFrame]:
    """Share series, event timeline, windows, forecasts and error reports."""
    district_daily = tables["county_volume"].groupBy("date", "district").agg(
        F.sum("total_volume").alias("total_volume"))
    district_share = share_of_baseline(district_daily, "date", "total_volume", ["district"],
                                       BASELINE_YEARS, COMPARE_YEARS)
    state_share = share_of_baseline(tables["state_volume"], "date", "total_volume", (),
                                    BASELINE_YEARS, COMPARE_YEARS)
    base_share = share_of_baseline(tables["state_volume"], "date", "total_volume", (),
                                   BASE_TEST_BASELINE_YEARS, (BASE_TEST_YEAR, BASE_TEST_YEAR))

    tl = tables["timeline"]
    restrictions = event_axis(select_events(tl, "Restriction", "Effective"), "date", DAY_ORIGIN)
    relaxations = event_axis(select_events(tl, "Relaxation", "Effective", EXCLUDED_CATEGORY), "date", DAY_ORIGIN)

    state_cases = tables["state_cases"].where(F.col("state") == STATE).select("date", "cases", "deaths")
    aligned = align(state_share, state_cases, "date", ALIGN_UNTIL)

    # Daily counts next to the running totals that the sources give.
    totals = ["cases", "deaths"]
    daily_cases = {
        "county_daily_cases": daily_from_total(tables["county_cases"], ["county", "state"], totals),
        "state_daily_cases": daily_from_total(tables["state_cases"], ["state"], totals),
        "national_daily_cases": daily_from_total(tables["national_cases"], [], totals),
    }

    # Rows, not days, as in the source: days with cases but no traffic stay in the series
    # (null y, ignored by the fit).
    covid_series = aligned.select("date", F.col("share").alias("y"))
    base_series = base_share.select("date", F.col("share").alias("y"))
    covid_events = _dates_frame(spark, policy_dates)
    base_events = sample_events(base_series, "date", n_base_dates, seed,
                                f"{BASE_TEST_YEAR}-02-10", f"{BASE_TEST_YEAR}-11-20")

    out = {
        "district_share": district_share,
        "state_share": state_share,
        "base_share": base_share,
        "restrictions": restrictions,
        "relaxations": relaxations,
        "aligned": aligned,
        **daily_cases,
        "chart_state": panels(state_share, [], "date", ["total_volume", "baseline", "share"]),
        "chart_aligned": panels(aligned, [], "date", ["share", "cases", "deaths"]),
        "chart_district": panels(district_share, ["district"], "date", ["total_volume", "baseline", "share"]),
        "chart_markers": markers(restrictions.withColumn("kind", F.lit("Restriction")).unionByName(
            relaxations.withColumn("kind", F.lit("Relaxation"))), "date", "kind", DAY_ORIGIN),
    }
    for name, series, events in (("covid", covid_series, covid_events), ("base", base_series, base_events)):
        ensure_checkpoint_dir(spark)
        w = event_windows(series, events, "date", "y", TRAIN_LENGTH, TEST_LENGTH).checkpoint(eager=True)
        fc = fit_forecast(w, horizon=TEST_LENGTH, interval="prediction")
        scores = forecast_scores(w, horizon=TEST_LENGTH)
        out[f"{name}_windows"] = w
        out[f"{name}_forecast"] = fc
        out[f"{name}_rmse"] = scores
        out[f"{name}_rmse_summary"] = rmse_summary(scores)
        out[f"{name}_coverage"] = interval_coverage(w, horizon=TEST_LENGTH)
        out[f"chart_{name}_forecast"] = forecast_lines(w, fc)
    return out


def write_model(out: Mapping[str, DataFrame], prefix: str = "model_") -> None:
    """Write every model output as a table named ``prefix + key`` (overwrite)."""
    for key, df in out.items():
        write_table(df, f"{prefix}{key}")


def main(argv: Sequence[str] | None = None) -> None:
    import argparse

    from panelspark.session import get_session

    p = argparse.ArgumentParser(prog="python -m panelspark.traffic",
                                description="Prepare the seven tables from raw files, then model them.")
    sub = p.add_subparsers(dest="cmd", required=True)
    prep = sub.add_parser("prepare", help="raw files -> the seven output tables")
    for f in SourcePaths.__dataclass_fields__:
        prep.add_argument(f"--{f.replace('_', '-')}", required=True)
    prep.add_argument("--null-as-zero", action="store_true")
    prep.add_argument("--fill-volume", choices=["last", "mean"], help="add missing days of each station")
    prep.add_argument("--fill-cases", choices=["last", "mean"], help="add missing days of each county and state")
    prep.add_argument("--table-root", help="folder for the tables' files (default: the warehouse)")
    prep.add_argument("--publish-root", help="replace the tables in this folder as one set, instead of table by table")
    qual = sub.add_parser("quality", help="raw files -> data-quality and name-coverage report tables")
    for f in SourcePaths.__dataclass_fields__:
        qual.add_argument(f"--{f.replace('_', '-')}", required=True)
    qual.add_argument("--prefix", default="dq_")
    mod = sub.add_parser("model", help="output tables -> share, events, windows, forecasts, scores")
    mod.add_argument("--policy-dates", required=True, help="comma-separated yyyy-MM-dd")
    mod.add_argument("--publish-root", help="read the newest set of tables published in this folder")
    mod.add_argument("--base-dates", type=int, default=4)
    mod.add_argument("--seed", default="0")
    mod.add_argument("--prefix", default="model_")
    args = p.parse_args(argv)

    spark = get_session()
    if args.cmd == "quality":
        paths = SourcePaths(**{f: getattr(args, f) for f in SourcePaths.__dataclass_fields__})
        intake = load_intake(spark, paths, unknown="skip")
        src = sources_of(intake)
        write_table(quality_report(src, intake), f"{args.prefix}report")
        write_table(quarantine_table(intake), f"{args.prefix}quarantine")
        write_table(coverage_report(src), f"{args.prefix}coverage")
    elif args.cmd == "prepare":
        paths = SourcePaths(**{f: getattr(args, f) for f in SourcePaths.__dataclass_fields__})
        root = args.table_root.rstrip("/") if args.table_root else None
        table_paths = {k: f"{root}/{v}" for k, v in TABLE_NAMES.items()} if root else None
        tables = prepare(load_sources(spark, paths), args.null_as_zero, args.fill_volume, args.fill_cases)
        if args.publish_root:
            publish_outputs(spark, tables, args.publish_root)
        else:
            write_outputs(tables, paths=table_paths)
    else:
        tables = read_published_outputs(spark, args.publish_root) if args.publish_root else read_outputs(spark)
        out = model(spark, tables, args.policy_dates.split(","), args.base_dates, args.seed)
        write_model(out, args.prefix)


if __name__ == "__main__":
    main()
