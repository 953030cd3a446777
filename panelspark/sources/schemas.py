"""Fixed source schemas (all columns nullable, bound by position, snake_case names).

Dates are strings at the edge; :func:`panelspark.functions.parse_mixed_dates`
converts them.  The wide hourly record keeps its 24 hour columns ``h01`` .. ``h24``.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

HOUR_COLUMNS = [f"h{i:02d}" for i in range(1, 25)]


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


HOURLY_VOLUME = _schema(
    ("station_id", IntegerType()),
    ("dir_of_travel", IntegerType()),
    ("lane_of_travel", IntegerType()),
    ("date", StringType()),
    *[(h, IntegerType()) for h in HOUR_COLUMNS],
)

NATIONAL_CASES = _schema(("date", StringType()), ("cases", IntegerType()), ("deaths", IntegerType()))

STATE_CASES = _schema(
    ("date", StringType()), ("state", StringType()), ("fips", IntegerType()),
    ("cases", IntegerType()), ("deaths", IntegerType()),
)

COUNTY_CASES = _schema(
    ("date", StringType()), ("county", StringType()), ("state", StringType()),
    ("fips", IntegerType()), ("cases", IntegerType()), ("deaths", IntegerType()),
)

CURRENT_STATIONS = _schema(
    ("continuous_number", IntegerType()), ("sequence_number", IntegerType()),
    ("collection_type", StringType()), ("route", StringType()), ("pos_dir_dir", StringType()),
    ("pos_lanes", IntegerType()), ("neg_lanes", IntegerType()), ("urban_rural", StringType()),
    ("functional_class", StringType()), ("county_name", StringType()),
    ("location_text", StringType()),
)

RETIRED_STATIONS = _schema(
    ("continuous_number", IntegerType()), ("collection_type", StringType()),
    ("measurement", StringType()), ("route", StringType()), ("pos_lanes", IntegerType()),
    ("pos_dir_dir", StringType()), ("ref_post", StringType()), ("true_mile", FloatType()),
    ("location", StringType()), ("county", StringType()), ("closest_city", StringType()),
    ("status", StringType()),
)

COUNTY_DISTRICTS = _schema(("county", StringType()), ("district", StringType()))

EVENT_TIMELINE = _schema(
    ("date", StringType()), ("category", StringType()), ("order_type", StringType()),
    ("event_type", StringType()), ("description", StringType()),
)

ALL = {
    "hourly_volume": HOURLY_VOLUME,
    "national_cases": NATIONAL_CASES,
    "state_cases": STATE_CASES,
    "county_cases": COUNTY_CASES,
    "current_stations": CURRENT_STATIONS,
    "retired_stations": RETIRED_STATIONS,
    "county_districts": COUNTY_DISTRICTS,
    "event_timeline": EVENT_TIMELINE,
}

# Header names of the source files that differ from the column names above.
HEADER_ALIASES = {
    "hourly_volume": {h: [str(i)] for i, h in enumerate(HOUR_COLUMNS, 1)},
    "county_districts": {"district": ["MnDOT district(s)"]},
}
