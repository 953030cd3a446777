"""Date parsing and calendar keys.

Calendar semantics follow the source analysis: ``year`` is the calendar year,
``week`` the ISO week number and ``weekday`` Spark's ``dayofweek`` (Sunday = 1),
both zero-padded to two characters.  Around New Year these mix: 2020-12-28 ..
2021-01-03 are ISO week 53 of calendar years 2020 *and* 2021, a week the years
2017-2019 never have, so a baseline keyed on them is null there.  Pass
``week53_to_52=True`` to fold week 53 onto week 52 instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two date layouts that occur in the yearly source files
# (ISO dates up to 2020, US month/day/year from 2021).
DEFAULT_DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_mixed_dates(c: str | Column, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """Parse a string column whose rows use any of ``formats``; unparseable -> null.

    ``try_to_date`` keeps this safe under ANSI mode, where ``to_date`` raises.
    """
    c = _col(c)
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def iso_week(c: str | Column, week53_to_52: bool = False) -> Column:
    w = F.weekofyear(_col(c))
    if week53_to_52:
        w = F.when(w == 53, F.lit(52)).otherwise(w)
    return w


def calendar_keys(df: DataFrame, date_col: str = "date", week53_to_52: bool = False) -> DataFrame:
    """Add ``year`` (int), ``week`` ('01'..'53', ISO) and ``weekday`` ('01'..'07', Sunday = '01')."""
    d = F.col(date_col)
    return df.withColumns({
        "year": F.year(d),
        "week": F.format_string("%02d", iso_week(d, week53_to_52)),
        "weekday": F.format_string("%02d", F.dayofweek(d)),
    })


def day_number(c: str | Column, origin: str = "2020-01-01") -> Column:
    """Running day number with ``origin`` = day 1; continues across years (2021-01-01 -> 367)."""
    return F.datediff(_col(c), F.lit(origin).cast("date")) + F.lit(1)


def year_bounds(first_year: int, last_year: int | None) -> tuple[str, str | None]:
    """Inclusive year range -> half-open date bounds, so filters prune at the scan."""
    lo = f"{first_year:04d}-01-01"
    hi = None if last_year is None else f"{last_year + 1:04d}-01-01"
    return lo, hi


def between_dates(c: str | Column, lo: str | None, hi: str | None) -> Column:
    """``lo <= c < hi`` on a date column (either bound may be None)."""
    c = _col(c)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= F.lit(lo).cast("date"))
    if hi is not None:
        cond = cond & (c < F.lit(hi).cast("date"))
    return cond
