"""Column-level functions: dates, calendars and text conformity (all JVM-side)."""

from panelspark.functions.dates import (
    DEFAULT_DATE_FORMATS,
    calendar_keys,
    day_number,
    parse_mixed_dates,
)
from panelspark.functions.text import apply_corrections, clean_text, override, regex_conform

__all__ = [
    "DEFAULT_DATE_FORMATS",
    "apply_corrections",
    "calendar_keys",
    "clean_text",
    "day_number",
    "override",
    "parse_mixed_dates",
    "regex_conform",
]
