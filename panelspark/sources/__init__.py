"""Sources, sinks and catalog helpers."""

from panelspark.sources.intake import Intake, scan_intake
from panelspark.sources.io import (
    drop_table,
    empty_frame,
    list_catalog,
    read_csv,
    read_table,
    register_views,
    scan_family,
    union_all,
    write_parts,
    write_table,
)
from panelspark.sources.versions import publish, read_published, restore, versions

__all__ = [
    "Intake",
    "drop_table",
    "empty_frame",
    "list_catalog",
    "publish",
    "read_csv",
    "read_published",
    "read_table",
    "register_views",
    "restore",
    "scan_family",
    "scan_intake",
    "union_all",
    "versions",
    "write_parts",
    "write_table",
]
