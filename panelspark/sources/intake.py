"""CSV intake by header names, with bad rows set apart.

``read_csv`` binds columns by position and turns what it cannot parse into nulls.  Here the first
line of every file is read once, in one pass that stops after it, and files with the same header
form a layout.  Each layout is one scan with its columns bound by name, so a year that lists its
columns in another order is read right.  A file that lacks a column of the schema, names one twice
or has no header is reported with its path (``unknown="raise"``) or left out and listed in ``files``
(``unknown="skip"``); columns that the schema does not have are read past.

A row that does not fit its types or its number of columns, or whose date text is no date, goes to
the quarantine with its text, its file and the reason.  Rows in = rows good + rows quarantined, in
total and by file: every row of the scan is exactly one of the two.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelspark.sources.io import YEAR_TOKEN, empty_frame, file_year, read_csv

CORRUPT, FILE, REASON = "_corrupt", "_file", "_reason"
_SPLITS = ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")


def header_key(name: str) -> str:
    """A header name as it is compared: lower case, other signs as one underscore, no byte-order mark."""
    return re.sub(r"[^0-9a-z]+", "_", name.replace("\ufeff", "").replace("\u00a0", " ").strip().lower()).strip("_")


@dataclass(frozen=True)
class Layout:
    """The schema column at each position of a header (None: not in the schema)."""

    columns: tuple[str | None, ...]
    missing: tuple[str, ...]
    twice: tuple[str, ...]

    @property
    def known(self) -> bool:
        return bool(self.columns) and not self.missing and not self.twice

    def file_schema(self, schema: StructType) -> StructType:
        fields = [StructField(f"_extra{i}", StringType()) if c is None else schema[c] for i, c in enumerate(self.columns)]
        return StructType([*fields, StructField(CORRUPT, StringType())])


def layout_of(header: str | None, schema: StructType, aliases: Mapping[str, Sequence[str]] | None = None,
              sep: str = ",") -> Layout:
    names = {header_key(n): c for c in schema.names for n in (c, *(aliases or {}).get(c, ()))}
    found = [] if header is None else [names.get(header_key(n)) for n in next(csv.reader([header], delimiter=sep), [])]
    return Layout(tuple(found), tuple(c for c in schema.names if c not in found),
                  tuple(c for c in schema.names if found.count(c) > 1))


def header_lines(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, str | None]]:
    """(path, first line that is not blank) of every file with any bytes, None without such a line.

    Every file is one task, which ends with its second batch of lines at the latest; what reaches the
    driver is one line a file, as many as Spark's own list of the files.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    was = {k: spark.conf.get(k) for k in _SPLITS}
    for k in _SPLITS:
        spark.conf.set(k, str(1 << 38))      # no two files in one task, no file in two
    try:
        lines = (spark.read.option("recursiveFileLookup", "true").text(paths)
                 .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"))

        def first(batches):
            found = False
            for batch in batches:
                if found or batch.num_rows and batch.column("start")[0].as_py() > 0:
                    return
                for path, value in zip(batch.column("path"), batch.column("value"), strict=True):
                    if value.as_py().replace("\ufeff", "").strip():
                        yield pa.RecordBatch.from_pydict({"path": [path.as_py()], "header": [value.as_py()]})
                        found = True
                        break

        found = dict(map(tuple, lines.mapInArrow(first, "path string, header string").collect()))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
              .select(F.col("_metadata.file_path").alias("path")))      # no content is read
    return sorted((p, found.get(p)) for (p,) in listed.collect())


@dataclass
class Intake:
    """``rows``: the schema's columns (and the year), ``_file``, ``_corrupt`` and ``_reason``;
    ``files``: (path, header, layout number or null, problem or null)."""

    rows: DataFrame
    files: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c not in (CORRUPT, FILE, REASON)]

    def good(self) -> DataFrame:
        return self.rows.where(F.col(REASON).isNull()).select(*self.columns)

    def quarantine(self, table: str) -> DataFrame:
        """(table, file, reason, record): the text of every row that was set apart."""
        return self.rows.where(F.col(REASON).isNotNull()).select(
            F.lit(table).alias("table"), F.col(FILE).alias("file"), F.col(REASON).alias("reason"), F.col(CORRUPT).alias("record"))

    def counts(self, by: Sequence[str] = (FILE,)) -> DataFrame:
        """(*by, rows_in, rows_good, rows_quarantined) in one aggregation."""
        bad = F.col(REASON).isNotNull()
        return self.rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(~bad).alias("rows_good"),
                                          F.count_if(bad).alias("rows_quarantined"))

    def report(self, table: str) -> DataFrame:
        """A row a file in the shape of the quality reports: quarantined rows, none expected; files that
        were left out fail with null."""
        counted = self.counts().select(F.col(FILE).alias("group"), F.col("rows_quarantined").cast("double").alias("observed"))
        left_out = self.files.where(F.col("problem").isNotNull()).select(
            F.col("path").alias("group"), F.lit(None).cast("double").alias("observed"))
        return counted.unionByName(left_out).select(
            F.lit(table).alias("table"), "group", F.lit("rows_quarantined").alias("check"), "observed",
            F.lit(0.0).alias("expected"), F.coalesce(F.col("observed") == 0, F.lit(False)).alias("passed"))


def scan_intake(spark: SparkSession, paths: str | Sequence[str], schema: StructType,
                aliases: Mapping[str, Sequence[str]] | None = None, unknown: str = "raise",
                dates: Mapping[str, Callable[[str], Column]] | None = None, year_col: str | None = None,
                year_pattern: str = YEAR_TOKEN, sep: str = ",") -> Intake:
    """Files of one schema, bound by their headers.

    ``dates`` maps text columns to the function that parses them; a non-empty text that it makes
    null is a bad row.  ``year_col`` adds the year in the file's path, as ``scan_family`` does.
    """
    if unknown not in ("raise", "skip"):
        raise ValueError("unknown must be 'raise' or 'skip'")
    groups: dict[Layout, list[str]] = {}
    listed = []
    for path, header in header_lines(spark, paths):
        layout = layout_of(header, schema, aliases, sep)
        problem = None
        if header is None:
            problem = "no header"
        elif not layout.known:
            problem = "; ".join(p for p in (f"missing: {', '.join(layout.missing)}" if layout.missing else "",
                                            f"twice: {', '.join(layout.twice)}" if layout.twice else "") if p)
        else:
            groups.setdefault(layout, []).append(path)
        listed.append((path, header, None if problem else list(groups).index(layout), problem))
    bad = [(p, h, why) for p, h, _, why in listed if why and h is not None]
    if bad and unknown == "raise":
        raise ValueError("headers do not fit the schema: " + " | ".join(f"{p}: {why} (header {h!r})" for p, h, why in bad))
    files = spark.createDataFrame(listed, "path string, header string, layout int, problem string")

    def scan(layout: Layout, members: list[str]) -> DataFrame:
        df = read_csv(spark, [unquote(p) for p in members], layout.file_schema(schema), sep=sep,
                      columnNameOfCorruptRecord=CORRUPT)
        path = F.col("_metadata.file_path")
        year = [file_year(path, year_pattern).alias(year_col)] if year_col else []
        # The parser judges a row by the columns that it is asked for, so the test asks for all; any hash passes.
        bad = F.col(CORRUPT).isNotNull() & (F.hash(*[c for c in df.columns if c != CORRUPT]) >= -(1 << 31))
        return df.select(*schema.names, *year, path.alias(FILE), F.when(bad, F.col(CORRUPT)).alias(CORRUPT))

    columns = StructType([*schema.fields, *([StructField(year_col, StringType())] if year_col else []),
                          StructField(FILE, StringType()), StructField(CORRUPT, StringType())])
    scans = [scan(layout, members) for layout, members in groups.items()]
    rows = reduce(DataFrame.unionByName, scans) if scans else empty_frame(spark, columns)
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed")
    for c, parse in (dates or {}).items():
        text = F.trim(F.regexp_replace(F.col(c), "\u00a0", " "))
        reason = reason.when((text != "") & parse(c).isNull(), f"bad {c}")
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*schema.names)))
    return Intake(rows.withColumn(REASON, reason).withColumn(CORRUPT, F.when(F.col(REASON).isNotNull(), record)), files)
