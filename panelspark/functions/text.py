"""Text conformity: whitespace repair, regex rewrites, correction tables and overrides.

All of it is native Spark expressions -- no Python UDFs.  Correction tables are data:
pass a ``dict`` (compiled into a literal map, evaluated inside whole-stage codegen) or
a two-column DataFrame ``(src, dst)`` (joined, broadcast only behind a size check).
Null input always stays null.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# County spelling corrections and district overrides stated by the
# source analysis (exact matches after whitespace repair), plus the one prefix rule.
COUNTY_CORRECTIONS = {
    "Aikin": "Aitkin",
    "Carlson": "Carlton",
    "Penningham": "Pennington",
    "St Louis": "Saint Louis",
    "St. Louis": "Saint Louis",
}
COUNTY_PREFIX_RULES = (("Olmsted", "Olmsted"),)
DISTRICT_OVERRIDES = {"Cass": "3", "Koochiching": "1", "Itasca": "1"}
SAINT_LOUIS_PATTERN = r"^St\.? Louis$"

_WS = "[\\s\\u00a0]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: str | Column) -> Column:
    """Collapse runs of whitespace *including U+00A0* to one space, then trim."""
    return F.trim(F.regexp_replace(_col(c), _WS, " "))


def regex_conform(c: str | Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(_col(c), pattern, replacement)


def _map_literal(mapping: Mapping[str, str]) -> Column:
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def apply_corrections(c: str | Column, corrections: Mapping[str, str] | None = None,
                      prefix_rules: Iterable[tuple[str, str]] = (), clean: bool = True) -> Column:
    """Conform a name: prefix rules first (``startswith``), then exact corrections, else unchanged."""
    x = clean_text(c) if clean else _col(c)
    out = x
    if corrections:
        out = F.coalesce(F.try_element_at(_map_literal(corrections), x), x)
    rules = list(prefix_rules)
    if rules:
        expr = None
        for prefix, value in rules:
            cond = x.startswith(prefix)
            expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
        out = expr.otherwise(out)
    return out


def conform_with_table(df: DataFrame, column: str, table: DataFrame, src: str = "src",
                       dst: str = "dst", out: str | None = None, clean: bool = True,
                       max_broadcast_rows: int = 100_000) -> DataFrame:
    """Like :func:`apply_corrections` but the corrections come as a DataFrame ``(src, dst)``."""
    from panelspark.operators.relational import broadcast_if_bounded

    out = out or column
    key = "__conform_key"
    # One target per source name; if the table repeats a name, the smallest target wins
    # (deterministic, unlike dropDuplicates).
    t = (table.groupBy(F.col(src).alias(key))
         .agg(F.min(F.col(dst)).alias("__conform_dst")))
    t = broadcast_if_bounded(t, max_broadcast_rows, probe=table)
    base = df.withColumn(key, clean_text(column) if clean else F.col(column))
    return (base.join(t, key, "left")
            .withColumn(out, F.coalesce(F.col("__conform_dst"), F.col(key)))
            .drop(key, "__conform_dst"))


def override(c: str | Column, key: str | Column, overrides: Mapping[str, str]) -> Column:
    """``overrides[key]`` where present, else the original value."""
    return F.coalesce(F.try_element_at(_map_literal(overrides), _col(key)), _col(c))
