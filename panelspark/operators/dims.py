"""Dimensions: one row per key, current-plus-retired merges, and fact attachment.

``first_per_key`` is an aggregation (``min`` of a struct whose leading fields are the
order columns), not a window: it combines map-side, so a key holding a third of all
rows is reduced inside every task before the shuffle and never sorted in one task.
The struct carries every remaining column as a tie-break, so the survivor is fully
determined (ascending, nulls first -- Spark's default ``orderBy``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.text import COUNTY_CORRECTIONS, COUNTY_PREFIX_RULES, apply_corrections
from panelspark.operators.relational import broadcast_if_bounded


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                  descending: bool = False) -> DataFrame:
    keys = list(keys)
    order_by = [c for c in order_by if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    fields = order_by + rest
    packed = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    pick = F.max(packed) if descending else F.min(packed)
    agg = df.groupBy(*keys).agg(pick.alias("__first"))
    return agg.select(*keys, *[F.col(f"__first.f{i}").alias(c) for i, c in enumerate(fields)]) \
              .select(*df.columns)


def merge_candidates(candidates: DataFrame, key: str, name_col: str = "county", prio_col: str = "prio",
                     status_col: str = "status", corrections: Mapping[str, str] | None = COUNTY_CORRECTIONS,
                     prefix_rules=COUNTY_PREFIX_RULES, carry: Sequence[str] = ()) -> DataFrame:
    """One row per key from candidate rows (key, name, prio, status, *carry): the lowest priority
    wins (current = 0 before retired = 1), then the lowest status, then the name.  One
    aggregation; names are conformed afterwards."""
    merged = first_per_key(candidates.select(key, name_col, prio_col, status_col, *carry), [key],
                           [prio_col, status_col, name_col]).select(key, name_col, *carry)
    return merged.withColumn(name_col, apply_corrections(name_col, corrections, prefix_rules))


def merge_dimension(current: DataFrame, retired: DataFrame, key: str, status_col: str,
                    name_col: str = "county", corrections: Mapping[str, str] | None = COUNTY_CORRECTIONS,
                    prefix_rules=COUNTY_PREFIX_RULES) -> DataFrame:
    """Current rows plus retired rows whose key is not current: one row per key.

    One aggregation over ``current`` union ``retired``: a current row wins (priority 0),
    otherwise the retired row with the lowest status (then name).  Each input is scanned
    once and the merge needs no anti-join.  When both lists come from one table, build
    the candidates in one pass and call :func:`merge_candidates` directly.
    """
    status_type = retired.schema[status_col].dataType      # keep its own ordering (numbers, dates)
    cur = current.select(key, name_col, F.lit(0).alias("__prio"), F.lit(None).cast(status_type).alias("__status"))
    ret = retired.select(key, name_col, F.lit(1).alias("__prio"), F.col(status_col).alias("__status"))
    return merge_candidates(cur.unionByName(ret), key, name_col, "__prio", "__status", corrections, prefix_rules)


def attach(fact: DataFrame, dim: DataFrame, on, how: str = "left",
           max_broadcast_rows: int | None = None) -> DataFrame:
    """Join a dimension onto a fact: a shuffle join that AQE turns into a broadcast when the
    dimension's measured size is small.  ``max_broadcast_rows`` checks and hints a *source table*
    up front; a derived dimension would be computed twice for that."""
    if max_broadcast_rows:
        dim = broadcast_if_bounded(dim, max_broadcast_rows)
    return fact.join(dim, on, how)
