"""Running aggregates of one ordered series without a window over all of it.

A series without keys has one order, and a plain window over it is one task.  Here the calendar
is cut into blocks of ``BLOCK_DAYS`` days: a window runs within each block, and what stands before a
block comes from the blocks' totals.  These are added up in a binary hierarchy of the block
numbers (the nodes of level l hold 2**l blocks); what precedes block b is the nodes named by the
set bits of b, so each block writes and reads at most ``LEVELS`` small rows, all dealt by (level, node).
No step has a single partition, and no block meets all others.

Blocks are named by the date alone: the same rows give the same blocks on every run and in every
task that runs again.  A block holds the rows of its days, so the input should be of daily grain.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.dates import day_number
from panelspark.session import ensure_checkpoint_dir

BLOCK_DAYS = 256
LEVELS = 24           # 2**24 blocks of 256 days span every date that Spark can hold

# Aggregates that merge with themselves, and how two of their results become one.
_MERGE: dict[Callable, Callable[[Column, Column], Column]] = {
    F.sum: lambda a, b: F.coalesce(a + b, a, b),
    F.max: lambda a, b: F.greatest(a, b),
    F.min: lambda a, b: F.least(a, b),
}


def block_of(date_col: str) -> Column:
    """Number of the date's block; rows without a date, which sort first, are in block 0."""
    day = day_number(F.col(date_col).cast("date"), "0001-01-01")
    return F.greatest(F.floor(day / BLOCK_DAYS), F.lit(0)).cast("int")


def before_blocks(totals: DataFrame, block: str, merges: Mapping[str, Callable]) -> DataFrame:
    """(block, *columns): each column merged over all smaller blocks.  ``totals`` has one row a block;
    the first block is absent from the result."""
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    up = lambda level: F.call_function("shiftright", F.col(block), level)
    merged = [f(F.col(c)).alias(c) for c, f in merges.items()]
    nodes = (totals.withColumn("_level", F.explode(levels)).withColumn("_node", up(F.col("_level")))
             .groupBy("_level", "_node").agg(*merged))
    asks = (totals.select(block, F.explode(F.filter(levels, lambda x: up(x) % 2 == 1)).alias("_level"))
            .withColumn("_node", up(F.col("_level")) - 1))
    return asks.join(nodes, ["_level", "_node"]).groupBy(block).agg(*merged)


def running(df: DataFrame, date_col: str, order: Sequence[str | Column],
            columns: Mapping[str, tuple[Callable, str]], end: int = 0) -> DataFrame:
    """``df`` with each ``out: (function, column)`` aggregated over the rows up to this one (``end=0``) or before
    it (``end=-1``).  ``order`` must start with ``date_col`` or rise with it; functions are ``F.sum``, ``F.max``
    and ``F.min``.  ``df`` is checkpointed, as it is read twice: once by block, once row by row."""
    for f, _ in columns.values():
        if f not in _MERGE:
            raise ValueError(f"{f.__name__} does not merge")
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.withColumn("_block", F.coalesce(block_of(date_col), F.lit(0))).checkpoint()
    w = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    inner = rows.withColumns({out: f(c).over(w) for out, (f, c) in columns.items()})
    totals = rows.groupBy("_block").agg(*[f(c).alias(out) for out, (f, c) in columns.items()])
    earlier = before_blocks(totals, "_block", {out: f for out, (f, _) in columns.items()})
    earlier = earlier.withColumnsRenamed({out: f"_before_{i}" for i, out in enumerate(columns)})
    return inner.join(earlier, "_block", "left").select(*df.columns, *[
        _MERGE[f](F.col(f"_before_{i}"), F.col(out)).cast(inner.schema[out].dataType).alias(out)
        for i, (out, (f, _)) in enumerate(columns.items())])
