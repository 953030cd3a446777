"""Proposals for names that only one of two lists has: likely misspellings of the other list's names.

Two names are compared when they share a spelling with up to ``max_distance`` characters left out.
Names within an edit distance of d always do, with at most d left out of each, so the equi-join on such
spellings misses no pair, and no list is compared with all of another.  The edit distance of a pair
found so is then computed.  A name allows one edit per ``CHARS_PER_EDIT`` characters of the shorter name,
so short names, of which many are alike, do not meet in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.text import clean_text

CHARS_PER_EDIT = 3
MAX_DISTANCE = 2


def _one_less(words: Column) -> Column:
    """All spellings with one character left out of one of ``words``."""
    def cut(s):
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
    return F.array_distinct(F.flatten(F.transform(words, cut)))


def _edits(name: Column, max_distance: int) -> Column:
    return F.least(F.floor(F.length(name) / CHARS_PER_EDIT), F.lit(max_distance)).cast("int")


def _names(df: DataFrame, column: str) -> DataFrame:
    """(name, n_rows, folded): one row a name; case and white space do not count in comparisons."""
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("folded", F.lower(clean_text("name"))))


def _spelt(names: DataFrame, max_distance: int) -> DataFrame:
    """A row for each spelling (its hash in ``spelling``) with as many characters left out as the name allows."""
    step, levels = F.array("folded"), [F.array("folded")]
    for d in range(1, max_distance + 1):
        step = _one_less(step)
        levels.append(F.when(_edits(F.col("folded"), max_distance) >= d, step).otherwise(F.array().cast("array<string>")))
    hashed = F.transform(F.concat(*levels), lambda s: F.xxhash64(s))
    return names.withColumn("spelling", F.explode(F.array_distinct(hashed)))


def propose_spellings(left: DataFrame, right: DataFrame, column: str, right_column: str | None = None,
                      max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(name, in_left, n_rows, proposal, proposal_rows, distance, best): for every name that one side alone has, the
    other side's names within the edits allowed; ``best`` marks those at the name's smallest distance.

    Names that differ in case or white space only have distance 0.  Null names are left out; a name
    without a proposal has no row.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("max_distance must be 0 to 3: spellings grow with that power of a name's length")
    lt, rt = _names(left, column), _names(right, right_column or column)

    def one_way(alone: DataFrame, others: DataFrame, in_left: bool) -> DataFrame:
        mine = _spelt(alone.join(others.select("name"), "name", "left_anti"), max_distance)
        theirs = _spelt(others, max_distance).select(
            "spelling", F.col("name").alias("proposal"), F.col("n_rows").alias("proposal_rows"), F.col("folded").alias("_other"))
        pairs = mine.join(theirs, "spelling").drop("spelling").distinct()
        return (pairs.withColumn("distance", F.levenshtein("folded", "_other"))
                .where(F.col("distance") <= F.least(_edits(F.col("folded"), max_distance), _edits(F.col("_other"), max_distance)))
                .select("name", F.lit(in_left).alias("in_left"), "n_rows", "proposal", "proposal_rows", "distance"))

    found = one_way(lt, rt, True).unionByName(one_way(rt, lt, False))
    smallest = F.min("distance").over(Window.partitionBy("name", "in_left"))
    return found.withColumn("best", F.col("distance") == smallest)
