"""Single-pass data-quality profiler.

Completeness, validity, rule shares and distinct-count sketches run as *one* aggregation over the
table (``suite``; optionally grouped, e.g. by year) instead of one job per column.  Exact distinct
counts and key uniqueness are aggregations of their own: rows are counted by value or key, which
combines map-side, and the counts are counted.  In one aggregation with the others Spark would copy
every row once per distinct column and keep all counters by distinct key.  Every result has the
same long shape::

    table string, group string, check string, observed double, expected double, passed boolean

Gap statistics are exact yet skew-proof: rows are first counted per (entity, day) --
a partial aggregation, so a hot entity never lands in one task -- and the window then
runs over distinct days only, which the calendar bounds.  Duplicate days count as
gaps of 0 (days 01, 01, 03 -> gaps 0 and 2: mean 1.0, share of 1-day gaps 0.0).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.charts import label

REPORT_COLUMNS = ["table", "group", "check", "observed", "expected", "passed"]


def _report(agg: DataFrame, table: str, group_by: Sequence[str],
            rows: Sequence[tuple[str, Column, Column, Column | None]]) -> DataFrame:
    structs = []
    for check, observed, expected, passed in rows:
        if passed is None:
            passed = observed == expected
        structs.append(F.struct(
            F.lit(check).alias("check"),
            observed.cast("double").alias("observed"),
            expected.cast("double").alias("expected"),
            passed.cast("boolean").alias("passed"),
        ))
    return (agg.select(label(group_by).alias("group"), F.inline(F.array(*structs)))
            .select(F.lit(table).alias("table"), "group", "check", "observed", "expected", "passed"))


def _counters(not_null: Sequence[str], non_negative: Sequence[str], rules: Mapping[str, Column],
              sketched: Sequence[str], rsd: float = 0.01, within: Column | None = None, tag: str = ""):
    """Aggregates that combine map-side to one row per task and group, and their report rows.  With
    ``within`` only its rows count; ``tag`` precedes the aggregates' names."""
    def of(c: Column) -> Column:
        return c if within is None else within & c

    aggs, rows = [F.count(F.lit(1)) if within is None else F.count_if(within)], []
    names = ["__n"]
    for i, c in enumerate(not_null):
        aggs.append(F.count_if(of(F.col(c).isNotNull())))
        names.append(f"__nn{i}")
        rows.append((f"not_null({c})", F.col(f"__nn{i}"), F.col("__n"), None))
    for i, c in enumerate(non_negative):
        # Against all rows: a null is not a valid value.
        aggs.append(F.count_if(of(F.col(c) >= 0)))
        names.append(f"__ok{i}")
        rows.append((f"non_negative({c})", F.col(f"__ok{i}"), F.col("__n"), None))
    for i, (name, pred) in enumerate(rules.items()):
        aggs.append(F.avg(pred.cast("int") if within is None else F.when(within, pred.cast("int"))))
        names.append(f"__s{i}")
        rows.append((f"share_valid({name})", F.col(f"__s{i}"), F.lit(1.0), None))
    for i, c in enumerate(sketched):
        aggs += [F.approx_count_distinct(c, rsd), F.count(F.col(c))]
        names += [f"__d{i}", f"__dn{i}"]
        rows.append((f"distinct({c})", F.col(f"__d{i}"), F.col(f"__dn{i}"), F.lit(None)))
    return [a.alias(f"{tag}{n}") for a, n in zip(aggs, names, strict=True)], rows


def _by_key(df: DataFrame, group_by: Sequence[str], keys: Sequence[Column]) -> DataFrame:
    """(*group_by, __k0.., __c): rows of each key; nulls are equal to each other."""
    return df.groupBy(*group_by, *[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__c"))


def _distinct_report(df: DataFrame, table: str, group_by: Sequence[str], column: str) -> DataFrame:
    """Distinct values next to non-null values, no pass/fail (``unique`` is the check of a key)."""
    known = F.col("__k0").isNotNull()
    agg = _by_key(df, group_by, [F.col(column)]).groupBy(*group_by).agg(
        F.count_if(known).alias("__d"), F.coalesce(F.sum(F.when(known, F.col("__c"))), F.lit(0)).alias("__dn"))
    return _report(agg, table, group_by, [(f"distinct({column})", F.col("__d"), F.col("__dn"), F.lit(None))])


def _unique_report(df: DataFrame, table: str, group_by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    agg = _by_key(df, group_by, [F.col(k) for k in keys]).groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("__u"), F.coalesce(F.sum("__c"), F.lit(0)).alias("__n"))
    return _report(agg, table, group_by, [(f"unique({','.join(keys)})", F.col("__u"), F.col("__n"), None)])


def suite(df: DataFrame, table: str, group_by: Sequence[str] = (), not_null: Sequence[str] = (),
          non_negative: Sequence[str] = (), rules: Mapping[str, Column] | None = None,
          distinct: Sequence[str] = (), approx: bool = False,
          unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Completeness, validity, rule shares, distinct counts and key uniqueness of one table in the
    long shape: one aggregation for all counters (and, with ``approx``, the distinct sketches), and
    one that reads its own columns only for every exact distinct count and every key."""
    aggs, rows = _counters(not_null, non_negative, rules or {}, distinct if approx else ())
    parts = [_report(df.groupBy(*group_by).agg(*aggs), table, group_by, rows)] if rows else []
    parts += [] if approx else [_distinct_report(df, table, group_by, c) for c in distinct]
    parts += [_unique_report(df, table, group_by, k) for k in unique]
    return reduce(lambda a, b: a.unionByName(b), parts)


class WriteChecks:
    """The counters of ``suite`` taken while a table is written, so that nothing is read again.

    ``watch`` goes directly over the write (``sources.io.write_table(watch=...)`` sees to it): there each row passes
    once, whatever tasks run again, while a step whose shuffle is made anew would count twice.  After the
    write ``report`` gives the rows that ``suite`` would.  ``group_col`` with the listed ``groups`` reports by group; a
    further row compares the rows in listed groups with all rows, so none goes unseen.  Groups without
    rows have no report rows, as in ``suite``.  One object serves one write.
    """

    def __init__(self, table: str, not_null: Sequence[str] = (), non_negative: Sequence[str] = (),
                 rules: Mapping[str, Column] | None = None, group_col: str | None = None, groups: Sequence = ()):
        if bool(group_col) != bool(groups):
            raise ValueError("group_col and groups go together")
        self.table, self.group_col, self.groups = table, group_col, list(groups)
        self._columns = (not_null, non_negative, rules or {}, ())
        self._seen = Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        aggs, _ = _counters(*self._columns, tag="all")
        for i, g in enumerate(self.groups):
            aggs += _counters(*self._columns, within=F.col(self.group_col).eqNullSafe(F.lit(g)), tag=f"g{i}")[0]
        return df.observe(self._seen, *aggs)

    def report(self, spark: SparkSession) -> DataFrame:
        """The long report; call it after the write."""
        seen = self._seen.get
        _, rows = _counters(*self._columns)
        tags = {g: f"g{i}" for i, g in enumerate(self.groups)} or {"all": "all"}
        names = [c.split("__", 1)[1] for c in seen if c.startswith("all__")]
        kinds = ", ".join(["label string", *(f"__{n} {'double' if n.startswith('s') else 'long'}" for n in names)])
        found = [(None if g is None else str(g), *(seen[f"{t}__{n}"] for n in names)) for g, t in tags.items()
                 if not self.groups or seen[f"{t}__n"]]
        out = _report(spark.createDataFrame(found, kinds), self.table, ["label"], rows)
        if not self.groups:
            return out
        listed = spark.createDataFrame([(sum(seen[f"{t}__n"] for t in tags.values()), seen["all__n"])], "__l long, __n long")
        return out.unionByName(_report(listed, self.table, [], [("listed_groups", F.col("__l"), F.col("__n"), None)]))


def profile(df: DataFrame, table: str, columns: Sequence[str] | None = None,
            group_by: Sequence[str] = ()) -> DataFrame:
    """Completeness: not-null count of each column against the row count."""
    columns = list(columns or [c for c in df.columns if c not in group_by])
    return suite(df, table, group_by, not_null=columns)


def sign_check(df: DataFrame, table: str, columns: Sequence[str],
               group_by: Sequence[str] = ()) -> DataFrame:
    """Validity: rows with ``c >= 0`` against all rows."""
    return suite(df, table, group_by, non_negative=columns)


def share_valid(df: DataFrame, table: str, rules: Mapping[str, Column],
                group_by: Sequence[str] = ()) -> DataFrame:
    """Share of rows passing each rule; rows where the rule is null are left out."""
    return suite(df, table, group_by, rules=rules)


def distinct_counts(df: DataFrame, table: str, columns: Sequence[str],
                    group_by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Distinct values per column next to its non-null count (informational: passed is null).

    Exact by default, one aggregation a column; ``approx=True`` computes HyperLogLog++ sketches of
    all columns in one pass.
    """
    return suite(df, table, group_by, distinct=columns, approx=approx)


def unique_groups(df: DataFrame, table: str, group_cols: Sequence[str], value_col: str,
                  group_by: Sequence[str] = ()) -> DataFrame:
    """Share of groups in which ``value_col`` never repeats and is never null (distinct values ==
    rows)."""
    keys = list(group_by) + [g for g in group_cols if g not in group_by]
    inner = df.groupBy(*keys).agg(
        F.count_distinct(F.col(value_col)).alias("__d"), F.count(F.lit(1)).alias("__c"))
    agg = inner.groupBy(*group_by).agg(F.avg((F.col("__d") == F.col("__c")).cast("int")).alias("__s"))
    check = f"unique_within({value_col} by {','.join(group_cols)})"
    return _report(agg, table, group_by, [(check, F.col("__s"), F.lit(1.0), None)])


def key_unique(df: DataFrame, table: str, keys: Sequence[str] | Sequence[Sequence[str]],
               group_by: Sequence[str] = ()) -> DataFrame:
    """Distinct key tuples (nulls compare equal) against the row count, for one key set or a list
    of several."""
    key_sets = [list(keys)] if keys and isinstance(keys[0], str) else [list(k) for k in keys]
    return suite(df, table, group_by, unique=key_sets)


def unmatched_both(left: DataFrame, right: DataFrame, keys: Sequence[str], left_table: str,
                   right_table: str) -> DataFrame:
    """Unmatched rows in both directions from ONE full outer join of per-key row counts.

    Each side is reduced to (key, rows) first (a partial aggregation), so the join sees
    one row per key per side; the two counts come from one aggregation.
    """
    lc = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__l"))
    rc = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__r"))
    j = lc.join(rc, list(keys), "full_outer")
    agg = j.agg(F.sum(F.when(F.col("__r").isNull(), F.col("__l")).otherwise(0)).alias("__ml"),
                F.sum(F.when(F.col("__l").isNull(), F.col("__r")).otherwise(0)).alias("__mr"))
    check = F.lit(f"unmatched({','.join(keys)})")

    def row(tbl, observed):
        return F.struct(F.lit(tbl).alias("table"), F.lit("all").alias("group"), check.alias("check"),
                        observed.cast("double").alias("observed"), F.lit(0.0).alias("expected"),
                        (observed == 0).alias("passed"))
    # Both rows come out of the one aggregate row (no union, so no second evaluation).
    return agg.select(F.inline(F.array(row(left_table, F.col("__ml")), row(right_table, F.col("__mr")))))


def day_counts(df: DataFrame, entity_cols: Sequence[str], date_col: str = "date",
               keep_null: bool = False) -> DataFrame:
    """(*entity, date, n_rows), without null dates unless they are kept: the per-day grain of the
    continuity checks."""
    rows = df if keep_null else df.where(F.col(date_col).isNotNull())
    return rows.groupBy(*entity_cols, date_col).agg(F.count(F.lit(1)).alias("n_rows"))


def day_gaps(df: DataFrame, entity_cols: Sequence[str], date_col: str = "date",
             keep_null: bool = False) -> DataFrame:
    """(entity, date, n_rows, prev_date, gap) over *distinct* days of each entity."""
    w = Window.partitionBy(*entity_cols).orderBy(date_col)
    prev = F.lag(date_col).over(w)
    return (day_counts(df, entity_cols, date_col, keep_null).withColumn("prev_date", prev)
            .withColumn("gap", F.datediff(F.col(date_col), F.col("prev_date"))))


def gap_stats(df: DataFrame, table: str, entity_cols: Sequence[str], date_col: str = "date",
              group_by: Sequence[str] = (), unique_days: bool = False,
              listed_in: tuple[str, DataFrame] | None = None,
              max_broadcast_rows: int = 100_000, across: bool = False) -> DataFrame:
    """Time-step continuity: min, max, mean gap and share of 1-day gaps (expected 1 each).

    One pipeline: rows -> per-(entity, day) counts -> gap window -> per-entity aggregate
    -> per-group aggregate.  Two more checks ride on the per-entity level at no extra
    scan: ``unique_days`` adds the share of entities whose dates never repeat and are never null, and
    ``listed_in=(col, known)`` adds the number of distinct ``col`` values (e.g. station
    ids) absent from ``known`` -- a small list, joined at the per-entity level.

    Gaps are those within a group, so with years as groups a gap from December to January is in
    none of them.  ``across`` stitches the groups: of each entity's rows in a group only the first
    and the last day are kept, and the days from the last one of its group before to the first one
    of the next make ``gap_across_max``, ``_min``, ``_share_1`` and ``_count`` of the later group
    (a group without rows of the entity is passed over; groups that overlap give 0 or less).
    """
    if across and not group_by:
        raise ValueError("across needs groups")
    part = list(group_by) + [e for e in entity_cols if e not in group_by]
    # Null dates take part in no gap, but an entity that has one fails the unique-days check.
    g = day_gaps(df, part, date_col, keep_null=unique_days)
    dated = F.col(date_col).isNotNull()
    ent = g.groupBy(*part).agg(
        F.sum(F.when(dated, F.col("n_rows") - 1).otherwise(0)).alias("__z"), F.count("gap").alias("__st"), F.sum("gap").alias("__su"),
        F.count_if(F.col("gap") == 1).alias("__on"), F.min("gap").alias("__mi"), F.max("gap").alias("__ma"),
        (F.max("n_rows") + F.max((~dated).cast("int"))).alias("__mn"), F.min(date_col).alias("__first"), F.max(date_col).alias("__last"))
    extra_aggs, extra_rows = [], []
    if unique_days:
        extra_aggs.append(F.avg((F.col("__mn") == 1).cast("int")).alias("__ud"))
        extra_rows.append((f"unique_within({date_col} by {','.join(entity_cols)})", F.col("__ud"), F.lit(1.0), None))
    if listed_in is not None:
        from panelspark.operators.relational import broadcast_if_bounded
        col, known = listed_in
        k = known.select(F.col(col)).where(F.col(col).isNotNull()).distinct().withColumn("__listed", F.lit(True))
        ent = ent.join(broadcast_if_bounded(k, max_broadcast_rows, probe=known), col, "left")
        extra_aggs.append(F.count_distinct(F.when(F.col("__listed").isNull(), F.col(col))).alias("__um"))
        extra_rows.append((f"unmatched({col})", F.col("__um"), F.lit(0.0), None))
    if across:
        # A row for each entity and group: the window holds as many as there are groups.
        before = F.lag("__last").over(Window.partitionBy(*[e for e in entity_cols if e not in group_by]).orderBy("__first", *group_by))
        ent = ent.withColumn("__step", F.datediff("__first", before))
        extra_aggs += [F.max("__step").alias("__xma"), F.min("__step").alias("__xmi"), F.count("__step").alias("__xn"),
                       F.avg((F.col("__step") == 1).cast("int")).alias("__xs")]
        extra_rows += [("gap_across_max", F.col("__xma"), F.lit(1.0), None), ("gap_across_min", F.col("__xmi"), F.lit(1.0), None),
                       ("gap_across_share_1", F.col("__xs"), F.lit(1.0), None),
                       ("gap_across_count", F.col("__xn"), F.lit(None), F.lit(None))]
    agg = ent.groupBy(*group_by).agg(
        F.sum("__z").alias("__zeros"), F.sum("__st").alias("__steps"), F.sum("__su").alias("__sum"),
        F.sum("__on").alias("__ones"), F.min("__mi").alias("__min"), F.max("__ma").alias("__max"), *extra_aggs)
    total = F.col("__zeros") + F.col("__steps")
    min_gap = F.when(F.col("__zeros") > 0, F.lit(0)).otherwise(F.col("__min"))
    max_gap = F.coalesce(F.col("__max"), F.when(F.col("__zeros") > 0, F.lit(0)))
    rows = [
        # Only repeated days (0-day gaps) leave the sum of day steps null; their mean is 0.
        ("gap_mean", F.try_divide(F.coalesce(F.col("__sum"), F.lit(0)).cast("double"), total), F.lit(1.0), None),
        ("gap_share_1", F.try_divide(F.col("__ones").cast("double"), total), F.lit(1.0), None),
        ("gap_min", min_gap, F.lit(1.0), None),
        ("gap_max", max_gap, F.lit(1.0), None),
        ("gap_count", total, F.lit(None), F.lit(None)),
        *extra_rows,
    ]
    return _report(agg, table, group_by, rows)


def coverage(left: DataFrame, right: DataFrame, column: str, right_column: str | None = None,
             name: str = "name") -> DataFrame:
    """Names present on exactly one side: (name, in_left, in_right)."""
    right_column = right_column or column
    lt = left.select(F.col(column).alias(name)).distinct().withColumn("in_left", F.lit(True))
    rt = right.select(F.col(right_column).alias(name)).distinct().withColumn("in_right", F.lit(True))
    both = lt.join(rt, name, "full_outer").na.fill(False, ["in_left", "in_right"])
    return both.where(~(F.col("in_left") & F.col("in_right")))
