r"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue (by an md5 of id and text) that is repeated up
to ``max_copies`` times.  A document's virtual finish time is its source's words up to and
including it, divided by the source's weight.  All queue entries are sorted by that time across
sources and the sequence is truncated at the total budget: at the virtual time when all queues
together have been served the budget, the document in service in each queue is cut to the words
served so far.  A queue that runs out leaves its share to the others in proportion to their
weights, so the words served are the capped targets themselves.

Sources are ranked by code point, null last, and weigh ``weights`` in turn, repeating.  A word
is a run of ``[^\x20\x09-\x0D]``; the budget is the sum of all sizes.

Defined cases: a null or empty text has size 0 and takes 0 words; a source without words has
target 0; equal rows stand next to each other in the queue and share what falls on them in an
arbitrary but repeatable order; an empty table mixes nothing.  Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspark.llm.running import FINE_ROWS, add_total_before, fine_bucket
from panelspark.llm.tables import released
from panelspark.llm.textscan import fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: str, text: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"),
                          F.md5(F.coalesce(F.col(text), F.lit("")))))


def targets(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, rank, weight, rows, source_size, target, level) with one row per source.

    Water filling: in the order of cap / weight, a source is full while the level that shares
    the rest of the budget by weight reaches its cap; the level is the greatest such quotient.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    # One row per distinct source: these windows sort the list of sources, not documents.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("rank", F.row_number().over(by_name))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(table, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * max_copies
    every = Window.partitionBy()
    by_cap = Window.orderBy(cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(by_cap), F.lit(0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))))
    return (ranked.withColumn("_quotient", level).withColumn("level", F.max("_quotient").over(every)).drop("_quotient")
            .withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.col("level"))))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """The queue entries: (key, copy, row_bucket, row_rank, doc_id, source, size, source_size,
    target, weight, finish, words, position).

    One row per document and copy; ``words`` is what the mix takes of it (0 beyond the budget)
    and ``position`` the words of the mix before it.  (rank, row_bucket, row_rank) names the
    document's row.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                        word_count(text).alias("size"), shuffle_key(doc_id, text).alias("key")).checkpoint()
    src = targets(sized, weights, max_copies)
    rows = sized.join(src, sized["source"].eqNullSafe(src["source"])).drop(src["source"])
    place = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    rows = rows.withColumn("row_bucket", fine_bucket(place, F.col("rows")))
    queue = add_total_before(rows, "rank", "row_bucket", [F.col("key"), F.col("doc_id"), F.col("size")], "size",
                             "before", "row_rank")
    start = F.col("copy") * F.col("source_size") + F.col("before")
    served = F.round("target").cast("long")
    entries = (queue.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))))
               .withColumn("finish", (start + F.col("size")) / F.col("weight"))
               .withColumn("words", F.greatest(F.least(served - start, F.col("size")), F.lit(0))))
    # Global order by virtual finish time: words are served at an even pace, so equal slices of
    # virtual time hold about equal numbers of words.
    share = F.when(F.col("level") > 0, F.least(F.col("finish") / F.col("level"), F.lit(1.0))).otherwise(0.0)
    total_rows = F.sum(F.col("rows")).over(Window.partitionBy())
    counts = src.select(F.col("rank").alias("_rank"), (total_rows * max_copies).alias("_entries"))
    # Entries that are not served come after, spread evenly: they move no position.
    slices = F.greatest(F.ceil(F.col("_entries") / float(FINE_ROWS)), F.lit(1))
    after = slices + F.pmod(F.xxhash64("key", "copy"), slices)
    entries = (entries.join(counts, F.col("rank") == F.col("_rank")).drop("_rank").withColumn("_all", F.lit(0))
               .withColumn("_slice", F.when(F.col("words") > 0, fine_bucket(share, F.col("_entries"))).otherwise(after)))
    return (add_total_before(entries, "_all", "_slice", [F.col("finish"), F.col("rank"), F.col("row_bucket"),
                                                         F.col("row_rank"), F.col("copy")], "words", "position", "_n")
            .select("key", "copy", "rank", "row_bucket", "row_rank", "doc_id", "source", "size", "source_size",
                    "target", "weight", "finish", "words", "position"))


def taken(entries: DataFrame) -> DataFrame:
    """One row per document of ``mix``'s entries: words taken, copies begun, first position."""
    return entries.groupBy("rank", "row_bucket", "row_rank").agg(
        F.first("key").alias("key"), F.first("doc_id").alias("doc_id"), F.first("source").alias("source"),
        F.first("size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.sum("words").alias("taken"),
        F.sum((F.col("words") > 0).cast("long")).alias("copies"),
        F.min(F.when(F.col("words") > 0, F.col("position"))).alias("first_position"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    **options) -> DataFrame:
    """The documents that the mix takes, with all their columns plus a struct ``mix`` (taken,
    copies, first_position).  Rows equal in id, text and source are matched one to one."""
    key, src, nth, out = (fresh(c, docs.columns) for c in ("_mix_key", "_mix_source", "_mix_nth", "mix"))
    left = docs.withColumn(key, shuffle_key(doc_id, text))
    right = released(taken(mix(docs, doc_id, text, source, **options)).select(
        F.col("key").alias(key), F.col("source").alias(src), F.struct("taken", "copies", "first_position").alias(out)))
    twice = right.groupBy(key, src).count().where("count > 1").select(key)
    same = [key]
    if twice.limit(1).count():
        # Equal rows: number them on both sides.
        left = left.withColumn(nth, F.row_number().over(Window.partitionBy(key, source).orderBy(key)))
        right = right.withColumn(nth, F.row_number().over(Window.partitionBy(key, src).orderBy(key)))
        same.append(nth)
    match = left[source].eqNullSafe(right[src])
    for c in same:
        match &= left[c] == right[c]
    joined = left.join(right, match).drop(*[right[c] for c in same])
    return joined.where(F.col(out)["taken"] > 0).select(*docs.columns, out)
