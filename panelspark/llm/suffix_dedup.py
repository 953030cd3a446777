"""Removal of byte strings that occurred earlier: sparse distributed prefix doubling.

A byte is removed when it is covered by a ``length``-byte string that also starts earlier (in a
smaller id, or before in the same text).  The suffixes are ranked by sorting, with growing
prefixes, until a suffix is unique or ranked past ``length`` bytes.  Spark sorts (rank, rank of the
longer context, position) rows; a row compares itself with its neighbour in the sorted order, so
no group of equal rows is ever held in memory.

Not every position is sorted.  Every ``length``-byte string has one anchor: the position of the
smallest hash among its ``GRAM``-byte substrings (the first of equal ones).  Equal strings have equal
anchors at equal offsets, so it is enough to compare strings of anchors with equal substrings:

1. Anchors, about one in 35 bytes, are sorted by (hash of the GRAM bytes, hash of all bytes of the
   strings that they are the anchor of).  Unique first ranks are done.  Of equal pairs all but
   the earliest have only repeated strings.  The earliest go on if their first rank is shared.
2. Those are ranked again by blocks of BLOCK neighbouring strings: (hash of the bytes common to
   the block's strings, hash of all its bytes), sorted and judged in the same way.
3. What is left of the blocks is ranked by the full ``length`` bytes of each string.

Ranks are 64-bit hashes of the prefixes, so they need no renumbering between rounds.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; rows with equal
ids are ordered by their text's hash, and rows equal in id and text are one document that stands
in the output as often as in the input; a null id comes after all others; matches never cross
documents; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.tables import released
from panelspark.llm.textscan import add_struct, flat, fresh, mix64, pieces, power_inverse, prefix_hash, span_hash

LENGTH = 100
GRAM = 32
BLOCK = 8
SMALL_ROWS = 500_000       # document keys of at most this many rows (16 bytes each) are broadcast
LAST_ID = 2**63 - 1        # stands for a null id

DUP, ASK = 1, 2            # a run of repeated strings; a run to be ranked further

_RANKED = "k1 long, k2 long, id long, tid long, run long"
_JUDGED = "id long, tid long, run long"


def pack(lo, n, at, kind):
    """A run of n strings that start at lo, lo + 1, ...; ``at``: their anchor less lo."""
    return (lo << 20) | (n << 13) | (at << 6) | kind


def unpack(run):
    return run >> 20, (run >> 13) & 127, (run >> 6) & 127, run & 63


def _anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first string, number of strings, anchor - first string, rank, context rank)."""
    n = len(data)
    if n < length:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    prefix = prefix_hash(data)
    gram = mix64((prefix[GRAM:] - prefix[:-GRAM]) * power_inverse(n - GRAM + 1))
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have < width:                                   # minimum over ``width`` neighbours
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    text = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - length + 1, 0))
    room = np.maximum(np.diff(off) - length + 1, 0)
    p = np.arange(len(text)) - np.repeat(np.cumsum(room) - room, room) + off[:-1][text]
    owner = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.ones(len(p), bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    i = np.flatnonzero(edge)
    count = np.diff(i, append=len(p))
    lo = p[i]
    return text[i], lo - off[:-1][text[i]], count, owner[i] - lo, gram[owner[i]], span_hash(prefix, lo, lo + count - 1 + length)


def _first_round(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, id, tid, run) of every anchor.  Pairs that repeat within a block of texts are
    settled there, so a string that a third of all rows share is not sorted row by row."""
    def run(batches):
        for piece in pieces(batches, "text"):
            ids, tids = piece.column("id").to_numpy(), piece.column("tid").to_numpy()
            text, lo, n, at, k1, k2 = _anchors(*flat(piece.column("text")), length)
            order = np.lexsort((lo, tids[text], ids[text], k2, k1))
            text, lo, n, at, k1, k2 = (x[order] for x in (text, lo, n, at, k1, k2))
            again = np.zeros(len(k1), bool)
            again[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
            # Settled runs pass through the sort under a key of their own.
            k1 = np.where(again, mix64(k1 + np.arange(len(k1), dtype=np.uint64)), k1)
            kind = np.where(again, DUP, ASK)
            yield _ranked(k1, k2, ids[text], tids[text], pack(lo, n, at, kind))

    return docs.mapInArrow(run, _RANKED)


def _ranked(k1, k2, ids, tids, runs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(ids, pa.int64()), pa.array(tids, pa.int64()),
         pa.array(runs.astype(np.int64))], names=["k1", "k2", "id", "tid", "run"])


def judge(ranked: DataFrame, last: bool = False) -> DataFrame:
    """Sort and compare neighbours: DUP for all but the earliest of equal (k1, k2), ASK for the
    earliest ones whose k1 has other k2 (nothing, in the ``last`` round)."""
    def run(batches):
        before: tuple[int, int] | None = None
        pending: tuple | None = None          # the first row of the current k1, until it is asked for
        for batch in batches:
            k1, k2, ids, tids, runs = (batch.column(c).to_numpy() for c in ("k1", "k2", "id", "tid", "run"))
            done = (runs & 63) == DUP
            out = [(ids[done], tids[done], runs[done])]
            k1, k2, ids, tids, runs = (x[~done] for x in (k1, k2, ids, tids, runs))
            if len(k1):
                new1, new2 = np.ones(len(k1), bool), np.ones(len(k1), bool)
                new1[1:] = k1[1:] != k1[:-1]
                new2[1:] = new1[1:] | (k2[1:] != k2[:-1])
                if before is not None:
                    new1[0] = k1[0] != before[0]
                    new2[0] = new1[0] or k2[0] != before[1]
                out.append((ids[~new2], tids[~new2], (runs[~new2] & ~63) | DUP))
                if not last:
                    other = new2 & ~new1
                    group = np.cumsum(new1)
                    shared = np.bincount(group, weights=other, minlength=group[-1] + 1) > 0
                    first = np.flatnonzero(new1)
                    ask = np.sort(np.concatenate([first[shared[group[first]]], np.flatnonzero(other)]))
                    out.append((ids[ask], tids[ask], (runs[ask] & ~63) | ASK))
                    if pending is not None and shared[0]:
                        out.append(tuple(np.array([x]) for x in pending))
                        pending = None
                    if len(first):
                        f = first[-1]
                        pending = None if shared[group[f]] else (ids[f], tids[f], (runs[f] & ~63) | ASK)
                before = (k1[-1], k2[-1])
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "tid", "run"])

    ordered = ranked.repartition("k1").sortWithinPartitions("k1", "k2", "id", "tid", "run")
    return ordered.mapInArrow(run, _JUDGED)


def _by_document(judged: DataFrame) -> DataFrame:
    return judged.groupBy("id", "tid").agg(F.collect_list("run").alias("runs"))


def _only(runs: DataFrame, kind: int) -> DataFrame:
    return runs.select("id", "tid", F.filter("runs", lambda r: r.bitwiseAND(F.lit(63)) == kind).alias("runs")).where(
        F.size("runs") > 0)


def _meet(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, tid, text, runs) of the documents that have runs."""
    if runs.count() <= SMALL_ROWS:
        docs = docs.join(F.broadcast(runs.select("id", "tid")), ["id", "tid"], "left_semi")
    return docs.join(runs, ["id", "tid"])


def _one_each(docs: DataFrame) -> DataFrame:
    """One row per (id, tid), so that no document is compared with its own copies.  Only repeated
    rows are aggregated, copies map-side; the others are not moved."""
    twice = released(docs.groupBy("id", "tid").count().where("count > 1").select("id", "tid"))
    n = twice.count()
    if not n:
        return docs
    some = docs.join(F.broadcast(twice), ["id", "tid"], "left_semi") if n <= SMALL_ROWS else docs
    one = released(some.groupBy("id", "tid").agg(F.first("text").alias("text")))
    if n > SMALL_ROWS:
        return one
    return docs.join(F.broadcast(twice), ["id", "tid"], "left_anti").unionByName(one)


def _next_round(asked: DataFrame, length: int, block: int) -> DataFrame:
    """Rank rows of the asked runs: cut to blocks of ``block`` neighbouring strings, counted from
    the anchor."""
    def run(batches):
        for piece in pieces(batches, "text"):
            data, off = flat(piece.column("text"))
            lists = piece.column("runs")
            count = np.diff(lists.offsets.to_numpy())
            runs = lists.flatten().to_numpy()
            doc = np.repeat(np.arange(piece.num_rows), count)
            lo, n, at, _ = unpack(runs)
            # String p of a run is in block (anchor - p) // block of its anchor.
            each = np.repeat(np.arange(len(runs)), n)
            p = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            anchor = (lo + at)[each]
            slot = (anchor - p) // block
            edge = np.ones(len(p), bool)
            edge[1:] = (each[1:] != each[:-1]) | (slot[1:] != slot[:-1])
            i = np.flatnonzero(edge)
            size, p, anchor, slot, doc = np.diff(i, append=len(p)), p[i], anchor[i], slot[i], doc[each[i]]
            prefix, base = prefix_hash(data), off[:-1][doc]
            core = anchor - slot * block                                   # the last start that the block can have
            k1 = span_hash(prefix, base + core, base + core - block + 1 + length) + slot.astype(np.uint64)
            k2 = span_hash(prefix, base + p, base + p + size - 1 + length)
            ids, tids = piece.column("id").to_numpy()[doc], piece.column("tid").to_numpy()[doc]
            yield _ranked(mix64(k1), k2, ids, tids, pack(p, size, anchor - p, ASK))

    return asked.mapInArrow(run, _RANKED)


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, tid, runs): the packed runs of repeated strings of each document that has any.

    ``docs``: (id, tid, text) with LAST_ID for null ids; equal (id, tid) are one document.
    """
    docs = _one_each(docs)
    first = released(_by_document(judge(_first_round(docs, length))))
    blocks = released(_by_document(judge(_next_round(_meet(docs, _only(first, ASK)), length, BLOCK))))
    strings = judge(_next_round(_meet(docs, _only(blocks, ASK)), length, 1), last=True)
    every = _only(first, DUP).union(_only(blocks, DUP)).union(released(_by_document(strings)))
    return released(every.groupBy("id", "tid").agg(F.flatten(F.collect_list("runs")).alias("runs")))


_CUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                     T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                     T.StructField("kept", T.StringType())])


def _spans(runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal byte ranges that the runs cover."""
    lo, n, _, _ = unpack(np.sort(runs))
    end = np.maximum.accumulate(lo + n - 1 + length)
    edge = np.ones(len(lo), bool)
    edge[1:] = lo[1:] > end[:-1]
    i = np.flatnonzero(edge)
    return lo[i], end[np.append(i[1:], len(lo)) - 1]


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                carry: list[str] | None = None, with_text: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with a struct (n_bytes, n_removed, n_spans, kept_sha256, kept) and its name.

    ``kept``, only ``with_text``, is the text without the removed bytes; characters of which a
    part was removed are dropped from it, so that it is valid UTF-8.
    """
    carry = list(docs.columns if carry is None else carry)
    id_, tid, runs, name = (fresh(c, docs.columns) for c in ("_cut_id", "_cut_tid", "_cut_runs", "cut"))
    keyed = docs.withColumns({id_: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)), tid: F.xxhash64(text)})
    found = repeated_runs(keyed.select(F.col(id_).alias("id"), F.col(tid).alias("tid"), F.col(text).alias("text")), length)
    found = found.select(F.col("id").alias(id_), F.col("tid").alias(tid), F.col("runs").alias(runs))
    keep = [id_, tid, *dict.fromkeys([*carry, text])]

    def make(piece: pa.RecordBatch) -> list[pa.Array]:
        data, off = flat(piece.column(text))
        lists = piece.column(runs)
        out = [[], [], [], [], []]
        for t in range(piece.num_rows):
            body = data[off[t]: off[t + 1]]
            if lists[t].is_valid:
                a, b = _spans(np.asarray(lists[t].values), length)
                mark = np.zeros(len(body) + 1, np.int8)
                mark[a] += 1
                mark[b] -= 1
                kept, removed, spans = body[np.cumsum(mark[:-1]) == 0].tobytes(), int((b - a).sum()), len(a)
            else:
                kept, removed, spans = body.tobytes(), 0, 0
            for to, v in zip(out, (len(body), removed, spans, hashlib.sha256(kept).hexdigest(),
                                   kept.decode("utf-8", "ignore") if with_text else None), strict=True):
                to.append(v)
        return [pa.array(x, pa.int64()) for x in out[:3]] + [pa.array(out[3], pa.string()), pa.array(out[4], pa.string())]

    keyed = keyed.select(*keep)
    if found.count() <= SMALL_ROWS:
        keys = F.broadcast(found.select(id_, tid))
        with_runs = keyed.join(keys, [id_, tid], "left_semi").join(found, [id_, tid])
        without = keyed.join(keys, [id_, tid], "left_anti").withColumn(runs, F.lit(None).cast("array<long>"))
        every = with_runs.unionByName(without)
    else:
        every = keyed.join(found, [id_, tid], "left")
    return add_struct(every, text, _CUT, name, make, [*carry, runs]).drop(runs), name


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated strings cut out of the text; a null text stays null."""
    made, name = cut_repeats(docs, doc_id, text, with_text=True, **options)
    return made.withColumn(text, F.when(F.col(text).isNotNull(), F.col(name)["kept"])).select(*docs.columns)
