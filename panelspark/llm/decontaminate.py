"""Benchmark decontamination: a broadcast hash set of normalised benchmark word windows,
against which every window of every training document is scanned; hits are verified word by
word, and hit spans or documents are removed.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z.  A window is
``n`` consecutive words of an item; an item of fewer words (but not none) is one window.

Defined cases: a null or empty text has no words and no hits; an item without words has no
window; an item whose id is null still marks words as hit but is not listed; repeated items
and documents are judged row by row; an empty benchmark hits nothing.  Extra columns pass
through, and the result column is renamed if its name is taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.textscan import ALNUM, Words, add_struct, flat, fresh, pieces, window_hashes

BLOCK_BYTES = 16 << 20    # window text in one broadcast; a larger benchmark is scanned in blocks
FILTER_BITS = 18

_HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                     T.StructField("end", T.LongType())])))])


def benchmark_windows(benchmark: DataFrame, n: int, item_id: str, item_text: str) -> DataFrame:
    """(item_id string, length, window): the distinct windows of every item."""
    src = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))

    def run(batches):
        for piece in pieces(batches, "text"):
            w = Words(*flat(piece.column("text")), ALNUM)
            ids, out = piece.column("item_id").to_pylist(), ([], [], [])
            for t, count in enumerate(w.counts.tolist()):
                size = min(n, count)
                for i in range(count - size + 1 if count else 0):
                    for to, v in zip(out, (ids[t], size, w.key(int(w.first[t]) + i, size)), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()),
                                              pa.array(out[2], pa.binary()).cast(pa.string())],
                                             names=["item_id", "length", "window"])

    return src.mapInArrow(run, "item_id string, length int, window string").distinct()


class _Index:
    """Window hashes by length, with a bit table before the exact look-up."""

    def __init__(self, rows: list[tuple[str | None, int, str]]):
        self.items: dict[bytes, list[str]] = {}
        by: dict[int, list[bytes]] = {}
        for item, length, window in rows:
            key = window.encode()
            if key not in self.items:
                self.items[key] = []
                by.setdefault(length, []).append(key)
            if item is not None:
                self.items[key].append(item)
        self.tables = {}
        for length, keys in by.items():
            size = np.array([len(k) for k in keys])
            off = np.concatenate([[0], np.cumsum(size)])
            w = Words(np.frombuffer(b"".join(keys), np.uint8), off, ALNUM)
            every = np.sort(window_hashes(w.hashes(), length)[w.first[:-1]])
            table = np.zeros(1 << FILTER_BITS, bool)
            table[(every >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables[length] = (every, table)

    def candidates(self, w: Words):
        """(length, first words of windows whose hash is in the set)."""
        if not len(w):
            return
        h, text = w.hashes(), w.text_of
        for length, (every, table) in self.tables.items():
            got = window_hashes(h, length)
            at = np.flatnonzero(table[(got >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(every, got[at]), len(every) - 1)
            at = at[(every[place] == got[at]) & (text[at] == text[at + length - 1])]
            yield length, at


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", name: str = "hits", carry: list[str] | None = None,
         block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a struct (n_words, n_hit, items, spans) and that column's name.

    ``items``: sorted distinct ids with an occurring window; ``spans``: byte ranges of maximal
    runs of hit words.  The window set is broadcast in blocks of at most ``block_bytes`` of
    window text (measured first); beyond one block, each block scans all documents in turn and
    adds to what the earlier ones found, with a checkpoint in between.
    """
    spark = docs.sparkSession
    wins = benchmark_windows(benchmark, n, item_id, item_text).checkpoint()
    size = wins.agg(F.sum(F.length("window") + F.coalesce(F.length("item_id"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    name = fresh(name, docs.columns)
    carry = list(docs.columns if carry is None else carry)
    out = docs
    for b in range(blocks):
        part = wins if blocks == 1 else wins.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        rows = [tuple(r) for r in part.collect()]        # at most about block_bytes: the bound above
        shared = spark.sparkContext.broadcast(rows)
        step = fresh(f"{name}_{b}", out.columns)
        last = b == blocks - 1
        keep = carry if last else list(dict.fromkeys([*carry, text]))
        before = name if b else None
        made = add_struct(out, text, _HITS, step, _scanner(shared, text, before),
                          [*keep, *([before] if before else [])])
        made = made.drop(name).withColumnRenamed(step, name) if before else made.withColumnRenamed(step, name)
        out = made if last else made.checkpoint()
    return out, name


def _scanner(shared, text: str, before: str | None):
    index: list[_Index] = []

    def make(piece: pa.RecordBatch) -> list[pa.Array]:
        if not index:
            index.append(_Index(shared.value))
        w = Words(*flat(piece.column(text)), ALNUM)
        hit = np.zeros(len(w) + 1, bool)
        items: list[set[str]] = [set() for _ in w.counts]
        if before:
            for t, had in enumerate(piece.column(before).to_pylist()):
                items[t].update(had["items"])
                for s in had["spans"]:
                    at = w.offsets[t]
                    hit[np.searchsorted(w.starts, at + s["start"]): np.searchsorted(w.starts, at + s["end"])] = True
        for length, found in index[0].candidates(w):
            where = np.searchsorted(w.first, found, "right") - 1
            for i, t in zip(found.tolist(), where.tolist(), strict=True):
                ids = index[0].items.get(w.key(i, length))
                if ids is not None:                      # the words are equal, not just the hash
                    hit[i: i + length] = True
                    items[t].update(ids)
        return _fields(w, hit[:-1], items)

    return make


def _fields(w: Words, hit: np.ndarray, items: list[set[str]]) -> list[pa.Array]:
    n_hit = np.concatenate([[0], np.cumsum(hit)])[w.first]
    text = w.text_of
    edge = np.ones(len(hit), bool)
    edge[1:] = ~hit[:-1] | (text[1:] != text[:-1])
    close = np.ones(len(hit), bool)
    close[:-1] = ~hit[1:] | (text[1:] != text[:-1])
    first, final = np.flatnonzero(hit & edge), np.flatnonzero(hit & close)
    owner = text[first] if len(first) else np.empty(0, np.int64)
    base = w.offsets[:-1][owner]
    spans = pa.StructArray.from_arrays([pa.array(w.starts[first] - base, pa.int64()),
                                        pa.array(w.ends[final] - base, pa.int64())], names=["start", "end"])
    off = np.searchsorted(owner, np.arange(len(w.counts) + 1)).astype(np.int32)
    return [pa.array(w.counts, pa.int64()), pa.array(np.diff(n_hit), pa.int64()),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            pa.ListArray.from_arrays(pa.array(off), spans)]


def remove_documents(docs: DataFrame, benchmark: DataFrame, max_hit_share: float = 0.0, **options) -> DataFrame:
    """``docs`` without those of whose words more than ``max_hit_share`` are hit (0: any hit)."""
    found, name = find(docs, benchmark, **options)
    share = F.when(F.col(name)["n_words"] > 0, F.col(name)["n_hit"] / F.col(name)["n_words"]).otherwise(0.0)
    return found.where(share <= max_hit_share).select(*[found[c] for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the hit words, from first to last of each run, cut out of the text."""
    found, name = find(docs, benchmark, text=text, **options)
    raw = F.col(text).cast("binary")
    spans = F.col(name)["spans"]
    # The pieces between spans: from the end of one span to the start of the next.
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
    kept = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")),
                       lambda p: F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")).cast("string"))
    cut = F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(F.col(text))
    return found.withColumn(text, cut).select(*docs.columns)
