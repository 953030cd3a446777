"""Prefix trie of conversations: what they share, and what storing each shared turn once saves.

A node is a distinct sequence of first turns (role, text), the root the empty one.  Sequences of
turn digests are range-partitioned and sorted, equal ones by conversation, so a sequence that a
third of all conversations have is spread over partitions as well.  Each partition cuts its rows
into shards of bounded size and writes a shard's trie as balanced parentheses (``parens``):
findclose delimits subtrees, ranks count leaf pairs, cumulative arrays give members and savings.

Nodes on the path of a shard's first or last sequence, its spines, may go on in the neighbouring
shards.  All other nodes are complete and are written; a spine node keeps what hangs below it in
its shard.  The spines, two paths a shard, are sequences again and go through the same step with
these amounts, until they fit one shard.  A node whose parent lies on a spine gets the parent's
conversation at the end, by a join on (shard, parent), which no hot node can swell.

Ids of the conversations that end in a node are hashed where the node is complete; of the two
spine ends of a shard they are passed on as text blocks of 1,024 ids and hashed as a stream.

Digests are the first 128 bits of SHA-256.  Defined cases: null roles and texts count as empty;
turns are ordered by number, null first, equal numbers by role and digest, repeated rows stay;
rows without a conversation id belong to none and are left out; ids are integers; other columns
are ignored; an empty table has no nodes, not even a root.  One conversation is one row of 24
bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelspark.llm.parens import Parens, subtree_mins, subtree_sums
from panelspark.llm.tables import released

SHARD_TURNS = 500_000     # path entries of a shard: about 150 MB in its worker
SHARD_PATHS = 64          # a shard has as many paths at least, so that spines are fewer than paths
BLOCK_IDS = 1024
DIGEST = 16
ROOT = b"\0" * DIGEST
NONE = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").digest()

_L, _B = T.LongType(), T.BinaryType()
STEP = T.StructType([T.StructField(n, t) for n, t in (
    ("digest", _B), ("key", _B), ("size", _L), ("convs", _L), ("low", _L), ("children", _L), ("leaves", _L), ("saved", _L),
    ("ends", _B))])
AMOUNTS = ("convs", "children", "leaves", "saved")
OUT = T.StructType([T.StructField(n, t) for n, t in (
    ("kind", T.StringType()), ("shard", _L), ("key", _B), ("up", _B), ("conv_id", _L), ("depth", _L), ("parent_conv_id", _L),
    ("n_convs", _L), ("n_children", _L), ("n_leaves", _L), ("saved_tokens", _L), ("ends", _B),
    ("path", T.ArrayType(STEP)), ("ids", T.StringType()))])
_ARROW = to_arrow_schema(OUT)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (digest, size)) of a table (conv_id, turn, role, text)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256)), 1, DIGEST)
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return (conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns")))


def spliced(seqs: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % group
    (by nothing where that one is absent); h = crc32(c) % heads.

    The conversations of a group, ``group`` at most, meet in one row: no join.
    """
    near = (seqs.groupBy((F.col("conv_id") - F.col("conv_id") % group).alias("first"))
            .agg(F.collect_list(F.struct("conv_id", "turns")).alias("group")))
    none = F.array().cast(seqs.schema["turns"].dataType)
    base = F.coalesce(F.get(F.filter("group", lambda g: g["conv_id"] == F.col("first")), F.lit(0))["turns"], none)
    rows = near.select(base.alias("base"), F.explode("group").alias("g")).select("base", "g.conv_id", "g.turns")
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return rows.select("conv_id", F.concat(F.slice("base", F.lit(1), h), rest).alias("turns"))


class Shard:
    """The trie of sorted paths, each from the root on.

    ``lens`` and ``digests`` (two 64-bit halves an entry) are the paths.  For the first round
    ``conv`` has the conversation that ends each path; later ``steps`` has the amounts that
    earlier shards left at each entry.
    """

    def __init__(self, lens, digests, sizes, conv=None, steps=None):
        self.lens, self.conv = lens, conv
        start = np.cumsum(lens) - lens
        common = np.minimum(lens[1:], lens[:-1])
        pair = np.repeat(np.arange(len(common)), common)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(common) - common, common)
        differs = (digests[start[1:][pair] + k] != digests[start[:-1][pair] + k]).any(axis=1)
        shared = common.copy()
        np.minimum.at(shared, pair[differs], k[differs])
        shared = np.append(0, shared)                               # leading entries shared with the path before
        new = lens - shared
        counts = np.empty(2 * len(lens) + 1, np.int64)              # closes and opens in turn
        counts[0], counts[-1] = 0, lens[-1]
        counts[2:-1:2] = lens[:-1] - shared[1:]
        counts[1::2] = new
        self.tree = Parens(np.repeat(np.arange(len(counts)) % 2, counts))
        self.n = len(self.tree.opens)
        entry = np.arange(lens.sum()) - np.repeat(start, lens)
        first = np.flatnonzero(entry >= np.repeat(shared, lens))    # the entry that opens each node
        self.digests, self.sizes = digests[first], sizes[first]
        self.end_node = np.cumsum(new) - 1
        self.key: list[bytes | None] = [None] * self.n
        self.ends: list[bytes | None] = [None] * self.n
        self.hidden = {a: np.zeros(self.n, np.int64) for a in AMOUNTS}
        self.low = np.full(self.n, NONE)
        if steps is None:
            np.add.at(self.hidden["convs"], self.end_node, 1)
            np.minimum.at(self.low, self.end_node, conv)
        else:
            self._merge(steps, lens, start, shared, new)
        self._totals()

    def _merge(self, steps, lens, start, shared, new) -> None:
        """Amounts of equal entries of several paths are summed into their node."""
        at = np.empty(lens.sum(), np.int64)
        stack = np.empty(lens.max(), np.int64)
        opened = np.cumsum(new) - new
        for i, n in enumerate(lens):
            stack[shared[i]:n] = np.arange(opened[i], opened[i] + new[i])
            at[start[i]:start[i] + n] = stack[:n]
        for a in AMOUNTS:
            np.add.at(self.hidden[a], at, steps[a])
        np.minimum.at(self.low, at, steps["low"])
        for node, key, ends in zip(at.tolist(), steps["key"], steps["ends"], strict=True):
            self.key[node] = key
            if ends is not None:
                self.ends[node] = ends

    def _totals(self) -> None:
        self.parent, self.end = self.tree.parents(), self.tree.ends()
        self.children = self.hidden["children"] + np.bincount(self.parent[self.parent >= 0], minlength=self.n)
        self.convs = subtree_sums(self.hidden["convs"], self.end)
        self.lowest = subtree_mins(self.low, self.end)
        self.leaves = self.tree.leaf_pairs(self.hidden["children"] == 0) + subtree_sums(self.hidden["leaves"], self.end)
        self.saved = subtree_sums((self.convs - 1) * self.sizes + self.hidden["saved"], self.end)

    def spines(self) -> tuple[np.ndarray, np.ndarray]:
        """The nodes from the root to the ends of the first and of the last path."""
        last = self.end_node[-1]
        return np.arange(self.lens[0]), np.flatnonzero((np.arange(self.n) <= last) & (self.end > last))

    def digest(self, node: int) -> bytes:
        return self.digests[node].tobytes()

    def ids_at(self, node: int) -> np.ndarray:
        """Conversations that end in the node, ascending."""
        a, b = np.searchsorted(self.end_node, [node, node + 1])
        return self.conv[a:b]

    def rows(self, shard: int, last: bool) -> Iterator[pa.RecordBatch]:
        left, right = self.spines()
        on_spine = np.zeros(self.n, bool)
        open_ends: list[int] = []
        if not last:
            on_spine[left] = on_spine[right] = True
            open_ends = sorted({int(left[-1]), int(right[-1])})
        for path in (left, right):
            for above, node in zip([-1, *path[:-1].tolist()], path.tolist(), strict=True):
                if self.key[node] is None:
                    self.key[node] = hashlib.sha256((self.key[above] if above >= 0 else b"") + self.digest(node)).digest()[:DIGEST]
        if self.conv is not None:
            for node in np.unique(self.end_node).tolist():
                if last or node not in open_ends:
                    self.ends[node] = hashlib.sha256(",".join(map(str, self.ids_at(node).tolist())).encode()).digest()
        yield self._nodes(shard, np.flatnonzero(~on_spine), on_spine)
        if self.conv is not None:
            for node in open_ends:
                ids = self.ids_at(node)
                blocks = [ids[i:i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
                yield _batch(len(blocks), kind="ends", shard=shard, key=[self.key[node]] * len(blocks),
                             conv_id=[int(b[0]) for b in blocks], ids=[",".join(map(str, b.tolist())) for b in blocks])
        if not last:
            yield self._paths(shard, left, right, on_spine)

    def _nodes(self, shard, nodes, on_spine) -> pa.RecordBatch:
        parent = self.parent[nodes]
        hangs = (parent >= 0) & on_spine[parent]
        return _batch(
            len(nodes), kind="node", shard=shard, key=[self.key[v] for v in nodes.tolist()],
            up=[self.key[p] if h else None for p, h in zip(parent.tolist(), hangs.tolist(), strict=True)],
            conv_id=self.lowest[nodes], depth=self.tree.depths()[nodes],
            parent_conv_id=pa.array(self.lowest[parent], mask=hangs | (parent < 0)),
            n_convs=self.convs[nodes], n_children=self.children[nodes], n_leaves=self.leaves[nodes],
            saved_tokens=self.saved[nodes], ends=[self.ends[v] for v in nodes.tolist()])

    def _paths(self, shard, left, right, on_spine) -> pa.RecordBatch:
        """Both spines; each node's amounts without the spine nodes below it, and once."""
        here = {a: v.copy() for a, v in self.hidden.items()}
        low = self.low.copy()
        hanging = np.flatnonzero(~on_spine & (self.parent >= 0) & on_spine[self.parent])
        up = self.parent[hanging]
        for a, total in (("convs", self.convs), ("leaves", self.leaves), ("saved", self.saved)):
            np.add.at(here[a], up, total[hanging])
        np.add.at(here["children"], up, 1)
        np.minimum.at(low, up, self.lowest[hanging])
        paths, told = [], set()
        for nodes in ([left, right] if left[-1] != right[-1] else [left]):
            path = []
            for v in nodes.tolist():
                new = v not in told
                told.add(v)
                path.append({"digest": self.digest(v), "key": self.key[v], "size": int(self.sizes[v]),
                             **{a: int(here[a][v]) if new else 0 for a in AMOUNTS}, "low": int(low[v]) if new else NONE,
                             "ends": self.ends[v] if new else None})
            paths.append(path)
        return _batch(len(paths), kind="spine", shard=shard, path=pa.array(paths, _ARROW.field("path").type))


def _batch(n: int, **columns) -> pa.RecordBatch:
    made = []
    for f in _ARROW:
        value = columns.get(f.name)
        if value is None:
            made.append(pa.nulls(n, f.type))
        elif isinstance(value, (str, int)):
            made.append(pa.array([value] * n, f.type))
        else:
            made.append(value if isinstance(value, pa.Array) else pa.array(value, f.type))
    return pa.RecordBatch.from_arrays(made, schema=_ARROW)


def _fixed(col: pa.Array) -> np.ndarray:
    """Digests as rows of two 64-bit halves."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, 2)


def _longs(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64)


def _shard_of(rows: list[pa.RecordBatch]) -> Shard:
    table = pa.Table.from_batches(rows).combine_chunks()
    path = table.column("path").chunk(0)
    lens, steps = _longs(path.value_lengths()), path.flatten()
    field = steps.field
    digests, sizes = _fixed(field("digest")), _longs(field("size"))
    if "conv_id" in table.column_names:
        return Shard(lens, digests, sizes, conv=_longs(table.column("conv_id").chunk(0)))
    amounts = {a: _longs(field(a)) for a in (*AMOUNTS, "low")}
    return Shard(lens, digests, sizes, steps={**amounts, "key": field("key").to_pylist(), "ends": field("ends").to_pylist()})


def _cut(batches: Iterator[pa.RecordBatch], turns: int, paths: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows in blocks of about ``turns`` path entries, but ``paths`` rows at least."""
    held, n_turns, n_paths = [], 0, 0
    for batch in batches:
        sizes = np.append(0, np.cumsum(_longs(batch.column("path").value_lengths())))
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(sizes, sizes[at] + turns - n_turns)), at + paths - n_paths, at + 1)
            to = min(to, batch.num_rows)
            held.append(batch.slice(at, to - at))
            n_turns, n_paths, at = n_turns + int(sizes[to] - sizes[at]), n_paths + to - at, to
            if n_turns >= turns and n_paths >= paths:
                yield held
                held, n_turns, n_paths = [], 0, 0
    if held:
        yield held


def _round(paths: DataFrame, level: int, turns: int, last: bool, least: int) -> DataFrame:
    def run(batches):
        part = TaskContext.get().partitionId()
        whole = (lambda b: [list(b)]) if last else (lambda b: _cut(b, turns, least))
        for i, rows in enumerate(whole(batches)):
            if rows:
                yield from _shard_of(rows).rows((level << 50) + (part << 20) + i, last)

    return paths.mapInArrow(run, OUT)


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined blocks of each key; rows come sorted by key and first id."""
    key, state = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.digest()], pa.binary())], names=["key", "hash"])

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if state:
                    yield out()
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state:
        yield out()


def nodes(seqs: DataFrame, shard_turns: int = SHARD_TURNS, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """One row per node of the trie of (conv_id, turns): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of last turns, over the
    subtree, that members but one need not store), ends (SHA-256 of the ids that end here).
    """
    if shard_paths < 4:
        raise ValueError("a shard leaves two spines, so it must take at least four paths")
    root = F.struct(F.lit(ROOT).alias("digest"), F.lit(0).cast("long").alias("size"))
    paths = (seqs.select("conv_id", F.concat(F.array(root), "turns").alias("path"))
             .withColumn("order", F.transform("path", lambda p: p["digest"]))
             .repartitionByRange("order", "conv_id").sortWithinPartitions("order", "conv_id").select("conv_id", "path"))
    rounds = [released(_round(paths, 0, shard_turns, False, shard_paths))]
    while True:
        spines = rounds[-1].where(F.col("kind") == "spine")
        entries, n_paths = spines.agg(F.sum(F.size("path")), F.count("*")).first()
        if not n_paths:
            break
        parts = n_paths // shard_paths
        last = entries <= shard_turns or parts < 2
        order = F.transform("path", lambda p: p["digest"])
        again = spines.select("path", order.alias("order"))
        again = again.coalesce(1) if last else again.repartitionByRange(parts, "order", "path")
        rounds.append(released(_round(again.sortWithinPartitions("order").select("path"), len(rounds), shard_turns, last, shard_paths)))
    return _joined(rounds)


def _joined(rounds: list[DataFrame]) -> DataFrame:
    facts = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    node = [r.where(F.col("kind") == "node") for r in rounds]
    blocks = rounds[0].where(F.col("kind") == "ends").select("key", "conv_id", "ids")
    hashes = (blocks.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids")
              .mapInArrow(_stream_hashes, "key binary, hash binary"))
    upper = [n.join(hashes, "key", "left").withColumn("ends", F.coalesce("hash", "ends")) for n in node[1:]]
    upper_all = reduce(DataFrame.unionByName, [u.select("key", "conv_id") for u in node[1:]]) if upper else None
    out = []
    for i, n in enumerate([node[0], *upper]):
        out.append(n.where(F.col("up").isNull()).select(*facts))
        if i + 1 < len(rounds):
            pairs = (rounds[i].where(F.col("kind") == "spine").select("shard", F.explode("path.key").alias("key")).distinct())
            parent = (pairs.join(upper_all.withColumnRenamed("conv_id", "above"), "key")
                      .select("shard", F.col("key").alias("up"), "above"))
            hanging = n.where(F.col("up").isNotNull()).drop("parent_conv_id")
            out.append(hanging.join(parent, ["shard", "up"]).withColumnRenamed("above", "parent_conv_id").select(*facts))
    return reduce(DataFrame.unionByName, out).withColumn("ends", F.coalesce("ends", F.lit(EMPTY)))
