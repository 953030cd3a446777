r"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text's set of word shingles is hashed (64 bits a shingle).  Texts with the same set are
   one class, named by a 128-bit digest of the set; the rest works on classes.
2. A signature of BANDS * ROWS min-hashes is banded; classes that share a band are candidates.
   A pair of similarity s shares one with probability 1 - (1 - s**ROWS)**BANDS (0.999995 at 0.8).
3. Candidates of a band are compared with the band's most connected member first, and their
   components formed.  Bands whose members are then in one component need no more pairs; in the
   others, the classes outside of the largest component are compared with all of other components
   that a parity sketch does not rule out.  So a group of n copies costs about n pairs, yet every
   candidate pair is compared, already connected, or ruled out exactly: the xor of the sketches has
   at most as many ones as the sets have shingles that they do not share.
4. A comparison reads the signatures in batches.  After m matches among n hashes, under a uniform
   prior, the posterior probability that the similarity reaches the threshold is
   P(Binomial(n + 1, threshold) <= m); the pair is pruned when that is below ``miss``.
   Survivors are verified exactly on their full shingle sets.
5. Components of the verified links give each document the smallest reachable id.

Words are runs of ``[^\x20\x09-\x0D]`` after lower-casing A-Z; a text of fewer words than a
shingle is one shingle.  Defined cases: texts without words (null, empty, blank) have an empty set
and link with nothing; a row whose id is null joins its group but never names it, and a group
without ids has the component null; equal rows get equal results; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.components import components
from panelspark.llm.tables import released
from panelspark.llm.textscan import NON_SPACE, Words, add_struct, flat, fresh, list_array, mix64, pieces, window_hashes

ROWS, BANDS = 6, 40
BATCH = 40                 # hashes in a verification batch
MISS = 1e-9                # posterior probability at which a pair is given up
FEW_NODES = 60_000         # tables of at most so many classes (176 bytes each at most) are broadcast
SMALL_ROWS = 500_000       # keys of at most this many rows (24 bytes each) are broadcast

_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SIGNED = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()),
                        T.StructField("head", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
                        T.StructField("sig", T.ArrayType(T.ByteType()))])


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, number of each text)."""
    w = Words(*flat(texts), NON_SPACE)
    h = w.hashes()
    whole = window_hashes(h, size)
    out, counts = [], np.zeros(len(w.counts), np.int64)
    for t, (a, n) in enumerate(zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True)):
        if n >= size:
            s = np.sort(whole[a: a + n - size + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            s = window_hashes(h[a: a + n], n) + np.uint64(n)    # the whole sequence as one shingle
        else:
            continue
        out.append(s)
        counts[t] = len(s)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def _digests(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    ends = np.cumsum(counts)
    return [xxhash.xxh3_128_digest(values[e - n: e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def _min_hashes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """ROWS * BANDS x (texts with a set) of 32-bit minima."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((ROWS * BANDS, len(starts)), np.uint32)
    if not len(starts):
        return out
    x = (values >> np.uint64(32)).astype(np.uint32)
    # Blocks of whole texts, small enough to stay in the processor's cache.
    cuts = [0]
    while cuts[-1] < len(starts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + 32768))))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        b = min(b, len(starts))
        part = x[starts[a]: starts[b] if b < len(starts) else len(x)]
        at = starts[a:b] - starts[a]
        for k in range(ROWS * BANDS):
            y = (part ^ _XOR[k]) * _MUL[k]
            out[k, a:b] = np.minimum.reduceat(y, at)
    return out


def _signed(piece: pa.RecordBatch, text: str, size: int) -> list[pa.Array]:
    values, counts = shingle_sets(piece.column(text), size)
    has = counts > 0
    mins = _min_hashes(values, counts)
    bands = np.zeros((BANDS, mins.shape[1]), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            bands[b] += mins[b * ROWS + r].astype(np.uint64) * _BAND[b, r]
        bands[b] = mix64(bands[b] + np.uint64(b))
    sig = np.ascontiguousarray((mins & np.uint32(255)).astype(np.uint8).T).view(np.int8)
    digests = _digests(values, counts)
    return [pa.array(counts, pa.int64()),
            pa.array([d if ok else None for d, ok in zip(digests, has.tolist(), strict=True)], pa.binary()),
            pa.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], pa.int64()),
            list_array(np.ascontiguousarray(bands.T).ravel().view(np.int64), has * BANDS, pa.int64()),
            list_array(sig.ravel(), has * ROWS * BANDS, pa.int8())]


def least_matches(threshold: float, miss: float = MISS, batch: int = BATCH, total: int = ROWS * BANDS) -> list[int]:
    """For n = batch, 2 * batch, ...: the fewest matches with which a pair stays."""
    out = []
    for n in range(batch, total + 1, batch):
        tail = 0.0
        for m in range(n + 1):
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                             + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if tail >= miss:
                out.append(m)
                break
    return out


def _not_pruned(a: str, b: str, threshold: float, miss: float) -> Column:
    """Whether no batch of the signatures ``a`` and ``b`` prunes the pair.  The conditions stand in the
    order of the batches, and a later one is not evaluated after a false one."""
    matches, keep = F.lit(0), F.lit(True)
    for k, least in enumerate(least_matches(threshold, miss)):
        x, y = (F.slice(c, k * BATCH + 1, BATCH) for c in (a, b))
        matches = matches + F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))
        keep = keep & (matches >= least)
    return keep


PARITY = [f"q{i}" for i in range(16)]


def _parity(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of 16 longs a set: bit h of 1024 is 1 if an odd number of shingles fall on it."""
    bits = 64 * len(PARITY)
    where = np.repeat(np.arange(len(counts)), counts) * bits + (values % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(where, minlength=len(counts) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64)


def _parity_fits(percent: int) -> Column:
    """Whether the sets of n and n_b shingles can be similar: at similarity p/100 they differ in
    (n + n_b) * (100 - p) / (100 + p) shingles at most."""
    ones = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in PARITY), F.lit(0))
    return ones * (100 + percent) <= (F.col("n") + F.col("n_b")) * (100 - percent)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, items, parity sketch) of (text): the class and full shingle set of each text."""
    def run(batches):
        for piece in pieces(batches, "text"):
            values, counts = shingle_sets(piece.column("text"), size)
            yield pa.RecordBatch.from_arrays([pa.array(_digests(values, counts), pa.binary()),
                                              list_array(values.view(np.int64), counts, pa.int64()),
                                              *map(pa.array, np.ascontiguousarray(_parity(values, counts).T))],
                                             names=["node", "items", *PARITY])

    return docs.select("text").mapInArrow(run, "node binary, items array<long>, " + ", ".join(f"{c} long" for c in PARITY))


def verify(pairs: DataFrame, info: DataFrame, percent: int, miss: float = MISS) -> DataFrame:
    """The pairs (a, b) that the signatures do not prune and that have 100 * intersection >= percent *
    union of their full sets.  ``info``: (node, sig, items).

    The set of ``b`` travels with the pair to the side of ``a``; a hub ``a`` of many pairs is
    split by AQE's skew join, as both joins stand directly on shuffles.
    """
    left, right = (info.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("items").alias(f"items_{c}"))
                   for c in ("b", "a"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - both
    return (pairs.join(left, "b").join(right, "a").where(_not_pruned("sig_a", "sig_b", percent / 100, miss))
            .where(100 * both >= percent * union).select("a", "b"))


def links(signed: DataFrame, docs: DataFrame, size: int, percent: int, miss: float = MISS) -> tuple[DataFrame, bool]:
    """(node, label), the component of every class that shares a band with another class, and
    whether these are few enough to broadcast.

    ``signed``: (id, tid, n_shingles, cls, head, bands, sig) by document; ``docs``: (id, tid, text).
    """
    has = signed.where(F.col("cls").isNotNull())
    # ``head``: the first 8 bytes of the class digest, so that this aggregate works on longs.
    shared = (has.select(F.explode("bands").alias("key"), "head").groupBy("key")
              .agg(F.min("head").alias("lo"), F.max("head").alias("hi"), F.count(F.lit(1)).alias("rows"))
              .where("lo <> hi").select("key", "rows"))
    member = released(has.select(F.explode("bands").alias("key"), F.col("cls").alias("node")).join(shared, "key").distinct())
    # How connected a class is: the sum of the sizes of its bands.  Hubs are the most connected.
    score = member.groupBy("node").agg(F.sum("rows").alias("score"))
    reps = (has.groupBy(F.col("cls").alias("node"))
            .agg(F.min(F.struct("id", "tid", F.col("n_shingles").alias("n"), "sig")).alias("r")))
    node = released(score.join(reps, "node").select("node", "score", "r.*"))
    few = node.count() <= FEW_NODES

    def by_node(df: DataFrame) -> DataFrame:
        """A table of at most a row a node: broadcast if the nodes are few, else shuffled."""
        return F.broadcast(df) if few else df

    wanted = by_node(node.select(F.col("id").alias("_id"), F.col("tid").alias("_tid")))
    texts = docs.join(wanted, docs["tid"].eqNullSafe(wanted["_tid"]) & docs["id"].eqNullSafe(wanted["_id"]), "left_semi")
    sets = released(_sets(texts, size).dropDuplicates(["node"]).join(by_node(node.select("node", "sig")), "node"))
    info, parity = sets.select("node", "sig", "items"), sets.select("node", *PARITY)
    member = member.select("key", "node")

    def fits(n: str, m: str) -> Column:
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)      # else the sizes rule a link out

    labels = node.select("node", F.col("node").alias("label"))
    # First every band's members against its hub: that connects the members of large groups.
    scored = member.join(by_node(node.select("node", "score", "n")), "node")
    hubs = scored.groupBy("key").agg(F.max(F.struct("score", "node", "n")).alias("h"))
    with_hub = scored.join(hubs, "key").where(F.col("node") != F.col("h.node"))
    star = with_hub.where(fits("n", "h.n")).select(F.col("h.node").alias("a"), F.col("node").alias("b"))
    labels = _merged(labels, released(verify(star.distinct(), info, percent, miss)), by_node)
    # Then, where a band holds several components, the pairs across them: every class outside of the
    # band's largest component against all others.
    rows = member.join(by_node(labels), "node")
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
        F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label")).alias("top"))
    rows = rows.join(sizes.where("labels > 1").select("key", F.col("top.label").alias("top")), "key")
    rows = released(rows.withColumn("minor", F.col("label") != F.col("top")).drop("top")
                    .join(by_node(node.select("node", "n")), "node").join(by_node(parity), "node"))
    other = rows.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "minor", *PARITY)])
    across = (rows.where("minor").join(other, "key")
              .where((F.col("label") != F.col("label_b")) & (~F.col("minor_b") | (F.col("node") < F.col("node_b")))
                     & fits("n", "n_b") & _parity_fits(percent)))
    across = across.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
    return _merged(labels, released(verify(across, info, percent, miss)), by_node), few


def _merged(labels: DataFrame, found: DataFrame, by_node) -> DataFrame:
    """``labels`` with the components joined that the links (a, b) connect."""
    a = by_node(labels.select(F.col("node").alias("a"), F.col("label").alias("x")))
    b = by_node(labels.select(F.col("node").alias("b"), F.col("label").alias("y")))
    edges = found.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = by_node(components(edges, by_node).select(F.col("node").alias("label"), F.col("label").alias("up")))
    return released(labels.join(joined, "label", "left").select("node", F.coalesce("up", "label").alias("label")))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
                miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, tid, label) with one row per document.

    ``tid``: xxhash64 of the text; ``label``: names the group, null for a text without words.
    """
    src = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    made = add_struct(src, "text", _SIGNED, "s", lambda piece: _signed(piece, "text", shingle), ["id", "tid"])
    signed = made.select("id", "tid", "s.*")
    signed = released(signed)
    labels, few = links(signed, src, shingle, percent, miss)
    labels = F.broadcast(labels) if few else labels
    rows = signed.select("id", "tid", "n_shingles", "cls")
    # The smallest id of each class, then of each component; both combine map-side.
    classes = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("id").alias("low"))
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select(
        "cls", "low", F.coalesce("label", "cls").alias("label"))
    groups = named.groupBy("label").agg(F.min("low").alias("component_id"))
    named = named.join(groups, "label").select("cls", "component_id", "label")
    out = rows.join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), "tid", "label")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id (of equal
    rows any one).  Rows without words all stay.

    Only the ids to drop meet the documents again; rows whose id and text repeat, of which one
    must stay, take a path of their own.
    """
    id_, tid = (fresh(c, docs.columns) for c in ("_near_id", "_near_tid"))
    rows = near_groups(docs, doc_id, text, **options).where("label is not null").select(
        F.col("doc_id").alias(id_), F.col("tid").alias(tid), "label")
    rows = released(rows)
    best = rows.groupBy("label").agg(F.min(F.struct(F.col(id_).isNull().alias("last"), id_, tid)).alias("best"))
    per = rows.groupBy(id_, tid, "label").agg(F.count(F.lit(1)).alias("n")).join(best, "label")
    is_best = F.col("best")[id_].eqNullSafe(F.col(id_)) & (F.col("best")[tid] == F.col(tid))
    drop = released(per.where(~is_best).select(id_, tid))
    twice = released(per.where(is_best & (F.col("n") > 1)).select(id_, tid))

    def meets(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys     # 24 bytes a row
        return rows.join(keys, F.xxhash64(rows[text]).eqNullSafe(keys[tid]) & rows[doc_id].eqNullSafe(keys[id_]), how)

    lone = meets(meets(docs, drop, "left_anti"), twice, "left_anti")
    again = meets(docs, twice, "left_semi").withColumn(tid, F.xxhash64(text)).dropDuplicates([doc_id, tid])
    return lone.union(again.select(*docs.columns))
