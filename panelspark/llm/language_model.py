r"""Language model of any order as a weighted backoff automaton, trained and applied by blocks of text.

Tokens are the words ``[^\x20\x09-\x0D]+`` after lower-casing A-Z, then one end token; a start sign,
never counted as a token, precedes every text.  N-grams of up to ``order`` tokens are counted over all
training texts.  The automaton's states are the seen n-grams shorter than ``order`` that something
follows, and a root.  From state h an arc for a seen n-gram (h, w) has the weight of

    p(w | h) = (c(h, w) + K(h) p(w | h')) / (c(h) + K(h)),    K(h) = STRENGTH * c(h) ** POWER,

a Dirichlet-smoothed estimate whose strength grows with the state as vocabularies do; h' is h
without its first token.  Every other word takes h's failure arc, of weight K(h) / (c(h) + K(h)),
to the state h'.  The root has an arc for every word, of weight

    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

All states sum to one over all words (unknown ones share one place).  After an arc the automaton is in
the longest state that ends the tokens read.  A text is read from left to right; log10 weights are
summed.  As that state is a function of the last ``order - 1`` tokens, the tokens of a block take
their steps together: in each round those whose state lacks the arc follow its failure arc.

No task holds the automaton.  Texts are packed into blocks (documents, word hashes, word numbers).
A block asks for the totals of its distinct n-grams along a tree of exchanges: in each step up to about
256 neighbours' sorted n-grams of one hash range are added up and cut into 256 smaller ranges, so
after log_256(blocks) steps a range holds all counts of its n-grams, and totals go back the same way.
A step sends at most 256 messages a row and a row is never larger than about a block's n-grams, so
messages grow as blocks times the number of steps.  Frequent n-grams are added up on the way; none is
hot.  Most long n-grams stand in one block alone, which has their total then.  So the tree is used
twice: first with hashes cut to a few bits more than it takes to number all n-grams, which tells
those that may stand in several blocks, then with whole hashes and counts for these and all words.
The blocks themselves lie in a bucketed table and are never shuffled; answers come to them.

Defined cases: a null or empty text has the end token only; equal rows are separate texts; a row
whose id is null is trained on as the text 'null' decides; with no training text every weight is
that of an unseen word; an empty table gives no rows; an order of one leaves the root alone; an order
below one is refused.  All hashes have 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tables import bucketed, discard, released
from panelspark.llm.textscan import NON_SPACE, Words, flat, mix64, pieces
from panelspark.session import scratch_path

ORDER = 3
STRENGTH, POWER = 2.0, 0.75
FAN_BITS = 8
BLOCKS_PER_BUCKET, MAX_BUCKETS = 2, 50_000
SPARE_BITS = 6                           # of a cut hash: one in 2**SPARE_BITS meets another n-gram
END = np.uint64(0x5851F42D4C957F2D)      # the end token's hash
START = np.uint64(0x14057B7EF767814F)    # the sign before a text
BLOCK_BYTES = 5 << 20

_FACTOR, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
_BLOCK = "block long, ids array<long>, held array<boolean>, counts binary, vocabulary binary, words binary, tokens long, train_tokens long"
_UP = "node long, range long, child long, sub int, keys binary, counts binary"
_DOWN = "child long, sub int, totals binary"
_NODE = "id long, node long, range long, keys binary, counts binary, children array<struct<child:long,sub:int,place:binary>>"


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an integer array, planes of equal significance together, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def stretch(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=np.uint64(0)))


def stretch_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(stretch(raw, np.uint64), dtype=np.uint64)


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in names.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)],
                                      names=[n for n, _ in fields])


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The texts of (id, held, text) as rows of about ``block_bytes``: word numbers into the block's
    vocabulary of sorted word hashes.  The end token closes every text."""
    def run(batches):
        for piece in pieces(batches, "text", block_bytes):
            hashes, counts = [], []
            for part in pieces(iter([piece]), "text"):
                w = Words(*flat(part.column("text")), NON_SPACE)
                hashes.append(np.insert(w.hashes(), w.first[1:], END))     # an end token after each text's words
                counts.append(w.counts + 1)
            token, count = np.concatenate(hashes), np.concatenate(counts)
            words, number = np.unique(token, return_inverse=True)
            held = piece.column("held").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([
                pa.array([0]), pa.array([piece.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()]),
                pa.array([squeeze(count.astype(np.int32))]), pa.array([squeeze_sorted(words)]),
                pa.array([squeeze(number.astype(np.uint32))]), pa.array([int(count.sum())]), pa.array([int(count[~held].sum())])],
                names=["block", "ids", "held", "counts", "vocabulary", "words", "tokens", "train_tokens"])

    # A block's number comes from its task's input, so a task that runs again gives the same ones.
    return docs.mapInArrow(run, _BLOCK).withColumn("block", F.monotonically_increasing_id())


class Block:
    """An unpacked block.  By order k (index k - 1): ``sizes`` the numbers of distinct n-grams, ``of`` each token's n-gram, ``context`` and ``suffix`` the n-grams without their last and first
    token (context -1: the start sign).  ``by_key`` orders all orders' n-grams by hash, as ``all_keys``
    and ``own``, their training counts here, stand.

    A unigram's hash is odd, a longer one's even.  The token at place p of its text ends n-grams of up
    to p + 2 signs, the start sign among them.
    """

    def __init__(self, row: dict, order: int):
        self.count = stretch(row["counts"], np.int32).astype(np.int64)
        words = stretch_sorted(row["vocabulary"])
        number = stretch(row["words"], np.uint32).astype(np.int32)
        self.first = np.cumsum(self.count) - self.count
        self.place = np.arange(len(number), dtype=np.int32) - np.repeat(self.first.astype(np.int32), self.count)
        train = np.repeat(~np.asarray(row["held"], bool), self.count)
        self.end = int(np.searchsorted(words, END))
        self.keys, self.of, self.context, self.suffix = [words | _ONE], [number], [None], [None]
        own = [np.bincount(number[train], minlength=len(words))]
        word, last = words[number], (words | _ONE)[number]
        for k in range(2, order + 1):
            before = np.empty_like(last)
            before[1:] = last[:-1]
            before[self.first] = START
            last = mix64((before + np.uint64(k)) * _FACTOR + word) & ~_ONE
            at = np.flatnonzero(self.place >= k - 2)
            keys, gram = np.unique(last[at], return_inverse=True)
            gram = gram.astype(np.int32)
            some = np.empty(len(keys), np.int32)              # a token that ends the n-gram
            some[gram] = at
            of = np.full(len(last), -1, np.int32)
            of[at] = gram
            self.keys.append(keys)
            self.of.append(of)
            self.context.append(np.where(self.place[some] > 0, self.of[k - 2][some - 1], np.int32(-1)))
            self.suffix.append(self.of[k - 2][some])
            own.append(np.bincount(gram[train[at]], minlength=len(keys)))
        self.sizes = [len(k) for k in self.keys]
        self.all_keys, own = np.concatenate(self.keys), np.concatenate(own)
        del self.keys, word, last, train
        self.by_key = np.argsort(self.all_keys).astype(np.int32)
        self.all_keys, self.own = self.all_keys[self.by_key], own[self.by_key]

    def asked(self, shared: np.ndarray) -> np.ndarray:
        """The n-grams, by hash, whose totals other blocks may add to, and all unigrams."""
        return np.flatnonzero(shared | (self.all_keys & _ONE > 0))

    def totals(self, shared: np.ndarray, told: np.ndarray) -> list[np.ndarray]:
        """The training totals by order."""
        total = self.own.copy()
        total[self.asked(shared)] = told
        out = np.empty_like(total)
        out[self.by_key] = total
        return np.split(out, np.cumsum(self.sizes)[:-1])


def _shared(row: dict, b: Block) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(row["shared"]), np.uint8), count=len(b.all_keys)).astype(bool)


def _told(parts: list[dict] | None) -> np.ndarray:
    """The answers' parts in the order of their hash ranges."""
    parts = sorted(parts or (), key=lambda x: x["sub"])
    return np.concatenate([stretch(x["totals"], np.int64) for x in parts]) if parts else np.empty(0, np.int64)


def _send(child: int, node: int, span: int, keys: np.ndarray, counts: np.ndarray, level: int, bits: int) -> pa.RecordBatch:
    """A row's keys cut into the smaller hash ranges of ``level``."""
    fan = 1 << bits
    sub = (keys >> np.uint64(64 - level * bits)) & np.uint64(fan - 1)
    cuts = np.searchsorted(sub, np.arange(fan + 1, dtype=np.uint64))
    return _batch([(node, span * fan + j, child, j, squeeze_sorted(keys[a:z]), squeeze(counts[a:z].astype(np.int64)))
                   for j, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if z > a], _UP)


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """One group: its distinct keys, their counts (twice the sum, plus one if in several blocks), and
    each child's places among them."""
    keys = [stretch_sorted(k) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([stretch(c, np.int64) for c in table.column("counts").to_pylist()])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=counts >> 1, minlength=len(distinct)).astype(np.int64)
    several = np.bincount(place, weights=1 + (counts & 1), minlength=len(distinct)) > 1
    places = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
    return distinct, total * 2 + several, list(zip(
        table.column("child").to_pylist(), table.column("sub").to_pylist(), places, strict=True))


def _exchange(asked: DataFrame, levels: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The answers (child, sub, totals) to the questions of the lowest level, and the table with the
    number of seen unigrams."""
    fan, steps = 1 << bits, []

    def add(level):
        def run(table):
            keys, counts, children = _added(table)
            node, span = table.column("node")[0].as_py(), table.column("range")[0].as_py()
            return pa.table({
                "id": pa.array([node * fan ** level + span], pa.int64()), "node": pa.array([node // fan], pa.int64()),
                "range": pa.array([span], pa.int64()), "keys": pa.array([squeeze_sorted(keys)], pa.binary()),
                "counts": pa.array([squeeze(counts)], pa.binary()),
                "children": pa.array([[{"child": c, "sub": s, "place": squeeze(p.astype(np.uint32))} for c, s, p in children]],
                                     pa.list_(pa.struct([("child", pa.int64()), ("sub", pa.int32()), ("place", pa.binary())])))})
        return run

    def further(level):
        def run(batches):
            for r in _rows(batches):
                yield _send(r["id"], r["node"], r["range"], stretch_sorted(r["keys"]), stretch(r["counts"], np.int64), level, bits)
        return run

    def last(table):
        keys, counts, children = _added(table)
        seen = int(((keys & _ONE > 0) & (counts > 1)).sum())
        out = pa.Table.from_batches([_batch([(c, s, squeeze(counts[p])) for c, s, p in children], _DOWN)])
        return out.append_column("seen", pa.array([seen] + [0] * (len(children) - 1), pa.int64()))

    def back(batches):
        for r in _rows(batches):
            told = _told(r["parts"])
            yield _batch([(c["child"], c["sub"], squeeze(told[stretch(c["place"], np.uint32)])) for c in r["children"]], _DOWN)

    for level in range(1, levels):
        steps.append(released(asked.groupBy("node", "range").applyInArrow(add(level), _NODE)))
        asked = steps[-1].select("id", "node", "range", "keys", "counts").mapInArrow(further(level + 1), _UP)
    top = released(asked.groupBy("node", "range").applyInArrow(last, f"{_DOWN}, seen long"))
    answers = top.select("child", "sub", "totals")
    for step in reversed(steps):
        answers = step.select("id", "children").join(_parts(answers), F.col("id") == F.col("child")).mapInArrow(back, _DOWN)
    return answers, top


def _parts(answers: DataFrame, buckets: int | None = None) -> DataFrame:
    """The answers of a row together: one a smaller range, so at most the fan-out."""
    if buckets:
        answers = answers.repartition(buckets, "child")
    return answers.groupBy("child").agg(F.collect_list(F.struct("sub", "totals")).alias("parts"))


def _first_node(block: int, levels: int, bits: int) -> int:
    return int(mix64(np.array([block], np.uint64))[0]) % (1 << bits * (levels - 1))


def _ask_shared(blocks: DataFrame, order: int, width: int, levels: int, bits: int) -> DataFrame:
    """All n-grams' hashes cut to ``width`` bits, as rows of the first exchange."""
    kept = np.uint64((1 << 64) - (1 << (64 - width)))

    def run(batches):
        for row in _rows(batches):
            keys = Block(row, order).all_keys & kept
            yield _send(row["block"], _first_node(row["block"], levels, bits), 0, keys, np.zeros(len(keys), np.int64), 1, bits)

    return blocks.mapInArrow(run, _UP)


def _marked(told: DataFrame) -> DataFrame:
    """The blocks with ``shared``: a bit for each n-gram, by hash, that may stand in several blocks."""
    names = [*(f.split(" ")[0] for f in _BLOCK.split(", ")), "shared"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                bits = np.packbits(_told(row.column("parts").to_pylist()[0]).astype(np.uint8) & 1)
                made = pa.array([zstandard.compress(bits.tobytes(), 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in names[:-1]), made], names=names)

    return told.mapInArrow(run, f"{_BLOCK}, shared binary")


def _ask_totals(blocks: DataFrame, order: int, levels: int, bits: int) -> DataFrame:
    """The asked n-grams with their counts here, as rows of the first exchange."""
    def run(batches):
        for row in _rows(batches):
            b = Block(row, order)
            at = b.asked(_shared(row, b))
            yield _send(row["block"], _first_node(row["block"], levels, bits), 0, b.all_keys[at], b.own[at] * 2, 1, bits)

    return blocks.mapInArrow(run, _UP)


class Automaton:
    """The part of the automaton that a block's texts can reach.

    By order k (index k - 1), for each n-gram (h, w) of the block: ``seen`` whether state h has an arc
    for w, ``arc`` the arc's log10 weight (at the root: every word's), and ``fail`` that of h's failure
    arc; 0 where h is no state, as the automaton then stands in h' already.
    """

    def __init__(self, b: Block, counts: list[np.ndarray], n: int, v: int, strength: float, power: float):
        weight = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
        starts = counts[0][b.end] if len(counts[0]) else 0     # training texts: one start and one end each
        self.seen, self.arc, self.fail = [counts[0] > 0], [np.log10(weight)], [None]
        for k in range(2, len(counts) + 1):
            context = b.context[k - 1]
            of_state = np.where(context >= 0, counts[k - 2][context], starts).astype(float)
            back = strength * of_state ** power
            total = np.where(of_state > 0, of_state + back, 1.0)
            fail = np.where(of_state > 0, back / total, 1.0)
            weight = counts[k - 1] / total + fail * weight[b.suffix[k - 1]]
            self.seen.append(counts[k - 1] > 0)
            self.arc.append(np.log10(weight))
            self.fail.append(np.log10(fail))

    def walk(self, b: Block) -> np.ndarray:
        """The log10 weights of each token's path: failure arcs, then the arc that reads it."""
        out = np.zeros(len(b.place))
        waiting = np.arange(len(b.place))
        for k in range(len(self.arc), 1, -1):
            here = b.place[waiting] >= k - 2                    # later states of a text only
            at = waiting[here]
            gram = b.of[k - 1][at]
            reads = self.seen[k - 1][gram]
            out[at] += np.where(reads, self.arc[k - 1][gram], self.fail[k - 1][gram])
            here[here] = reads
            waiting = waiting[~here]
        out[waiting] += self.arc[0][b.of[0][waiting]]
        return out


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, strength: float = STRENGTH,
          power: float = POWER, block_bytes: int = BLOCK_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) by document."""
    if order < 1:
        raise ValueError(f"order {order}: a model needs n-grams of one token at least")
    named = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    src = docs.select(F.col(doc_id).cast("long").alias("id"), (F.crc32(named) % 5 == 1).alias("held"),
                      F.col(text).alias("text"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(max(1, -(-size // (block_bytes * BLOCKS_PER_BUCKET))), MAX_BUCKETS)
    plain, marked = scratch_path(docs.sparkSession, "blocks"), scratch_path(docs.sparkSession, "marked")
    blocks = bucketed(text_blocks(src, block_bytes), "block", buckets, plain)
    n_blocks, tokens, n = blocks.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "train_tokens"))).first()
    levels = 1
    while (1 << fan_bits) ** levels < n_blocks:
        levels += 1
    width = min(64, int(tokens * order).bit_length() + SPARE_BITS)
    answers, _ = _exchange(_ask_shared(blocks, order, width, levels, fan_bits), levels, fan_bits)
    told = blocks.join(_parts(answers, buckets), F.col("block") == F.col("child")).drop("child")
    blocks = bucketed(_marked(told), "block", buckets, marked)
    discard(docs.sparkSession, plain)
    answers, top = _exchange(_ask_totals(blocks, order, levels, fan_bits), levels, fan_bits)
    v = top.agg(F.sum("seen")).first()[0] or 0
    told = blocks.join(_parts(answers, buckets), F.col("block") == F.col("child")).drop("child")

    def run(batches):
        for row in _rows(batches):
            b = Block(row, order)
            counts = b.totals(_shared(row, b), _told(row.pop("parts")) >> 1)
            del b.all_keys, b.own, b.by_key
            model = Automaton(b, counts, n, v, strength, power)
            by_text = lambda x: np.add.reduceat(x, b.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.count),
                 pa.array(by_text(model.seen[0][b.of[0]].astype(np.int64))), pa.array(np.full(len(b.count), n, np.int64)),
                 pa.array(by_text(model.arc[0][b.of[0]])), pa.array(by_text(model.walk(b)))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return told.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
