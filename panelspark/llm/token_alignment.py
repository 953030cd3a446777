"""Alignment of two tokenizers: byte groups, links of overlapping tokens, corpus-wide link counts.

Both tokenizers see the text with one space before it.  Cumulative byte ends of the tokens of
either side go into a dictionary end -> index; the ends that both have, sorted, slice the two id
lists into groups, and within a slice every pair of tokens whose byte ranges overlap is a link.

A text is cut before each space that follows a non-space: neither the byte-level pre-tokeniser
nor the piece vocabulary (checked when it is loaded) joins characters across such a cut, so both
sides have a token end there and the pieces align on their own.  Workers keep the alignments of
pieces, so a repeated piece is encoded once as long as it is kept; the store is emptied when it
is full.  It only saves time.

Counts of id pairs need all documents.  Every task writes its documents' links and adds up their
pairs, and Spark sums those by pair; a pair is the number a_id * (size of B's vocabulary) + b_id.
A document then needs the counts of its own links: pairs frequent enough to fit a table of
``table_size`` entries are broadcast, the others, rare by choice, are joined by a shuffle.

Defined cases: a text that is null or empty, or whose tokens do not spell it (it holds the piece
vocabulary's own space mark, say), has no tokens: zeros, and it counts nowhere.  Special strings
are plain text.  Every other column passes through; equal rows each count; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelspark.llm.tables import released
from panelspark.llm.textscan import flat, fresh, pieces
from panelspark.llm.token_counts import resolve

TABLE_SIZE = 1 << 20      # pairs in the broadcast table: 17 MB
STORE_PIECES = 500_000    # pieces whose alignment a worker keeps
STORE_BYTES = 64 << 20    # and bytes of their group texts
BUCKETS = 8               # of counts, for each doubling
MARK = "▁"

_CUT = re.compile(r"(?<=\S) ")
_ODD = re.compile(r"(?:\A|\s) ")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def cut(text: str) -> list[str]:
    """Pieces of " " + text; each stands for itself with one space before."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


def align(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group ends in A, group ends in B, A token of each link, B token of each link) of two
    tokenizations of the same bytes; all are token numbers, the ends exclusive.

    Within a slice two tokens overlap up to the nearer of their ends, so every distinct end of a
    slice closes one link.
    """
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    a_at = dict(zip(a_end.tolist(), range(1, len(a_end) + 1), strict=True))
    b_at = dict(zip(b_end.tolist(), range(1, len(b_end) + 1), strict=True))
    common = sorted(a_at.keys() & b_at.keys())
    to_a = np.fromiter(map(a_at.__getitem__, common), np.int64, len(common))
    to_b = np.fromiter(map(b_at.__getitem__, common), np.int64, len(common))
    ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")      # two sorted runs
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    return to_a, to_b, np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, the
    others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Side:
    """One tokenizer: ids of " " + text, and every id's bytes; ``run`` words are encoded at a time."""

    def __init__(self, encode, spelled: list[bytes], run: int):
        self.encode, self.spelled, self.run = encode, spelled, run
        self.lengths = np.array([len(b) for b in spelled])
        self.opens = np.array([b[:1] == b" " for b in spelled])
        # What an id looks like in a group's text: before another of its side, and last of its side.
        self.inner = np.array([b"%d," % i for i in range(len(spelled))], object)

    def last(self, mark: bytes) -> np.ndarray:
        return np.array([b"%d%s" % (i, mark) for i in range(len(self.spelled))], object)

    def spell(self, ids) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, first id of each word) of words without a space, encoded as runs of text, in which one
        token of each word opens with a space, its first; None if the tokens do not spell the words."""
        runs = [" ".join(words[i:i + self.run]) for i in range(0, len(words), self.run)]
        found = list(chain.from_iterable(map(self.encode, runs)))
        ids = np.array(found, np.int64)
        first = np.flatnonzero(self.opens[ids])
        fits = len(first) == len(words) and self.spell(found) == "".join([" " + r for r in runs]).encode()
        return (ids, first) if fits else None


def byte_level(name: str) -> Side:
    """A tokenizers .json file with byte-level BPE."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(resolve(name))
    tok.encode_special_tokens = True
    letters = _byte_letters()
    spelled = [b""] * tok.get_vocab_size()
    for token, i in tok.get_vocab().items():
        if all(c in letters for c in token):
            spelled[i] = bytes(letters[c] for c in token)
    return Side(lambda text: tok.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, spelled, 1 << 14)


def sentence_piece(name: str) -> Side:
    """A sentencepiece .model file, which adds the space itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=resolve(name))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in names):
        raise ValueError(f"{name} has pieces that go on after a space")
    spelled = []
    for i, p in enumerate(names):
        byte = _BYTE.fullmatch(p) if model.is_byte(i) else None
        spelled.append(bytes([int(byte[1], 16)]) if byte else b"" if model.is_control(i) else p.replace(MARK, " ").encode())
    space = model.piece_to_id(MARK)
    # Its time for a text grows faster than the text.
    return Side(lambda text: model.encode(text) if text else [space], spelled, 1 << 7)


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind=np.int64):
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, values) -> None:
        to = self.n + len(values)
        if to > len(self.held):
            self.held = np.concatenate([self.held[:self.n], np.zeros(max(to, 2 * self.n) - self.n, self.held.dtype)])
        self.held[self.n:to] = values
        self.n = to

    @property
    def all(self) -> np.ndarray:
        return self.held[:self.n]


class PieceStore:
    """Alignments of pieces by number: sizes, links, and the text of the groups, each with a ; after it."""

    def __init__(self, a: Side, b: Side, limit: int = STORE_PIECES, limit_bytes: int = STORE_BYTES):
        self.a, self.b, self.limit, self.limit_bytes = a, b, limit, limit_bytes
        self.bar, self.semicolon = a.last(b"|"), b.last(b";")
        self.empty()

    def empty(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.bytes = 0
        self.sizes = {f: Grown() for f in ("n_a", "n_b", "n_groups", "n_links")}
        self.bad, self.links = Grown(bool), Grown()
        self.first = Grown()                   # number of each piece's first link
        self.generation = uuid.uuid4().hex

    def learn(self, found: list[list[str]]) -> set[str]:
        """Pieces of these texts that are not kept yet."""
        return set(chain.from_iterable(found)).difference(self.number)

    def full(self, new: set[str]) -> bool:
        return bool(self.number) and (len(self.number) + len(new) > self.limit or self.bytes > self.limit_bytes)

    def add(self, new: set[str]) -> None:
        plain = [p for p in new if p and " " not in p and MARK not in p and not p[-1].isspace()]
        joined = [side.joined(plain) for side in (self.a, self.b)] if plain else [None, None]
        if None not in joined:
            self._align(plain, *joined[0], *joined[1])
            new = new.difference(plain)
        alone, bad, a_ids, b_ids = [], [], [], []
        for p in new:
            ids = ([], []) if MARK in p else (self.a.encode(p), self.b.encode(p))
            want = b" " + p.encode()
            if self.a.spell(ids[0]) == want and self.b.spell(ids[1]) == want:
                alone.append(p)
                a_ids.append(ids[0])
                b_ids.append(ids[1])
            else:
                bad.append(p)
        if alone:
            flat = [x for ids in (a_ids, b_ids) for x in (
                np.fromiter(chain.from_iterable(ids), np.int64), np.cumsum([0, *map(len, ids[:-1])]))]
            self._align(alone, *flat)
        self._keep(bad, [b""] * len(bad), np.zeros((4, len(bad)), np.int64), np.zeros(0, np.int64), True)

    def _align(self, new: list[str], a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray) -> None:
        """Aligns pieces whose ids follow each other, as one run of bytes: every piece's end is a common one."""
        to_a, to_b, link_a, link_b = align(self.a.lengths[a], self.b.lengths[b])
        # A group's A ids stand before its B ids, so an id's place is known from the group it is in.
        a_group, b_group = np.searchsorted(to_a, np.arange(len(a)), "right"), np.searchsorted(to_b, np.arange(len(b)), "right")
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + np.append(0, to_b)[a_group]] = self._shown(self.a, a, to_a, self.bar)
        shown[np.arange(len(b)) + to_a[b_group]] = self._shown(self.b, b, to_b, self.semicolon)
        a_to, b_to = np.append(a_first[1:], len(a)), np.append(b_first[1:], len(b))
        at = [0, *(a_to + b_to).tolist()]
        shown = shown.tolist()
        texts = [b"".join(shown[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        totals = np.stack([a_to, b_to, np.searchsorted(to_a, a_to, "right"), np.searchsorted(link_a, a_to)])
        self._keep(new, texts, np.diff(totals, prepend=0), a[link_a] * len(self.b.spelled) + b[link_b], False)

    @staticmethod
    def _shown(side: Side, ids: np.ndarray, to: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = side.inner[ids]
        out[to - 1] = last[ids[to - 1]]
        return out

    def _keep(self, new: list[str], texts: list[bytes], sizes: np.ndarray, links: np.ndarray, bad: bool) -> None:
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.texts += texts
        self.bytes += sum(map(len, texts)) + links.nbytes
        self.first.add(self.links.n + np.cumsum(sizes[3]) - sizes[3])
        self.links.add(links)
        self.bad.add(np.full(len(new), bad))
        for f, values in zip(self.sizes, sizes, strict=True):
            self.sizes[f].add(values)

    def spans(self) -> np.ndarray:
        return np.append(self.first.all, self.links.n)


_stores: dict[tuple, PieceStore] = {}


def _store(a: str, b: str, limit: int) -> PieceStore:
    """This worker's store for the two tokenizers; tasks of later steps find it filled."""
    if (a, b, limit) not in _stores:
        _stores.clear()
        _stores[a, b, limit] = PieceStore(byte_level(a), sentence_piece(b), limit)
    return _stores[a, b, limit]


def _numbers(store: PieceStore, column: pa.Array, before_empty=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece numbers of all texts, first piece of each text, whether a text is spelled by its tokens)."""
    found = [cut(t) if t else [] for t in column.to_pylist()]
    new = store.learn(found)
    if store.full(new):
        if before_empty:
            before_empty()
        store.empty()
        new = store.learn(found)
    store.add(new)
    counts = np.fromiter(map(len, found), np.int64, len(found))
    numbers = np.fromiter(map(store.number.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
    first = np.append(0, np.cumsum(counts))
    return numbers, first, (counts > 0) & (_sums(store.bad.all[numbers], first) == 0)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[first[1:]] - total[first[:-1]]


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + counts[i] - 1, one span after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


_SIZES = ("n_a", "n_b", "n_groups", "n_links")
_DOC = T.StructType([*[T.StructField(f, T.LongType()) for f in _SIZES], T.StructField("groups_sha256", T.StringType()),
                     T.StructField("groups", T.StringType()), T.StructField("links", T.BinaryType()),
                     T.StructField("row", T.StringType())])


def aligned(docs: DataFrame, a: str, b: str, text: str = "text", carry: list[str] | None = None, with_groups: bool = False,
            store_pieces: int = STORE_PIECES) -> tuple[DataFrame, int]:
    """(one table with a row for each document and rows of pair counts, the base of pairs).

    A document's row has ``held``, a struct of its ``carry`` columns, and ``doc``: sizes, the hash (and
    text) of its groups, its links packed in order and a name of the row.  The others have ``pair``
    and ``n``: how many links of a task's documents hold the pair.  One pass makes both, as a text
    is encoded only here.
    """
    carry = docs.columns if carry is None else carry
    held = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in carry])
    schema = T.StructType([T.StructField("held", held), T.StructField("doc", _DOC), T.StructField("pair", T.LongType()),
                           T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)
    base = len(sentence_piece(b).spelled)
    packed = np.uint32 if len(byte_level(a).spelled) * base < 1 << 32 else np.int64

    def run(batches):
        store = _store(a, b, store_pieces)
        seen = np.zeros(0, np.int64)
        task = TaskContext.get().partitionId()

        def totals():
            used = np.flatnonzero(seen)
            spans = store.spans()
            counts = np.diff(spans)[used]
            pairs, inverse = np.unique(store.links.all[_gather(spans[used], counts)], return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, inverse, np.repeat(seen[used], counts))
            nulls = [pa.nulls(len(pairs), arrow.field(f).type) for f in ("held", "doc")]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(pairs, pa.int64()), pa.array(n)], schema=arrow)

        for piece in pieces(batches, text):
            emptied = []
            numbers, first, fits = _numbers(store, piece.column(text), lambda out=emptied: out.append(totals()))
            if emptied:
                yield from emptied
                seen = np.zeros(0, np.int64)
            grown = np.bincount(numbers[np.repeat(fits, np.diff(first))], minlength=len(store.texts))
            grown[:len(seen)] += seen
            seen = grown
            rows, spans = piece.num_rows, store.spans()
            per_piece = np.where(np.repeat(fits, np.diff(first)), np.diff(spans)[numbers], 0)
            links = store.links.all[_gather(spans[numbers], per_piece)].astype(packed)
            ends = np.append(0, np.cumsum(per_piece))[first] * links.itemsize
            hashes, texts, shown = [], [], numbers.tolist()
            for i in range(rows):
                groups = b"".join(map(store.texts.__getitem__, shown[first[i]:first[i + 1]]))[:-1] if fits[i] else b""
                hashes.append(hashlib.sha256(groups).hexdigest() if fits[i] else "")
                texts.append(groups.decode() if with_groups else None)
            made = [pa.array(np.where(fits, _sums(store.sizes[f].all[numbers], first), 0)) for f in _SIZES]
            name = uuid.uuid4().hex[:12]
            made += [pa.array(hashes, pa.string()), pa.array(texts, pa.string()),
                     pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(links)]).cast(pa.binary()),
                     pa.array([f"{task}-{name}-{i}" for i in range(rows)])]
            kept = pa.StructArray.from_arrays([piece.column(c).cast(arrow.field("held").type.field(c).type) for c in carry],
                                              fields=list(arrow.field("held").type))
            doc = pa.StructArray.from_arrays(made, fields=list(arrow.field("doc").type))
            yield pa.RecordBatch.from_arrays([kept, doc, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], schema=arrow)
        if seen.any():
            yield totals()

    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema), base


def link_counts(table: DataFrame, base: int) -> DataFrame:
    """(pair, n, best) of what ``aligned`` wrote: how many links hold each id pair, and whether no pair of its b id has more."""
    counts = released(table.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("n")))
    side = (F.col("pair") % base).alias("b")
    top = counts.groupBy(side).agg(F.max("n").alias("top"))      # a row for each b id: the vocabulary bounds it
    return (counts.withColumn("b", side).join(F.broadcast(top), "b")
            .select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def frequent(counts: DataFrame, table_size: int = TABLE_SIZE) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(least count, sorted pairs with their counts and flags): as many whole count buckets, from the
    largest on, as fit the table."""
    bucket = F.floor(F.log2(F.col("n").cast("double")) * BUCKETS)
    sizes = counts.groupBy(bucket.alias("k")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()
    room, least = table_size, None
    for r in sorted(sizes, key=lambda r: -r["k"]):
        room -= r["rows"]
        if room < 0:
            break
        least = r["least"]
    if least is None:
        return 2**62, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    got = counts.where(F.col("n") >= least).toArrow()
    pair, n, best = (got.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return least, (pair[order], n[order], best[order])


def _looked_up(rows: DataFrame, shared, packed: type) -> DataFrame:
    """``rows`` with count_sum and n_best over the links that the broadcast table answers, and the other
    pairs with how often the document links them."""
    added = T.StructType([T.StructField("count_sum", T.LongType()), T.StructField("n_best", T.LongType()),
                          T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("rare_n", T.ArrayType(T.LongType()))])

    def run(batches):
        _stores.clear()               # a store of the step before is of no use here
        pair, n, best = shared.value
        for batch in pieces(batches, "links"):
            col = batch.column("links")
            data, off = flat(col)
            links = np.frombuffer(data.tobytes(), packed).astype(np.int64)
            first = off // np.dtype(packed).itemsize
            hit = np.zeros(len(links), bool)
            count_sum = n_best = np.zeros(len(col), np.int64)
            if len(pair):
                at = np.minimum(np.searchsorted(pair, links), len(pair) - 1)
                hit = pair[at] == links
                count_sum, n_best = _sums(np.where(hit, n[at], 0), first), _sums(hit & best[at], first)
            ends = np.append(0, np.cumsum(~hit))[first]
            missed, rare, rare_n = links[~hit], [], []
            for i in range(len(col)):
                pairs, k = np.unique(missed[ends[i]:ends[i + 1]], return_counts=True)
                rare.append(pairs)
                rare_n.append(k)
            made = [pa.array(count_sum), pa.array(n_best), pa.array(rare, pa.list_(pa.int64())), pa.array(rare_n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", *added.names])

    return rows.mapInArrow(run, T.StructType([T.StructField("row", T.StringType()), *added.fields]))


def score_links(docs: DataFrame, a: str, b: str, text: str = "text", name: str = "alignment", carry: list[str] | None = None,
                with_groups: bool = False, table_size: int = TABLE_SIZE, store_pieces: int = STORE_PIECES) -> tuple[DataFrame, str]:
    """``docs`` with a struct and its name: n_a, n_b, n_groups, n_links, n_best (links of the pair most
    frequent for its b id), count_sum (corpus counts of all links), groups_sha256, groups (the text
    `a1,a2|b1;a3|b2,b3`; null unless asked for)."""
    name = fresh(name, docs.columns)
    carry = docs.columns if carry is None else carry
    made, base = aligned(docs, a, b, text, carry, with_groups, store_pieces)
    made = released(made)                 # so a row keeps its name, and no text is encoded again
    counts = released(link_counts(made, base))
    least, table = frequent(counts, table_size)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = made.where(F.col("doc").isNotNull())
    packed = np.uint32 if len(byte_level(a).spelled) * base < 1 << 32 else np.int64
    found = released(_looked_up(rows.select(F.col("doc")["row"].alias("row"), F.col("doc")["links"].alias("links")), shared, packed))
    asked = found.select("row", F.explode(F.arrays_zip(F.col("rare").alias("pair"), F.col("rare_n").alias("k"))).alias("p"))
    rest = (asked.select("row", "p.pair", "p.k").join(counts.where(F.col("n") < least), "pair")
            .select("row", (F.col("n") * F.col("k")).alias("count_sum"), F.when(F.col("best"), F.col("k")).otherwise(0).alias("n_best")))
    sums = (found.select("row", "count_sum", "n_best").unionByName(rest)
            .groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")))
    of = rows.select("held", F.struct(*[F.col("doc")[f].alias(f) for f in (*_SIZES, "groups_sha256", "groups")]).alias("s"),
                     F.col("doc")["row"].alias("row")).join(sums, "row")
    s = F.struct(*[F.col("s")[f].alias(f) for f in _SIZES], "n_best", "count_sum", F.col("s")["groups_sha256"].alias("groups_sha256"),
                 F.col("s")["groups"].alias("groups"))
    return of.select(*[F.col("held")[c].alias(c) for c in carry], s.alias(name)), name
