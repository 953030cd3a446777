"""Token counts of whole texts by a two-tier look-up of pre-tokens; no pre-token is shuffled.

A text is cut at every single space that a non-space follows.  Byte-level BPE with the usual
pre-tokeniser never joins characters across such a cut (the space starts the next pre-token),
so a text's count is the sum of its pieces' counts, each piece after the first with its space.

Tier 1 is a broadcast hash table: the lengths of the ``table_size`` most frequent pieces.  Its
candidates come from all documents: every task counts its pieces and passes on its ``task_top``
most frequent ones, so what is gathered is bounded per task.  Tier 2 is a cache in each worker
for pieces outside the table, which the tokenizer encodes on first sight; it is emptied when it
holds ``cache_size`` pieces.  Both tiers only save time: a piece's length is the tokenizer's.

Special strings inside a text are handled as the tokenizer does by default.  Defined cases: a
null text counts as empty (0 tokens); every other column passes through; an empty table gives
no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.textscan import add_struct, flat, fresh, pieces

TABLE_SIZE = 65_536       # pieces in the broadcast table: a few MB
TASK_TOP = 16_384         # pieces that a task proposes for it
TASK_COUNTS = 400_000     # distinct pieces that a task counts before it drops the rarest
CACHE_SIZE = 1_000_000    # pieces in a worker's cache: about 120 MB
CACHED_CHARS = 64         # longer pieces are encoded each time
SPACE = "\u0120"          # how byte-level vocabularies write a space

_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")      # a space that is no cut
_WHITE = re.compile(r"\s")

_COUNT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def cut(text: str) -> list[str]:
    """The pieces; all but the first stand for themselves with a space before."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class PieceLengths(dict):
    """piece -> number of tokens of " " + piece; misses are encoded and kept up to a limit."""

    def __init__(self, encode, opens: np.ndarray, table: dict[str, int], cache_size: int = CACHE_SIZE):
        super().__init__(table)
        self.encode, self.opens, self.table, self.limit = encode, opens, table, len(table) + cache_size

    def __missing__(self, piece: str) -> int:
        return len(self.encode(" " + piece))

    def learn(self, found: list[list[str]]) -> None:
        """Cache the pieces that are new: encoded as one text, in which each piece without inner
        white space has exactly one token that opens with a space, its first."""
        new = [p for p in set(chain.from_iterable(found)).difference(self)
               if p and len(p) <= CACHED_CHARS and not _WHITE.search(p)]
        if not new:
            return
        if len(self) + len(new) > self.limit:
            self.clear()
            self.update(self.table)
        ids = np.asarray(self.encode(" " + " ".join(new)))
        first = np.flatnonzero(self.opens[ids])
        self.update(zip(new, np.diff(first, append=len(ids)).tolist(), strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        found = [cut(t) if t else [""] for t in texts]
        self.learn(found)
        get = self.__getitem__
        return [len(self.encode(x[0])) + sum(map(get, islice(x, 1, None))) for x in found]


_tokenizers: dict[str, tuple] = {}


def encoder(path: str):
    """(text -> token ids, which ids open with a space) of a tokenizers .json file; loaded once
    in a worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        opens = np.zeros(tok.get_vocab_size(), bool)
        opens[[i for t, i in tok.get_vocab().items() if t.startswith(SPACE)]] = True
        _tokenizers[path] = (lambda text: tok.encode(text, add_special_tokens=False).ids, opens)
    return _tokenizers[path]


_caches: dict[str, PieceLengths] = {}


def worker_cache(run: str, tokenizer: str, shared) -> PieceLengths:
    """The cache that all tasks of a run share in this worker; one run's at a time."""
    if run not in _caches:
        _caches.clear()
        _caches[run] = PieceLengths(*encoder(resolve(tokenizer)), shared.value)
    return _caches[run]


def resolve(name: str) -> str:
    """The file's place on this machine; executors look it up themselves."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def frequent_pieces(docs: DataFrame, text: str, table_size: int = TABLE_SIZE, task_top: int = TASK_TOP) -> list[str]:
    """The most frequent pieces, by counts that every task takes over all of its documents."""
    src = docs.select(F.col(text).alias("text"))

    def run(batches):
        seen: Counter = Counter()
        for piece in pieces(batches, "text"):
            for t in piece.column("text").to_pylist():
                if t:
                    seen.update(cut(t)[1:])
            if len(seen) > TASK_COUNTS:
                seen = Counter(dict(seen.most_common(TASK_COUNTS // 4)))
        top = [(p, n) for p, n in seen.most_common(task_top) if n > 1 and len(p) <= CACHED_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()),
                                          pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    top = (src.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "piece").limit(table_size))
    return [r[0] for r in top.collect()]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "tokens",
                 carry: list[str] | None = None, table_size: int = TABLE_SIZE) -> tuple[DataFrame, str]:
    """``docs`` with a struct (n_bytes, n_tokens) and its name; ``tokenizer``: a .json file name
    that ``public_tokenizers.path`` knows on every machine."""
    name = fresh(name, docs.columns)
    encode, _ = encoder(resolve(tokenizer))
    table = {p: len(encode(" " + p)) for p in frequent_pieces(docs, text, table_size)}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    run = uuid.uuid4().hex

    def make(piece: pa.RecordBatch) -> list[pa.Array]:
        col = piece.column(text)
        lengths = worker_cache(run, tokenizer, shared)
        return [pa.array(np.diff(flat(col)[1]), pa.int64()), pa.array(lengths.counts(col.to_pylist()), pa.int64())]

    return add_struct(docs, text, _COUNT, name, make, carry), name


def over_limit(n_tokens: Column, limit: int = 512) -> Column:
    return n_tokens > limit
