"""Vectorised scans of Arrow text columns: words, word hashes and hashes of word windows.

All positions are byte offsets into UTF-8.  Word classes are byte tables: every byte of a
multi-byte character is 0x80 or above, so a class that holds all of 0x80-0xFF (both classes
here do) splits bytes exactly where it splits characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CHUNK_BYTES = 2 << 20   # text that is held as numpy arrays at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_b = np.arange(256)
ALNUM = ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x61) & (_b <= 0x7A)) | (_b >= 0x80)
NON_SPACE = ~((_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D)))

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POS = _rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 4096), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit sums into well spread hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the sum of byte weights i..j-1 times powers of the base."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def power_inverse(n: int) -> np.ndarray:
    """The factors that shift prefix differences starting at 0 .. n-1 to one scale."""
    return _power(_BASE_INV, n)


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    inv = _power(_BASE_INV, len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a block of texts: starts, ends, the first word of each text, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = word_byte[self.data]
        start = inside[1:-1] & ~inside[:-2]
        end = inside[1:-1] & ~inside[2:]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]      # of the texts that are not empty
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        start[first] = inside[first + 1]
        end[last] = inside[last + 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)     # word range of text t: first[t]:first[t+1]
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data), self.starts, self.ends)

    def key(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[self.starts[j]: self.ends[j]].tobytes() for j in range(i, i + n))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of h (ends of texts are the caller's concern)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, np.uint64(n), np.uint64)
    for j in range(n):
        out += h[j: j + m] * _POS[j]
    return mix64(out)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that each piece has about ``limit`` bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def fresh(name: str, taken) -> str:
    """A column name that is not taken (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def add_struct(df: DataFrame, text: str, schema: T.StructType, name: str,
               make: Callable[[pa.RecordBatch], list[pa.Array]], carry: list[str] | None = None) -> DataFrame:
    """``df``'s ``carry`` columns plus a struct column ``name`` that ``make`` fills, block by block.

    ``make`` gets a batch of about CHUNK_BYTES text and returns the struct's fields.
    """
    carry = df.columns if carry is None else carry
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    def run(batches):
        for piece in pieces(batches, text):
            made = [a.cast(f.type) if a.type != f.type else a for a, f in zip(make(piece), fields, strict=True)]
            struct = pa.StructArray.from_arrays(made, fields=fields)
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in carry] + [struct], names=[*carry, name])

    out = T.StructType([df.schema[c] for c in carry] + [T.StructField(name, schema)])
    return df.select(*dict.fromkeys([*carry, text])).mapInArrow(run, out)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values).cast(kind))
