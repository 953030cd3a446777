"""Secrets in texts: keyword automaton, anchored patterns at its hits, embedded checksums.

One Aho-Corasick automaton runs over each text with A-Z lower-cased and finds every keyword of
every kind; a second one runs over the text with all hex digits folded into one symbol and has
one keyword, 32 such symbols.  A kind's pattern is only tried at the place where a hit starts,
anchored there, so no pattern ever searches a text.  Kinds with a checksum drop matches whose
last characters do not carry it.

Per kind the matches are those of a search from left to right without overlap: a hit inside an
earlier match of the kind is skipped, also if that match was then too short and dropped.  (No
keyword contains another of its kind, so hits come in the order of their starts.)  Every pattern
is linear at its hit and runs of the same class are entered only once, so a text costs time in
proportion to its length whatever it holds.

Positions are code points, ends exclusive.  Defined cases: a null or empty text has no secrets;
every other column passes through, clashing names included; equal rows each get their result;
an empty table gives no rows.  The scan is one map over the rows: nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.textscan import LOWER, add_struct, flat, fresh

HEX_RUN = 32
_HEX, _OTHER = 1, 2       # what hex digits, and a text's own \x01, become in the folded copy

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def _crc_ends(m: re.Match) -> bool:
    body = m[0].partition("_")[2]
    return base62_crc(body[:-6]) == body[-6:]


@dataclass(frozen=True)
class Kind:
    """``keywords`` in lower case (none: hex runs); ``holds``: whether a match counts."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    holds: Callable[[re.Match], bool]
    flags: int = re.ASCII


# The three base kinds, then tokens that end in a base-62 CRC-32 of their body.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 8, re.ASCII | re.IGNORECASE),
    Kind("access", ("akia",), r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    Kind("hex", (), r"[0-9a-f]+", lambda m: len(m[0]) >= HEX_RUN),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
         r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])", _crc_ends),
    Kind("npm", ("npm_",), r"(?<![A-Za-z0-9_])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9_])", _crc_ends),
)
BASE = ("assign", "access", "hex")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[_HEX] = _OTHER
_FOLD[48:58] = _FOLD[97:103] = _HEX

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType())])
FOUND = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])


class Scanner:
    """The automata and anchored patterns of some kinds."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        import ahocorasick

        self.kinds = kinds
        self.patterns = [re.compile(k.pattern, k.flags) for k in kinds]
        self.words = ahocorasick.Automaton()
        for i, kind in enumerate(kinds):
            for word in kind.keywords:
                self.words.add_word(word, (i, len(word)))
        if len(self.words):
            self.words.make_automaton()
        self.run = ahocorasick.Automaton()
        self.run.add_word(chr(_HEX) * HEX_RUN, HEX_RUN)
        self.run.make_automaton()
        self.runs_of = [i for i, kind in enumerate(kinds) if not kind.keywords]

    def spans(self, text: str, lower: str, folded: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end), in that order."""
        passed, out = [0] * len(self.kinds), []

        def at_hit(i: int, start: int) -> None:
            if start < passed[i]:
                return
            m = self.patterns[i].match(text, start)
            if m:
                passed[i] = m.end()
                if self.kinds[i].holds(m):
                    out.append((start, i, m.end()))

        if len(self.words):
            for last, (i, n) in self.words.iter(lower):
                at_hit(i, last + 1 - n)
        if self.runs_of:
            for last, n in self.run.iter(folded):
                for i in self.runs_of:
                    at_hit(i, last + 1 - n)
        return sorted(out)


_scanners: dict[tuple[str, ...], Scanner] = {}


def _scanner(names: tuple[str, ...]) -> Scanner:
    if names not in _scanners:
        _scanners[names] = Scanner(tuple(k for k in KINDS if k.name in names))
    return _scanners[names]


def scan_batch(column: pa.Array, scanner: Scanner) -> pa.Array:
    """A list of (kind, start, end) for each text of the column."""
    data, off = flat(column)
    lower, folded = LOWER[data], _FOLD[data]
    kinds, starts, ends, counts = [], [], [], np.zeros(len(off), np.int32)
    for row, text in enumerate(column.to_pylist()):
        if not text:
            continue
        a, b = off[row], off[row + 1]
        found = scanner.spans(text, lower[a:b].tobytes().decode(), folded[a:b].tobytes().decode())
        counts[row + 1] = len(found)
        for start, i, end in found:
            kinds.append(scanner.kinds[i].name)
            starts.append(start)
            ends.append(end)
    span = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                                      names=["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), span)


def find(docs: DataFrame, text: str = "text", name: str = "secrets", carry: list[str] | None = None,
         kinds: tuple[str, ...] = tuple(k.name for k in KINDS)) -> tuple[DataFrame, str]:
    """``docs`` with a struct (spans: array of (kind, start, end), by start and kind) and its name."""
    unknown = set(kinds) - {k.name for k in KINDS}
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    name = fresh(name, docs.columns)

    def make(piece: pa.RecordBatch) -> list[pa.Array]:
        return [scan_batch(piece.column(text), _scanner(kinds))]

    return add_struct(docs, text, FOUND, name, make, carry), name


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listing(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; ``kinds``: of these only."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with each run of overlapping or touching spans replaced by one mask."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    out, at = [], 0
    for a, b in runs:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]",
           kinds: tuple[str, ...] = tuple(k.name for k in KINDS)) -> DataFrame:
    """``docs`` whose texts have a mask in place of every secret; same columns, null texts stay null."""
    names = [k.name for k in KINDS if k.name in kinds]

    def make(piece: pa.RecordBatch) -> list[pa.Array]:
        col = piece.column(text)
        scanner, out = _scanner(tuple(names)), []
        found = scan_batch(col, scanner).to_pylist()
        for value, spans in zip(col.to_pylist(), found, strict=True):
            out.append(masked(value, [(s["start"], s["end"]) for s in spans], mask) if spans else value)
        return [pa.array(out, pa.string())]

    name = fresh("redacted", docs.columns)
    schema = T.StructType([T.StructField("text", T.StringType())])
    made = add_struct(docs, text, schema, name, make)
    return made.select(*[F.col(name)["text"].alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
