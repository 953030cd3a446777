"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is described by FEATURES, shares and means of its bytes, words and lines.  Cyclic
boosting visits the features in turn; a shallow tree on one feature's histogram adds a step to that
feature's look-up table.  Then the pairs of features that explain most of what is left get
two-way tables in the same way.  A score is the sigmoid of the intercept plus one table entry a
feature and a pair: vectorised bin look-ups and additions.

The model is fitted on at most ``max_rows`` labelled rows, those with the smallest hashes of the
id; every row is scored.  Labels, language, source and id are never inputs of a score.

Defined cases: a null or empty text has the features of no bytes and is scored like any other;
rows without a label, or with a null one, are not trained on; of several labels of one id the
largest counts; without labels of both kinds every score is the share of 1 (0.5 without labels);
an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.textscan import (
    NON_SPACE, Words, add_struct, flat, fresh, list_array, mix64, window_hashes)

MAX_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 60, 30, 8
RATE = 0.1
THRESHOLD = 0.3

FEATURES = ("log_bytes", "upper", "digit", "comma_stop", "exclaim", "symbol", "non_ascii", "white", "word_bytes",
            "distinct_words", "words_a_line", "repeated_lines", "repeated_triples", "symbol_ends", "capital_words",
            "short_words")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _table(bytes(range(65, 91))), _table(b"0123456789")
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_STOP, _EXCLAIM, _SYMBOL = _table(b".,;:"), _table(b"!?"), _table(b"#$%&*|<>{}[]@^~=+_\\/")
_HIGH, _WHITE = _table(bytes(range(128, 256))), ~NON_SPACE
_LINE = np.ones(256, bool)
_LINE[10] = False


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each text."""
    _, first = np.unique(mix64(keys + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(text[first], minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text."""
    data, off = flat(texts)
    n = len(off) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

    size = np.diff(off)
    w, lines = Words(data, off, NON_SPACE, lower=False), Words(data, off, _LINE, lower=False)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(w.counts, 1)
    length, text = w.ends - w.starts, w.text_of

    def words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights=mask, minlength=n) * per_word

    lower = Words(data, off, NON_SPACE)
    h = lower.hashes()
    triple, line = window_hashes(h, 3), lines.hashes()
    inside = text[2:] == text[:-2] if len(text) > 2 else np.empty(0, bool)
    triple, triple_text = triple[inside], text[:len(triple)][inside]
    n_triple = np.bincount(triple_text, minlength=n)
    last = data[w.ends - 1] if len(w) else np.empty(0, np.uint8)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    n_upper, n_letter = upper[w.ends] - upper[w.starts], letters[w.ends] - letters[w.starts]
    return np.column_stack([
        np.log1p(size), total(_UPPER[data]) * per_byte, total(_DIGIT[data]) * per_byte, total(_STOP[data]) * per_byte,
        total(_EXCLAIM[data]) * per_byte, total(_SYMBOL[data]) * per_byte, total(_HIGH[data]) * per_byte,
        total(_WHITE[data]) * per_byte, words(length), _distinct(h, text, n) * per_word,
        w.counts / np.maximum(lines.counts, 1),
        1 - _distinct(line, lines.text_of, n) / np.maximum(lines.counts, 1),
        1 - _distinct(triple, triple_text, n) / np.maximum(n_triple, 1),
        words(_SYMBOL[last] | _EXCLAIM[last]), words((n_letter > 1) & (n_upper == n_letter)), words(length <= 3)])


@dataclass
class Model:
    """Bin edges and look-up tables, all of fixed size."""
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)]
        for f, g, table in self.pairs:
            out += table[bins[f], bins[g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _leaves(grad: np.ndarray, hess: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree on one histogram: the Newton step of each bin's leaf."""
    out = np.zeros(len(grad))

    def grow(a: int, b: int, left: int) -> None:
        g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
        if left and b - a > 1:
            gain = (g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1))
            if gain.max() > 1e-6:
                cut = a + 1 + int(gain.argmax())
                grow(a, cut, left - 1)
                grow(cut, b, left - 1)
                return
        out[a:b] = g[-1] / (h[-1] + 1)

    grow(0, len(grad), depth)
    return out


def _pair_leaves(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of one axis with a cut of the other on either side: (steps, gain)."""
    best, step = 0.0, np.zeros_like(grad)
    whole = grad.sum() ** 2 / (hess.sum() + 1)
    for flip in (False, True):
        g, h = (grad.T, hess.T) if flip else (grad, hess)
        for cut in range(1, len(g)):
            made, gain = np.zeros_like(g), -whole
            for rows in (slice(0, cut), slice(cut, len(g))):
                leaf = _leaves(g[rows].sum(0), h[rows].sum(0), 1)
                made[rows] = leaf
                gain += (leaf * g[rows].sum(0)).sum()
            if gain > best:
                best, step = gain, made.T if flip else made
    return step, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    quantiles = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for f in range(x.shape[1])]
    model = Model(float(np.log(share / (1 - share))), quantiles, [np.zeros(len(e) + 1) for e in quantiles], coarse)
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(quantiles)]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _leaves(np.bincount(b, g, len(quantiles[f]) + 1), np.bincount(b, h, len(quantiles[f]) + 1))
            model.tables[f] += step
            margin += step[b]
    small = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def grid(f: int, q: int, v: np.ndarray) -> np.ndarray:
        m, k = len(coarse[f]) + 1, len(coarse[q]) + 1
        return np.bincount(small[f] * k + small[q], v, m * k).reshape(m, k)

    g, h = slopes()
    gains = sorted(((_pair_leaves(grid(f, q, g), grid(f, q, h))[1], f, q)
                    for f in range(x.shape[1]) for q in range(f)), reverse=True)[:PAIRS]
    model.pairs = [(f, q, np.zeros((len(coarse[f]) + 1, len(coarse[q]) + 1))) for gain, f, q in gains if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for f, q, table in model.pairs:
            g, h = slopes()
            step = RATE * _pair_leaves(grid(f, q, g), grid(f, q, h))[0]
            table += step
            margin += step[small[f], small[q]]
    return model


def id_part(doc_id: Column, parts: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % parts


_SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def with_features(docs: DataFrame, text: str, name: str, carry: list[str]) -> DataFrame:
    def make(piece: pa.RecordBatch) -> list[pa.Array]:
        x = features(piece.column(text))
        return [list_array(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())]

    return add_struct(docs, text, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]), name, make, carry)


def sample_texts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int,
                 balanced: bool = False) -> DataFrame:
    """(id, y, text): at most ``max_rows`` labelled rows whose id's crc32 is not 0 modulo 5.

    The ids with the smallest hashes are taken, ``balanced`` half of them with label 1 at most.  The
    sample is drawn from the labels alone and broadcast (max_rows ids), so no other text moves.
    Of rows with one id the smallest text counts.
    """
    marks = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(id_part(F.col(doc_id)) != 0)
             .groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).cast("int").alias("y")))
    order = [F.xxhash64("id"), F.col("id")]
    if balanced:
        some = max_rows // 2
        ids = marks.where("y = 1").orderBy(*order).limit(some).union(
            marks.where("y = 0").orderBy(*order).limit(max_rows - some))
    else:
        ids = marks.orderBy(*order).limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id")
    return rows.groupBy("id", "y").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          max_rows: int = MAX_ROWS) -> Model:
    """A model of the sample's features; the driver gets max_rows * len(FEATURES) numbers."""
    rows = sample_texts(docs, labels, doc_id, text, label, max_rows)
    got = with_features(rows, "text", "f", ["id", "y"]).select("id", "y", "f.x").orderBy("id").toArrow()
    if not got.num_rows:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    return fit(np.stack(got.column("x").to_numpy()), got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "quality",
          carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct (score) and its name; ``model`` is a few kB and travels with the code."""
    name = fresh(name, docs.columns)
    return add_struct(docs, text, _SCORE, name, lambda piece: [pa.array(model.score(features(piece.column(text))))],
                      carry), name


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``."""
    scored, q = score(docs, train(docs, labels, **options))
    return scored.where(F.col(q)["score"] >= threshold).select(*docs.columns)
