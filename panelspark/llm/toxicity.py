"""Toxicity by a classifier chain.

The categories are predicted one after the other.  Each has a linear model on hashed words and word
beginnings (present or not) and on the probabilities of the categories before it.  In training
those probabilities are out of fold: each labelled row gets them from models that were fitted on
the other folds, so a later model learns how reliable they are on unseen rows.

The tables label one category, ``toxic``.  The finer ones before it are weak labels: a toxic row
belongs to ``insult`` or ``demeaning`` if it has one of the category's words.  ``toxic``, the last
in the chain, is learned from its labels alone and so finds words that no list has.

The models are fitted on at most ``max_rows`` labelled rows, at most half of them toxic ones.  Their
features are, of the hashed words with at least ``min_rows`` of these rows, the ``n_features`` most
associated with the last category.

Defined cases: a null or empty text has no features and gets the models' intercepts; rows without
a label are not trained on; of several labels of one id the largest counts; without training rows
every probability is 0; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.quality_gam import sample_texts
from panelspark.llm.textscan import ALNUM, Words, add_struct, flat, fresh, list_array, pieces, prefix_hash, span_hash

MAX_ROWS, N_FEATURES, MIN_ROWS = 20_000, 4096, 5
BEGINNINGS = (4, 5, 6)      # bytes of a word's beginning that count as features besides the word
FOLDS, STEPS, L2 = 4, 150, 1.0
THRESHOLD = 0.5
FILTER_BITS = 18

#: Weak labels: the words that put a toxic row into a finer category.
CATEGORIES = {"insult": ("idiot", "moron", "scum", "clown"), "demeaning": ("worthless", "pathetic")}
LAST = "toxic"


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and of its beginnings; a beginning that is the whole word counts
    once, as the word."""
    prefix, text = prefix_hash(w.data), w.text_of
    where, out = [text], [span_hash(prefix, w.starts, w.ends)]
    for n in BEGINNINGS:
        long = w.ends - w.starts > n
        where.append(text[long])
        out.append(span_hash(prefix, w.starts[long], w.starts[long] + n) + np.uint64(n))
    return np.concatenate(where), np.concatenate(out)


class Features:
    """The chosen hashes, sorted, with a bit table before the exact look-up."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.table = np.zeros(1 << FILTER_BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def rows(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) of every distinct feature that a text has, by text."""
        n = max(len(self.hashes), 1)
        text, h = tokens(w)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), n - 1)
        ok = self.hashes[place] == h[at] if len(self.hashes) else np.zeros(len(at), bool)
        key = np.unique(text[at][ok] * n + place[ok])
        return key // n, key % n


@dataclass
class Linear:
    weights: np.ndarray          # by feature
    chain: np.ndarray            # by earlier category
    bias: float

    def prob(self, row: np.ndarray, col: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        z = self.bias + np.bincount(row, self.weights[col], n) + earlier @ self.chain
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(row, col, n: int, n_features: int, earlier: np.ndarray, y: np.ndarray, use: np.ndarray) -> Linear:
    """Logistic regression with an L2 penalty on the rows of ``use``, by scaled gradient steps."""
    m, k = n_features, earlier.shape[1]
    model = Linear(np.zeros(m), np.zeros(k), 0.0)
    if not use.any():
        model.bias = -30.0
        return model
    keep = use[row]
    row, col = row[keep], col[keep]
    share = np.clip(y[use].mean(), 1e-6, 1 - 1e-6)
    model.bias = float(np.log(share / (1 - share)))
    # Adagrad: each weight's step shrinks with its own gradients.
    sums = [np.full(m, 1e-8), np.full(k, 1e-8), 1e-8]
    for _ in range(STEPS):
        miss = np.where(use, model.prob(row, col, n, earlier) - y, 0.0)
        grads = (np.bincount(col, miss[row], m) + L2 * model.weights, earlier.T @ miss + L2 * model.chain, miss.sum())
        sums = [s + g * g for s, g in zip(sums, grads, strict=True)]
        model.weights = model.weights - 0.5 * grads[0] / np.sqrt(sums[0])
        model.chain = model.chain - 0.5 * grads[1] / np.sqrt(sums[1])
        model.bias = float(model.bias - 0.5 * grads[2] / np.sqrt(sums[2]))
    return model


@dataclass
class Chain:
    names: list[str]
    features: np.ndarray
    models: list[Linear]

    def probs(self, row, col, n: int) -> np.ndarray:
        """One column a category, in the chain's order."""
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.column_stack([out, model.prob(row, col, n, out)])
        return out


def fit_chain(names: list[str], features: np.ndarray, row, col, y: np.ndarray, fold: np.ndarray) -> Chain:
    """``y``: one column a category; ``fold``: each row's fold number."""
    n, m = len(y), max(len(features), 1)
    unseen = np.zeros((n, 0))
    models = []
    for k in range(len(names)):
        models.append(fit_linear(row, col, n, m, unseen, y[:, k], np.ones(n, bool)))
        column = np.zeros(n)
        for f in range(FOLDS):
            part = fit_linear(row, col, n, m, unseen, y[:, k], fold != f)
            column[fold == f] = part.prob(row, col, n, unseen)[fold == f]
        unseen = np.column_stack([unseen, column])
    return Chain(names, features, models)


def _chosen(rows: DataFrame, n_features: int, min_rows: int) -> np.ndarray:
    """The hashes most associated with y over the training rows.  A row counts a hash once; the
    counts combine map-side, so common words do not pile up in one task."""
    def run(batches):
        for piece in pieces(batches, "text"):
            text, h = tokens(Words(*flat(piece.column("text")), ALNUM))
            y = piece.column("y").to_numpy()
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            hashes, place = np.unique(h[once], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(np.bincount(place, minlength=len(hashes)).astype(np.int64)),
                 pa.array(np.bincount(place, (y[text[once]] > 0), len(hashes)).astype(np.int64))], names=["h", "n", "bad"])

    counts = rows.select("text", "y").mapInArrow(run, "h long, n long, bad long").groupBy("h").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= min_rows)
    share = rows.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0] or 0.0
    # Rows above what chance would give, in units of its deviation.
    spread = F.sqrt(F.col("n") * share * (1 - share)) + 1e-9
    best = counts.withColumn("lift", (F.col("bad") - F.col("n") * share) / spread).where("lift > 0")
    got = best.orderBy(F.desc("lift"), "h").limit(n_features).select("h").toArrow()
    return got.column("h").to_numpy().view(np.uint64)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = LAST,
          categories: dict[str, tuple[str, ...]] | None = None, max_rows: int = MAX_ROWS,
          n_features: int = N_FEATURES, min_rows: int = MIN_ROWS) -> Chain:
    """A chain over ``categories`` and then ``label``, from labelled rows whose id's crc32 is not 0
    modulo 5."""
    categories = CATEGORIES if categories is None else categories
    names = [*categories, label]
    rows = sample_texts(docs, labels, doc_id, text, label, max_rows, balanced=True).checkpoint()
    chosen = Features(_chosen(rows, n_features, min_rows))
    lists = [{w.encode() for w in words} for words in categories.values()]

    def run(batches):
        for piece in pieces(batches, "text"):
            w = Words(*flat(piece.column("text")), ALNUM)
            row, col = chosen.rows(w)
            y = piece.column("y").to_numpy() > 0
            marks = [y]
            for words in reversed(lists):
                has = np.zeros(piece.num_rows, bool)
                for t in np.flatnonzero(y):
                    a, z = w.first[t], w.first[t + 1]
                    has[t] = any(w.data[s:e].tobytes() in words for s, e in zip(w.starts[a:z], w.ends[a:z], strict=True))
                marks.insert(0, has)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), list_array(col, np.bincount(row, minlength=piece.num_rows), pa.int32()),
                 list_array(np.column_stack(marks).astype(np.int8).ravel(), np.full(piece.num_rows, len(names)), pa.int8())],
                names=["id", "cols", "y"])

    got = rows.select("id", "text", "y").mapInArrow(
        run, T.StructType([rows.schema["id"], T.StructField("cols", T.ArrayType(T.IntegerType())),
                           T.StructField("y", T.ArrayType(T.ByteType()))])).orderBy("id").toArrow()
    n = got.num_rows
    if not n:
        return Chain(names, chosen.hashes, [Linear(np.zeros(1), np.zeros(k), -30.0) for k in range(len(names))])
    cols = got.column("cols").combine_chunks()
    count = np.diff(cols.offsets.to_numpy())
    y = np.stack(got.column("y").to_numpy()).astype(float)
    return fit_chain(names, chosen.hashes, np.repeat(np.arange(n), count), cols.flatten().to_numpy().astype(np.int64), y,
                     np.arange(n) % FOLDS)


def score(docs: DataFrame, chain: Chain, text: str = "text", name: str = "toxicity",
          carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct of one probability a category, and its name.  The chain is broadcast:
    at most N_FEATURES weights a category."""
    name = fresh(name, docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    state: list[Features] = []

    def make(piece: pa.RecordBatch) -> list[pa.Array]:
        if not state:
            state.append(Features(shared.value.features))
        row, col = state[0].rows(Words(*flat(piece.column(text)), ALNUM))
        return [pa.array(p) for p in shared.value.probs(row, col, piece.num_rows).T]

    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in chain.names])
    return add_struct(docs, text, schema, name, make, carry), name


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows whose last category reaches ``threshold``."""
    chain = train(docs, labels, **options)
    scored, t = score(docs, chain)
    return scored.where(F.col(t)[chain.names[-1]] < threshold).select(*docs.columns)
