"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles; the score is the sum of one table entry per feature and one per selected
pair of features. The tables grow by cyclic boosting: round after round, feature after feature, a shallow tree over
the bins is fitted to the gradient of the log loss and added to the table with a small step. The strongest pairs, by
the gain of a two-by-two cut of the residuals, then get tables in the same way. Scoring bins the features of whole
texts and adds the entries.

The tables are fitted on a bounded sample of labelled documents (``labelled.SAMPLE_ROWS``), on the driver: a few
thousand rows of numbers, no texts. Scores cover all documents.

Defined results: null and empty texts get the score of their (zero) features; without labelled rows every score is
one half; with one class only, the score is the smoothed share of that class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from shelfcast.llm.common import map_text, unused
from shelfcast.llm.labelled import SAMPLE_ROWS, labelled_ids, labelled_texts
from shelfcast.llm.textstats import FEATURES, features_of

ROUNDS = 150
STEP = 0.12
BINS = 32
PAIR_BINS = 8
PAIRS = 8
LEAVES = 4
RIDGE = 4.0


@dataclass
class AdditiveModel:
    """Bin edges and table per feature, and per selected pair the two features, their edges and a table."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edges, entries) in enumerate(zip(self.edges, self.tables)):
            out += entries[np.searchsorted(edges, x[:, j], side="right")]
        for (j, k), entries in zip(self.pairs, self.pair_tables):
            a = np.searchsorted(self.pair_edges[j], x[:, j], side="right")
            b = np.searchsorted(self.pair_edges[k], x[:, k], side="right")
            out += entries[a, b]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def quantile_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner cut points; equal values always share a bin."""
    if not len(column):
        return np.array([])
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf value per bin of the best-first tree with ``leaves`` leaves over ordered bins."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + RIDGE)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        cuts = np.arange(a + 1, b)
        gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
        i = int(np.argmax(gains))
        return float(gains[i]), int(cuts[i])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        options = [(*best(a, b), a, b) for a, b in parts]
        value, cut, a, b = max(options)
        if value <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + RIDGE)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best two-by-two cut of a table, over all cut points."""
    G = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    H = np.zeros_like(G)
    G[1:, 1:], H[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    rows, cols = np.arange(1, g.shape[0]), np.arange(1, g.shape[1])
    if not len(rows) or not len(cols):
        return 0.0, np.zeros_like(g)

    def quarters(t):
        top = t[rows][:, cols]
        right = t[rows, -1][:, None] - top
        below = t[-1, cols][None, :] - top
        return [top, right, below, t[-1, -1] - top - right - below]

    qg, qh = quarters(G), quarters(H)
    gains = sum(a**2 / (b + RIDGE) for a, b in zip(qg, qh))
    i, k = np.unravel_index(int(np.argmax(gains)), gains.shape)
    v = [a[i, k] / (b[i, k] + RIDGE) for a, b in zip(qg, qh)]
    out = np.empty_like(g)
    out[: i + 1, : k + 1], out[: i + 1, k + 1 :], out[i + 1 :, : k + 1], out[i + 1 :, k + 1 :] = v
    return float(gains[i, k] - G[-1, -1] ** 2 / (H[-1, -1] + RIDGE)), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, n_pairs: int = PAIRS) -> AdditiveModel:
    """Cyclic boosting of the feature tables, then of the pair tables."""
    d = x.shape[1]
    base = float(np.log((y.sum() + 1.0) / ((1 - y).sum() + 1.0)))
    edges = [quantile_edges(x[:, j], BINS) for j in range(d)]
    coarse = [quantile_edges(x[:, j], PAIR_BINS) for j in range(d)]
    model = AdditiveModel(base, edges, [np.zeros(len(e) + 1) for e in edges], [], coarse, [])
    if len(set(y.tolist())) < 2:
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    logit = np.full(len(y), base)
    for _ in range(rounds):
        for j in range(d):
            p = sigmoid(logit)
            n = len(edges[j]) + 1
            leaf = shallow_tree(np.bincount(at[j], y - p, n), np.bincount(at[j], p * (1 - p), n))
            model.tables[j] += STEP * leaf
            logit += STEP * leaf[at[j]]
    small = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    shape = [len(e) + 1 for e in coarse]

    def cross(j: int, k: int) -> tuple[float, np.ndarray, np.ndarray]:
        p = sigmoid(logit)
        cell = small[j] * shape[k] + small[k]
        n = shape[j] * shape[k]
        table = lambda w: np.bincount(cell, w, n).reshape(shape[j], shape[k])
        return (*cross_tree(table(y - p), table(p * (1 - p))), cell)

    ranked = sorted(((cross(j, k)[0], j, k) for j in range(d) for k in range(j)), reverse=True)[:n_pairs]
    model.pairs = [(j, k) for _, j, k in ranked]
    model.pair_tables = [np.zeros((shape[j], shape[k])) for j, k in model.pairs]
    for _ in range(rounds // 2):
        for i, (j, k) in enumerate(model.pairs):
            _, values, cell = cross(j, k)
            model.pair_tables[i] += STEP * values
            logit += STEP * values.ravel()[cell]
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
    limit: int = SAMPLE_ROWS,
) -> AdditiveModel:
    """A model from the labelled documents for which ``train`` (an expression over ``doc_id``) holds."""
    ids = labelled_ids(labels, label, train, limit, doc_id)

    def make():
        return lambda texts: [pa.array(list(features_of(texts)), pa.list_(pa.float64()))]

    picked = labelled_texts(docs, ids, text, doc_id)
    field = StructField("x", ArrayType(DoubleType()))
    rows = map_text(picked, make, [field], text="body", keep=["doc_id", "label"]).orderBy("doc_id", "x").toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(rows.num_rows, len(FEATURES))
    return fit(x, np.array(rows["label"].to_pylist(), np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text") -> tuple[DataFrame, str]:
    """The documents with a score from 0 to 1, and the name of that column."""
    name = unused("score", docs.columns)

    def make():
        return lambda texts: [pa.array(model.score(features_of(texts)), pa.float64())]

    return map_text(docs, make, [StructField(name, DoubleType())], text=text, keep=docs.columns), name


def keep_quality(docs: DataFrame, model: AdditiveModel, threshold: float, text: str = "text") -> DataFrame:
    """The documents with at least the threshold's score, with their own columns."""
    scored, name = score_quality(docs, model, text)
    return scored.where(F.col(name) >= threshold).select(*docs.columns)
