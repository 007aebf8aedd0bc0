"""Toxicity: a linear classifier learned from confirmed toxic documents and unlabelled text.

Non-negative positive-unlabelled learning: with the class prior ``pi`` and the log loss ``l``, the risk of a score f is
``pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])``. Where the second part would turn negative, a step is taken
against it, so that a flexible model can't buy a low risk by memorising the positives.

A document is the set of its hashed words and of their beginnings, which inflected words share. The features are those hash buckets that are more frequent in the positives
than in the unlabelled text beyond chance, and as many that are less frequent; their number is bounded.

The positives and the unlabelled documents are bounded samples (parameters); texts stay on the executors, the driver
gets bucket numbers of the sample's documents. Scores cover all documents and whole texts.

Defined results: null and empty texts have no words and get the score of the intercept; without positives every score
is zero; without unlabelled documents, one.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from shelfcast.llm.common import map_text, unused
from shelfcast.llm.labelled import labelled_ids, labelled_texts

#: Positive and unlabelled documents that a fit reads at most.
POSITIVES = 4_000
UNLABELLED = 12_000
#: Labelled documents from which the positives and the class prior are drawn.
LABELLED = 60_000
BUCKETS = 1 << 18
#: Features on each side, and positives in which a feature must occur.
FEATURES = 512
MIN_DOCS = 3
MIN_Z = 4.0
EPOCHS = 400
STEP = 0.1
RIDGE = 1e-4
#: Bytes that are stripped from the ends of a word before it is hashed.
STRIPPED = b".,;:!?\"'()[]{}*#$%&|<>-_"

#: Bytes of the beginnings of words.
PREFIXES = (4, 5)

_cache_limit = 1 << 16


def hasher():
    """Distinct buckets of a text's words and their beginnings, with a bounded memory of hashed words."""
    seen: dict[bytes, list[int]] = {}

    def buckets(raw: bytes) -> list[int]:
        if len(seen) > _cache_limit:
            seen.clear()
        out = set()
        for word in set(raw.lower().split()):
            b = seen.get(word)
            if b is None:
                plain = word.strip(STRIPPED)
                starts = [b"^" + plain[:k] for k in PREFIXES if len(plain) > k]
                b = seen[word] = [crc32(x) % BUCKETS for x in (plain, *starts)]
            out.update(b)
        return sorted(out)

    return buckets


@dataclass
class ToxicityModel:
    """Weight per bucket (zero for most) and intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    base: float

    def scorer(self):
        full = np.zeros(BUCKETS)
        full[self.buckets] = self.weights
        buckets = hasher()

        def score(texts: list[bytes]) -> np.ndarray:
            logits = np.array([self.base + full[buckets(raw)].sum() for raw in texts], np.float64)
            return sigmoid(logits)

        return score


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def select(pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> np.ndarray:
    """Buckets whose share of documents differs between the samples beyond chance, strongest first on each side."""
    np_, nu = max(len(pos), 1), max(len(unl), 1)
    p = np.bincount(np.concatenate(pos), minlength=BUCKETS) if pos else np.zeros(BUCKETS)
    u = np.bincount(np.concatenate(unl), minlength=BUCKETS) if unl else np.zeros(BUCKETS)
    pooled = (p + u) / (np_ + nu)
    z = (p / np_ - u / nu) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / np_ + 1 / nu))
    z[(p < MIN_DOCS) & (u < MIN_DOCS)] = 0
    order = np.argsort(-z, kind="stable")
    up = [b for b in order[:FEATURES] if z[b] >= MIN_Z and p[b] >= MIN_DOCS]
    down = [b for b in order[::-1][:FEATURES] if z[b] <= -MIN_Z]
    return np.array(sorted({*up, *down}), np.int64)


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> ToxicityModel:
    """Full-batch Adam on the non-negative risk; rows are documents as bucket numbers."""
    none = np.array([], np.int64)
    if not pos or not unl or prior <= 0:
        return ToxicityModel(none, np.array([]), -500.0 if not pos or prior <= 0 else 500.0)
    chosen = select(pos, unl, prior)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))

    def sparse(rows):
        cols = [place[r] for r in rows]
        cols = [c[c >= 0] for c in cols]
        return np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate([*cols, none])

    (pr, pc), (ur, uc) = sparse(pos), sparse(unl)
    d = len(chosen)
    w = np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior)) if prior < 1 else 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)

    def logits(r, c, n):
        return w[d] + np.bincount(r, w[c], n)

    def pull(r, c, per_row):
        return np.append(np.bincount(c, per_row[r], d), per_row.sum())

    for t in range(1, EPOCHS + 1):
        fp, fu = logits(pr, pc, len(pos)), logits(ur, uc, len(unl))
        sp, su = sigmoid(fp), sigmoid(fu)
        soft = lambda z: np.logaddexp(0, z)  # noqa: E731  l(-f) = log(1 + e^f)
        negative = soft(fu).mean() - prior * soft(fp).mean()
        g_neg = pull(ur, uc, su / len(unl)) - prior * pull(pr, pc, sp / len(pos))
        g_pos = pull(pr, pc, -prior * (1 - sp) / len(pos))
        g = g_pos + g_neg if negative >= 0 else -g_neg
        g[:d] += RIDGE * w[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return ToxicityModel(chosen, w[:d], float(w[d]))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", text: str = "text", doc_id: str = "doc_id",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, labelled: int = LABELLED, prior: float | None = None,
) -> ToxicityModel:
    """A model from confirmed positives among the training rows and unlabelled documents.

    ``prior`` is the share of positives in the unlabelled text; by default the share among the training labels, which
    is the only use made of negative labels. The unlabelled sample leaves out ids for which ``train`` does not hold,
    so that held-out documents stay unseen.
    """
    ids = labelled_ids(labels, label, train, labelled, doc_id)
    counts = ids.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    if prior is None:
        prior = (counts["p"] or 0) / max(counts["n"], 1)

    def make():
        buckets = hasher()
        return lambda texts: [pa.array([buckets(raw) for raw in texts], pa.list_(pa.int32()))]

    field = StructField("x", ArrayType(IntegerType()))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]

    def sample(rows: DataFrame, limit: int) -> list[np.ndarray]:
        bags = map_text(rows, make, [field], text="body", keep=["doc_id"])
        found = bags.orderBy(*order, "x").limit(limit).toArrow()["x"].combine_chunks()
        if isinstance(found, pa.ChunkedArray):  # without rows there is no chunk
            return []
        cuts = np.cumsum(found.value_lengths().to_numpy())[:-1]
        return np.split(found.flatten().to_numpy(), cuts) if len(found) else []

    marked = ids.where("label = 1").orderBy(*order).limit(positives)
    pos = sample(labelled_texts(docs, marked, text, doc_id), positives)
    body = docs.where(train & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body")
    )
    drawn = body.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled)
    unl = sample(body.join(F.broadcast(drawn), "doc_id"), unlabelled)
    return fit(pos, unl, prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> tuple[DataFrame, str]:
    """The documents with a score from 0 to 1, and the name of that column."""
    name = unused("score", docs.columns)

    def make():
        score = model.scorer()
        return lambda texts: [pa.array(score(texts), pa.float64())]

    return map_text(docs, make, [StructField(name, DoubleType())], text=text, keep=docs.columns), name
