import math
import random
from collections import Counter

import numpy as np
import pytest

from brute import words
from shelfcast.llm import language_model as lm
from shelfcast.llm.common import bucket_of


def corpus():
    """Two languages with their own words, so that the history helps."""
    rng = random.Random(6)
    languages = [[f"{x}{i}" for i in range(40)] for x in ("ab", "Éy")]
    rows = [(i, " ".join(rng.choice(languages[i % 2]) for _ in range(rng.randrange(5, 80)))) for i in range(300)]
    return rows + [(400, None), (401, ""), (402, "unseen " * 3), (None, "ab1 AB1"), (7, "ab1")]


@pytest.mark.parametrize("known", [1 << 17, 20])
def test_counts_and_base_agree_with_brute_force(make_docs, monkeypatch, known):
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (known,))
    rows = corpus()
    held = lambda i: __import__("zlib").crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in [*words(t), "\0end"])
    n, v = sum(counts.values()), len(counts)
    out = lm.score_documents(make_docs(rows).selectExpr("*", "1 AS known", "2 AS n"), bucket_of("doc_id", 7) != 2, keep=("doc_id", "text"))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""), r) for r in out.collect())
    gain = 0.0
    for (key, r), (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))):
        tokens = [*words(t), "\0end"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
        if held(i):
            gain += r["score"] - r["base_score"]
    assert gain > 0


def test_probabilities_sum_to_one(make_docs):
    docs = make_docs(corpus())
    counts = lm.materialize(lm.word_counts(docs, "text"), "counts")
    v = lm.vocabulary(counts, 600)
    model = lm.train(docs, v, "doc_id", "text")
    before, earlier = np.array([3, -1]), np.array([5, -1])
    rows = lm.feature_rows(before, earlier)
    classes = np.exp(lm.log_softmax(model.class_base, model.weights, rows))
    total = classes[:, lm.HEAD_CLASSES :].sum(1)
    for c in range(lm.HEAD_CLASSES):
        cls = np.array([c, c])
        inside = np.exp(lm.log_softmax(model.word_base[cls], model.weights, lm.word_rows(rows, cls)))
        total += classes[:, c] * inside.sum(1)
    assert np.allclose(total, 1, atol=1e-4) and np.abs(model.weights).max() > 0


def test_nothing_to_train_on_and_empty_table(make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([(1, "a b"), (2, None)])
    got = {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in lm.score_documents(docs, F.lit(False)).collect()}
    assert got == {1: (3, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}
    assert lm.score_documents(make_docs([]), F.lit(True)).count() == 0
