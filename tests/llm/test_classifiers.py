import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from brute import WORD
from shelfcast.llm.common import bucket_of
from shelfcast.llm.quality_gam import fit, fit_quality, keep_quality, score_quality
from shelfcast.llm.quality_rules import fit_rules, judge, learn, with_statistics
from shelfcast.llm.textstats import COUNTS
from shelfcast.llm.toxicity import fit_toxicity, score_toxicity


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    repeat = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat)


def test_counts_agree_with_brute_force(spark, sf_dir, make_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 5000").select("doc_id", "text")
    odd = make_docs([(-1, None), (-2, ""), (-3, "a b c a b c a b c"), (-4, "a\n a\na\n\n\n#<é> \x1c\x85  x")]).select("doc_id", "text")
    both = docs.unionByName(odd)
    out, names = with_statistics(both)
    found = {r["doc_id"]: tuple(r[names[c]] for c in COUNTS) for r in out.collect()}
    assert found == {r["doc_id"]: plain_counts(r["text"]) for r in both.collect()}


def corpus(make_docs, spark, n=400):
    """Prose, junk of symbols, and insults; every third document has no label."""
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))]
        quality, toxic = int(i % 5 != 0), int(i % 7 == 0)
        if not quality:
            text = [w + rng.choice("#$%") * 3 for w in text]
        if toxic:
            text[5::30] = [rng.choice(("insult", "Slur,", "abuse")) for _ in text[5::30]]
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, quality, toxic))
    return make_docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def accuracy(scored, labels, name, score, held_out):
    rows = scored.where(held_out).join(labels, "doc_id").select(name, score).collect()
    assert len(rows) > 20
    return np.mean([(r[1] >= 0.3) == r[0] for r in rows])


def test_held_out_accuracy(make_docs, spark):
    docs, labels = corpus(make_docs, spark)
    train = bucket_of("doc_id", 5) != 0
    scored, score = score_quality(docs, fit_quality(docs, labels, train))
    assert accuracy(scored, labels, "quality", score, ~train) > 0.97
    scored, score = score_toxicity(docs, fit_toxicity(docs, labels, train))
    assert accuracy(scored, labels, "toxic", score, ~train) > 0.95
    rules = fit_rules(docs, labels)
    assert 1 <= len(rules) <= 3
    judged, names = judge(docs, rules)
    wrong = judged.join(labels, "doc_id").where(F.col(names["kept"]) != (F.col("quality") == 1)).count()
    assert wrong <= 4


def test_scores_do_not_depend_on_held_out_labels(make_docs, spark):
    docs, labels = corpus(make_docs, spark, 200)
    train = bucket_of("doc_id", 5) != 0
    flipped = labels.select("doc_id", *[F.when(train, F.col(c)).otherwise(1 - F.col(c)).alias(c) for c in ("quality", "toxic")])
    for fitted, scored in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
        one, two = (scored(docs, fitted(docs, own, train))[0].select("doc_id", "score") for own in (labels, flipped))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_odd_inputs(make_docs, spark):
    docs, labels = corpus(make_docs, spark, 60)
    odd = docs.unionByName(make_docs([(1000, None), (1001, ""), (None, "x y"), (3, "again")])).selectExpr(
        "*", "1 AS score", "2 AS body", "3 AS x", "4 AS label", "5 AS kept", "6 AS n_words"
    )
    every = F.lit(True)
    noisy = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (3, 0, 1)], labels.schema))
    for own in (noisy, noisy.limit(0), noisy.where("quality = 1 AND toxic = 0")):
        for fitted, scored in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
            out, name = scored(odd, fitted(odd, own, every))
            assert name == "_score" and out.count() == 64
            assert out.where(F.col(name).isNull() | ~F.col(name).between(0, 1)).count() == 0
        out, names = judge(odd, fit_rules(odd, own))
        assert out.where(F.col(names["kept"]).isNull()).count() == 0
    assert keep_quality(odd, fit_quality(odd, noisy, every), 0.3).columns == odd.columns
    nothing = make_docs([])
    assert score_quality(nothing, fit_quality(nothing, labels, every))[0].count() == 0
    assert judge(nothing, fit_rules(nothing, labels))[0].count() == 0


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y)
    assert {model.pairs[0]} == {(1, 0)}
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_rules_are_ordered_conjunctions():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 16))
    bad = (x[:, 2] > 0.9) | ((x[:, 4] > 0.7) & (x[:, 5] > 0.7))
    rules = learn(x, bad)
    inside = np.zeros(len(x), bool)
    for rule in rules:
        own = np.ones(len(x), bool)
        for condition in rule:
            own &= condition.holds(x)
        inside |= own
    assert len(rules) <= 6 and (inside == bad).mean() > 0.97
