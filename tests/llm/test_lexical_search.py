"""Ranked lexical search against a plain ranking, and odd input."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfcast.llm.lexical_search import rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(doc, Counter(terms(text))) for doc, text in docs]
    sized = [(doc, bag, sum(bag.values())) for doc, bag in bags if bag]
    n_docs, n_words = len(sized), sum(n for _, _, n in sized)
    df = Counter(t for _, bag, _ in sized for t in bag)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for doc, bag, n in sized:
            m = 50 + 50 * n * n_docs // n_words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in words if t in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for place, (score, no_id, doc) in enumerate(sorted(scored)[:k], start=1):
            out.append((item, place, None if no_id else doc, -score))
    return sorted(out, key=str)


def ranked(docs, items, **kwargs):
    return sorted((tuple(r) for r in rank(docs, items, **kwargs).collect()), key=str)


@pytest.mark.parametrize("blocks", [{}, {"block_pairs": 20}, {"block_items": 2}])
def test_equals_plain_ranking(spark, make_docs, blocks):
    rng = random.Random(5)
    vocabulary = ["ab", "Ab", "c", "naïve", "42", "Ζ", "z-y", "it's", "日本", "rare"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 12, 60]))) for _ in range(150)]
    docs = [(i * 3 - 40, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i % 7]) for i in range(200)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 15])))) for i in range(9)]
    frame = make_docs(docs).repartition(7)
    table = spark.createDataFrame(items, "item_id long, text string")
    for k in (3, 50):
        assert ranked(frame, table, k=k, **blocks) == brute(docs, items, k)


def test_odd_input(spark, make_docs):
    long = "slow " * 300_000 + "quick fox"
    docs = [(1, None), (2, ""), (3, "-- ?! "), (4, "Quick fox"), (4, "Quick fox"), (None, "quick FOX"), (5, long), (6, "fox quick")]
    items = [(1, "QUICK"), (1, "fox fox"), (2, None), (3, ""), (4, "unseen"), (None, "slow"), (9, "slow, slow")]
    frame = make_docs(docs).withColumns({c: F.lit(7) for c in ("score", "rank", "bag", "doc", "item_id")})
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "term": F.lit("x")})
    assert ranked(frame, table) == brute(docs, items, 50)
    got = [r for r in ranked(frame, table) if r[0] == 1]
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [4, 4, 6, None, 5]


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    columns = ["item_id", "rank", "doc_id", "score"]
    for docs, wanted in ((make_docs([]), items), (make_docs([(1, "fox")]), items.limit(0)), (make_docs([(1, "?")]), items)):
        out = rank(docs, wanted)
        assert out.columns == columns and out.collect() == []


def test_hot_class_is_cut_before_the_shuffle(spark, make_docs):
    """Many copies of one text: fifty of the smallest ids, whatever their number."""
    copies = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("one common text").alias("text"))
    items = spark.createDataFrame([(1, "common")], "item_id long, text string")
    out = rank(copies, items)
    assert [r["doc_id"] for r in out.orderBy("rank").collect()] == []  # a word of all documents weighs nothing
    rare = copies.union(spark.range(30_000, 90_000).select("id", F.lit("another text")))
    out = rank(rare, items)
    assert [r["doc_id"] for r in out.orderBy("rank").collect()] == list(range(50))
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()
