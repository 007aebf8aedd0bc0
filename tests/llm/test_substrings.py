import random

import numpy as np
import pytest

from brute import kept_bytes
from shelfcast.llm import substrings
from shelfcast.llm.substrings import first_smallest, remove_repeats


def check(docs, rows, **options):
    out, names = remove_repeats(docs, **options)
    found = [(r["doc_id"], r[names["n_bytes"]], r[names["removed"]], bytes(r[names["kept"]])) for r in out.collect()]
    expected = [(i, *e) for (i, _), e in zip(rows, kept_bytes(rows, options.get("length", 200)))]
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(found, key=order) == sorted(expected, key=order)
    return expected


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(e[2] for e in expected)


def texts(rng):
    """Few letters, shared passages at odd places, edits, periodic stretches and multi-byte characters."""
    passages = ["".join(rng.choices("abcé", k=60)) for _ in range(4)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p)), 2))
            parts.append(rng.choice([p, p[a:b], p[:a] + "x" + p[a:], "ab" * rng.randrange(30), "".join(rng.choices("abcde", k=40))]))
        rows.append((i, "".join(parts)))
    return rows + [(500, None), (501, ""), (502, "a" * 19), (503, "é" * 40), (None, rows[3][1]), (504, rows[5][1]), (504, rows[5][1])]


@pytest.mark.parametrize("group", [4096, 3])
def test_small_alphabet(make_docs, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    rows = texts(random.Random(group))
    check(make_docs(rows), rows, length=20, short=6)


def test_clashing_columns_and_empty_table(make_docs):
    docs = make_docs([(1, "a"), (2, None)]).selectExpr("*", "1 AS kept", "2 AS name", "3 AS spans")
    out, names = remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_bytes", "removed", "_kept"] and out.count() == 2
    assert remove_repeats(make_docs([]))[0].count() == 0


def test_pieces_do_not_change_windows():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 4, 300).astype(np.uint64)
    for width in (1, 2, 3, 7, 64, 161):
        expected = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert first_smallest(values, width).tolist() == expected


def test_long_text_in_pieces(make_docs, monkeypatch, spark):
    """A run that a piece boundary splits is settled by its single windows."""
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdef", k=700_000))
    rows = [(1, "x" * 333 + passage), (2, passage[:650_000] + "y" * 50)]
    out, names = remove_repeats(make_docs(rows))
    found = {r["doc_id"]: r[names["removed"]] for r in out.collect()}
    # The stretch of x repeats itself.
    assert found == {1: [[0, 650_333]], 2: [[0, 650_000]]}
