import random

from hypothesis import given, settings, strategies as st

from brute import dropped_lines, edits, without_lines
from shelfcast.llm.linededup import anchor_lengths, dedup_lines, within_one


def check(docs, rows):
    out, names = dedup_lines(docs)
    found = {r["doc_id"]: (r["text"], r[names["n_dropped"]]) for r in out.collect()}
    expected = dropped_lines(rows)
    assert found == {i: (without_lines(t, expected[i]), len(expected[i])) for i, t in rows}
    return expected


def test_agrees_with_all_pairs(make_docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    lines = [rng.choices(vocabulary, k=rng.choice((3, 7, 8, 9, 15, 16, 17, 31, 32, 33))) for _ in range(60)]
    texts = []
    for _ in range(80):
        own = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(lines))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(([], ["New"], ["w1"]))
                line = line or ["x"]
            own.append(" ".join(line).upper() if rng.random() < 0.2 else "  ".join(line))
        texts.append("\n".join(own))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (1000, None), (1001, ""), (1002, "\n\n")]
    expected = check(make_docs(rows), rows)
    assert sum(map(len, expected.values())) > 50


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 1500")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_emptied_repeats_and_clashing_columns(make_docs):
    line = "one two three four five six seven eight"
    docs = make_docs([(1, line), (2, line), (2, line), (3, "short"), (4, None)]).selectExpr("*", "9 AS line", "8 AS emptied")
    out, names = dedup_lines(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert sorted((r["doc_id"], r["text"], r[names["emptied"]]) for r in out.collect() if r["text"] is not None) == [
        (1, line, False), (2, "", True), (2, "", True), (3, "short", False)
    ]
    assert dedup_lines(make_docs([]))[0].count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=7), st.lists(st.integers(0, 2), max_size=7))
def test_distance(a, b):
    assert within_one(a, b) == (edits(a, b) <= 1)


def test_anchors_survive_one_edit():
    for n in range(8, 300):
        for m in (n, n + 1):
            common = set(anchor_lengths(n)) & set(anchor_lengths(m))
            assert any(2 * p <= n for p in common)
