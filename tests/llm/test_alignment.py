"""Alignment against a plain loop over the tokens of whole texts, and odd input."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfcast.llm import alignment as al
from shelfcast.llm.queries import QUERIES, byte_level, pieces


@pytest.fixture(scope="module")
def sides():
    return byte_level(), pieces()


def plain(text, sides):
    """Ids and byte ranges of whole texts, or none."""
    if not text:
        return [], []
    raw, out = b" " + text.encode(), []
    ids = sides[0].tokenizer.encode(" " + text, add_special_tokens=False).ids, sides[1].model.encode(text)
    for side, own in zip(sides, ids):
        at, spans = 0, []
        for i in own:
            spans.append((i, at, at + len(side.tokens[i])))
            at = spans[-1][2]
        if b"".join(side.tokens[i] for i in own) != raw:
            return [], []
        out.append(spans)
    return tuple(out)


def plain_overlaps(a, b):
    return {(i, j) for i, (_, s, e) in enumerate(a) for j, (_, t, f) in enumerate(b) if s < f and t < e}


def brute(docs, sides):
    spans = {doc: plain(text, sides) for doc, text in docs}
    links = {doc: [(x[0], y[0]) for x in a for y in b if x[2] == y[2]] for doc, (a, b) in spans.items()}
    counts = Counter(p for own in links.values() for p in own)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc, (a, b) in spans.items():
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        cut = lambda own, lo, hi: ",".join(str(i) for i, _, e in own if lo < e <= hi)
        text = ";".join(f"{cut(a, lo, hi)}|{cut(b, lo, hi)}" for lo, hi in zip([0, *ends], ends))
        own = links[doc]
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        n_best = sum(counts[p] == best[p[1]] for p in own)
        out.append((doc, len(a), len(b), len(ends), len(own), n_best, sum(counts[p] for p in own), digest))
    return sorted(out)


PARTS = ["a", "The", "Zé", " ", "  ", "\n", "\t", " ", "　", "日本語", "'s", "'ll", "12", "345", "!?", "<|endoftext|>",
         "</s>", "<s>", "\x1c", "\x85", "é", "​", "word", " the", "\r\n", " ", "😀", "\x00", "<0x41>", " tokenizer",
         " überall", "▁", "ﬁ"]


def some_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.choice([1, 2, 5, 20, 80]))) for _ in range(n)]


def test_words_chain_to_whole_texts(sides):
    aligner = al.Aligner(*sides)
    for text in some_texts(3000, seed=8):
        found = aligner.align([text.encode()])
        a, b = plain(text, sides)
        assert found.a.ids.tolist() == [i for i, *_ in a] and found.b.ids.tolist() == [i for i, *_ in b], repr(text)


def test_memory_of_words_is_bounded(sides, monkeypatch):
    texts = [t.encode() for t in some_texts(60)]
    usual = al.Aligner(*sides).align(texts)
    monkeypatch.setattr(al, "KEPT_TOKENS", 5)
    small = al.Aligner(*sides)
    for _ in range(3):
        again = small.align(texts)
        assert (again.a.ids == usual.a.ids).all() and (again.over_b == usual.over_b).all()


def test_overlaps_and_groups(spark, make_docs, sides):
    docs = list(enumerate(some_texts(80, seed=4)))
    frame = make_docs(docs).withColumns({"over_a": F.lit(1), "b_ids": F.lit("x")})
    out, names = al.align_whole(frame, byte_level, pieces, keep=["doc_id", "over_a", "b_ids"])
    assert names["over_a"] == "_over_a" and names["b_ids"] == "_b_ids" and names["a_ids"] == "a_ids"
    for r in out.collect():
        a, b = plain(dict(docs)[r["doc_id"]], sides)
        assert r["a_ids"] == [i for i, *_ in a] and r["_b_ids"] == [i for i, *_ in b]
        pairs = list(zip(r["_over_a"], r["over_b"]))
        assert len(pairs) == len(set(pairs)) and set(pairs) == plain_overlaps(a, b)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        assert r["a_group"] == [sum(e < x[2] for e in ends) for x in a]
        assert r["b_group"] == [sum(e < y[2] for e in ends) for y in b]


def digests(spark, tmp_path, docs):
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    return QUERIES["op12_token_alignment"](spark, str(tmp_path))


def test_query_equals_plain_loop(spark, make_docs, sides, tmp_path):
    docs = list(enumerate(some_texts(200, seed=9))) + [(900 + i, t) for i, t in enumerate(some_texts(30, seed=9))]
    out = digests(spark, tmp_path, make_docs(docs).repartition(5))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, sides)


def test_odd_input(spark, make_docs, sides, tmp_path):
    long = "one very long line of words " * 40_000
    docs = [(1, None), (2, ""), (3, " "), (4, "a ▁ mark"), (5, long), (5, long), (None, "no id"), (6, "x" * 30_000)]
    frame = make_docs(docs).withColumns({"links": F.lit(1), "n_a": F.lit(2), "text2": F.lit("t")})
    got = sorted(map(tuple, digests(spark, tmp_path, frame).collect()), key=str)
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r)
    for doc in (1, 2, 4):
        assert by_id[doc] == [(doc, 0, 0, 0, 0, "", 0, 0)]
    assert len(by_id[5]) == 2 and by_id[5][0] == by_id[5][1] and by_id[5][0][1] > 200_000 and by_id[None][0][1] > 0


def test_empty_table_and_invalid_bytes(spark, make_docs, tmp_path):
    assert digests(spark, tmp_path, make_docs([])).collect() == []
    found = al.Aligner(byte_level(), pieces()).align([b"\xff\xfe", b"ok"])
    assert found.per_doc(found.a.doc).tolist()[0] == 0 and found.per_doc(found.a.doc).tolist()[1] > 0


def test_linkable_bounds_pairs(sides):
    assert al.linkable([b"ab", b"b"], [b"b", b"cab", b"ab", b"b"]) == 3 + 2 + 2 + 1
    assert al.linkable(sides[0].tokens, sides[1].tokens) < 2_000_000
