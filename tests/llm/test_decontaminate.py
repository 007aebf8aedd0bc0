import random
import re

from hypothesis import given, settings, strategies as st

from shelfcast.llm.decontaminate import WuManber, decontaminate, find_contamination, judged

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items, width):
    patterns = {}
    for item, text in items:
        w = plain(text)
        m = min(width, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            patterns.setdefault(tuple(w[i : i + m]), set()).add(str(item) if item is not None else "null")
    out = {}
    for doc, text in docs:
        w, hit, found = plain(text), set(), set()
        for p, own in patterns.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= own
        out[doc] = (len(w), len(hit), sorted(found, key=str.encode))
    return out


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def cases():
    rng = random.Random(4)
    vocabulary = ["a", "B", "c!", "É", "7", "x-y"]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    items = [(i, text(rng.randrange(1, 9))) for i in range(12)] + [(3, "a b"), (20, None), (21, "!?"), (None, "q r s"), (5, "q r s")]
    docs = [(i, text(rng.randrange(40))) for i in range(40)] + [(100, None), (101, ""), (102, "z " * 300 + "q r s")]
    return docs, items


def test_agrees_with_brute_force(spark, make_docs):
    docs, items = cases()
    expected = brute(docs, items, 4)
    for block in (1000, 3):  # one block of windows, and many
        out, n = judged(make_docs(docs), items_frame(spark, items), width=4, block_windows=block)
        found = {r["doc_id"]: (r[n["n_words"]], r[n["n_hit"]], r[n["items"]]) for r in out.collect()}
        assert found == expected
        flags = {r["doc_id"]: r[n["contaminated"]] for r in out.collect()}
        assert flags == {d: h > 0 and 20 * h >= w for d, (w, h, _) in expected.items()}


def test_stage_keeps_columns_and_clean_documents(spark, make_docs):
    docs, items = cases()
    clash = make_docs(docs).selectExpr("*", "1 AS spans", "2 AS items", "3 AS contaminated")
    kept = decontaminate(clash, items_frame(spark, items), width=4)
    assert kept.columns == clash.columns
    assert {100, 101, 102} <= {r["doc_id"] for r in kept.collect()}
    nothing = items_frame(spark, [])
    assert decontaminate(clash, nothing).count() == len(docs)
    assert find_contamination(make_docs([]), items_frame(spark, items))[0].count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=25), st.lists(st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=4), max_size=5))
def test_search_finds_every_occurrence(words, patterns):
    found, items = WuManber([(tuple(p), [str(i)]) for i, p in enumerate(patterns)]).search(words)
    hit, own = set(), set()
    for k, p in enumerate(patterns):
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                hit.update(range(i, i + len(p)))
                own.add(str(k))
    assert {j for a, b in found for j in range(a, b)} == hit and items == own
