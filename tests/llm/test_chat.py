import re

from hypothesis import given, settings, strategies as st

from shelfcast.llm.chat import CONTROL, ESCAPED, format_chats, read_back

CHATS = "conv_id bigint, turn bigint, role string, text string"
TRICKY = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\\\/INST]", "<", "[", " ", "a", "é", "\n", "s>", "INST]"]


def rows_of_chats():
    rows = []
    for c in range(40):
        shared = [("system", "be\nnice"), ("user", "hello"), ("assistant", "hi </s>")][: c % 4]
        own = [("user", f"q{c % 6} [INST]"), ("assistant", f"a{c % 5}"), (None, None), ("assistant", "<\\s>end<")][: c % 5]
        rows += [(c, t, r, x) for t, (r, x) in enumerate([*shared, *own, ("user", "bye")])]
    return rows + [(None, 0, "user", "lost"), (None, 1, "assistant", ""), (90, None, "user", "x"), (90, 0, "user", "x"), (90, 0, "user", "x")]


def conversations(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(own)] for c, own in out.items()}


def test_round_trip_and_tree(spark):
    rows = rows_of_chats()
    nodes, segs, members = format_chats(spark.createDataFrame(rows, CHATS).repartition(5).selectExpr("*", "1 AS leaf", "2 AS tree"))
    nodes, segs = nodes.cache(), segs.cache()
    leaf = {r["conv"]: r["leaf"] for r in members.collect()}
    back = {r["leaf"]: r for r in read_back(nodes, segs).collect()}
    expected = conversations(rows)
    assert set(leaf) == set(expected)
    for c, turns in expected.items():
        got = back[leaf[c]]
        assert list(zip(got["roles"], got["texts"])) == turns
        assert got["learned"] == "".join(x for r, x in turns if r == "assistant")
    # Each history once; starts are dense per tree; parents come before children.
    own = nodes.collect()
    histories = {tuple(t[: i + 1]) for t in expected.values() for i in range(len(t))}
    assert len(own) == len({r["node"] for r in own}) == len(histories)
    by_name = {r["node"]: r for r in own}
    trees = {}
    for r in own:
        trees.setdefault(r["tree"], []).append(r)
        if r["parent"]:
            p = by_name[r["parent"]]
            assert p["start"] < r["start"] and r["position"] == p["position"] + p["length"]
        else:
            assert r["position"] == 0 and r["start"] == 0
    for rows_ in trees.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] == len(r["formatted"].encode())
            at += r["length"]
    # A conversation's tokens are its ancestors' intervals and then its segment.
    for s in segs.collect():
        whole = {}
        for r in trees[s["tree"]]:
            for i, byte in enumerate(r["formatted"].encode()):
                whole[r["start"] + i] = byte
        seen = [whole[i] for a, b in s["ancestors"] for i in range(a, b)] + [whole[s["start"] + i] for i in range(s["length"])]
        assert bytes(seen).decode() == back[s["leaf"]]["formatted"]
        assert s["position"] == sum(b - a for a, b in s["ancestors"])


def test_empty_table(spark):
    nodes, segs, members = format_chats(spark.createDataFrame([], CHATS))
    assert (nodes.count(), segs.count(), members.count()) == (0, 0, 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(TRICKY), max_size=8).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = re.sub(CONTROL, r"\1\\\2\3", text)
    assert re.sub(ESCAPED, r"\1\2\3", escaped) == text
    assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]"))
