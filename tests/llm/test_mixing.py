from pyspark.sql import functions as F

from shelfcast.llm.mixing import mix, schedule, targets


def test_small_mix(make_docs):
    rows = [(i, "w " * (i % 7), f"s{i % 3}") for i in range(60)]
    rows += [(100, None, None), (101, "x y", None), (102, "", "s0"), (None, "a b c", "s1"), (5, "w w w", "tiny"), (5, "w w w", "tiny")]
    docs = make_docs(rows).selectExpr("*", "1 AS size", "2 AS taken", "3 AS row", "4 AS position")
    found, n = mix(docs, keep=docs.columns, block_words=8)
    assert found.columns == [*docs.columns, *n.values()] and n["size"] == "_size"
    got = found.collect()
    assert len(got) == len(rows)
    by_source = {}
    for r in got:
        assert r[n["size"]] == len((r["text"] or "").split())
        assert 0 <= r[n["taken"]] <= 3 * r[n["size"]]
        s = by_source.setdefault(r["source"], [0, 0, r[n["target"]]])
        s[0] += r[n["taken"]]
        s[1] += r[n["size"]]
    for taken, size, target in by_source.values():
        assert target - 1 < taken <= target <= 3 * size + 1e-9
    total = sum(size for _, size, _ in by_source.values())
    assert abs(sum(t for _, _, t in by_source.values()) - total) < 1e-6
    again = mix(docs, keep=docs.columns, block_words=8)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_and_wordless(make_docs):
    assert mix(make_docs([]))[0].count() == 0
    assert [r["taken"] for r in mix(make_docs([(1, None), (2, "")]))[0].collect()] == [0, 0]


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), (None, 50)], "source string, source_size bigint")
    got = {r["source"]: (r["weight"], r["target"]) for r in targets(sizes).collect()}
    # b and c stop at 30 and 300, and null at 150; a takes the rest.
    assert {s: w for s, (w, _) in got.items()} == {"a": 1, "b": 2, "c": 3, None: 1}
    assert {s: t for s, (_, t) in got.items()} == {"a": 680.0, "b": 30.0, "c": 300.0, None: 150.0}


def test_schedule_is_even(spark):
    rows = [(1, 1.0, 50_000, 50_000), (2, 1.0, 100_000, 100_000), (3, 1.0, 200_001, 70_000)]
    plan = spark.createDataFrame(rows, "position int, target double, quota bigint, source_size bigint")
    slots = schedule(plan, 100)
    sums = {r["position"]: r["w"] for r in slots.groupBy("position").agg(F.sum("words").alias("w")).collect()}
    assert sums == {1: 50_000, 2: 100_000, 3: 200_001}
    first = {r["position"]: r["count"] for r in slots.where("slot < 700").groupBy("position").count().collect()}
    for position, _, quota, _ in rows:  # any stretch has about its share
        assert abs(first[position] - 700 * quota / 350_001) < 6
