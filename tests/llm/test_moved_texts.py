"""Steps that name rows by hash move no texts but those that they need."""

from pyspark.sql import functions as F

from shelfcast.llm import mixing, neardup


def written_bytes(monkeypatch, module):
    """What the module writes on the way, by purpose: the columns."""
    seen = {}
    plain = module.materialize

    def noted(df, purpose="table"):
        seen.setdefault(purpose, []).extend(df.columns)
        return plain(df, purpose)

    monkeypatch.setattr(module, "materialize", noted)
    return seen


def test_mix_writes_texts_of_repeated_rows_only(make_docs, monkeypatch):
    seen = written_bytes(monkeypatch, mixing)
    docs = make_docs([(i, "w " * (i % 50), f"s{i % 3}") for i in range(200)])
    out, names = mixing.mix(docs, keep=docs.columns, block_words=8)
    assert out.count() == 200 and "held" not in sum(seen.values(), [])
    plain = {r["doc_id"]: r[names["taken"]] for r in out.collect()}
    # Twice the same rows: each is a document of its own, and both together take what one source allows.
    out, names = mixing.mix(docs.unionByName(docs), keep=docs.columns, block_words=8)
    rows = out.collect()
    assert len(rows) == 400 and "held" in seen["mix-copies"]
    assert sum(r[names["taken"]] for r in rows) in range(2 * sum(plain.values()) - 6, 2 * sum(plain.values()) + 7)
    assert all(0 <= r[names["taken"]] <= 3 * r[names["size"]] for r in rows)


def test_mix_names_tell_nulls_apart(make_docs):
    rows = [(None, "a", None), (None, None, "a"), (1, None, "a"), (1, "a", None), (1, "a", "a"), (1, "a", "a"), (None, None, None)]
    docs = make_docs(rows)
    out, names = mixing.mix(docs, keep=docs.columns, block_words=4)
    key = lambda r: str((r["doc_id"], r["text"], r["source"]))
    got = out.collect()
    assert sorted(map(key, got)) == sorted(str(r) for r in rows)
    assert all(r[names["size"]] == len((r["text"] or "").split()) for r in got)


def test_map_keeps_all_wanted_rows_and_few_others(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("key"), F.lit("x").alias("body"))
    wanted = rows.where("key IS NULL OR key % 100 = 7").select(F.col("key").alias("id"))
    found = neardup.perhaps_in(rows, "key", wanted, "id")
    assert found.columns == rows.columns
    kept = [r["key"] for r in found.collect()]
    assert {r["id"] for r in wanted.collect()} <= set(kept) and len(kept) < 210
    assert neardup.perhaps_in(rows, "key", wanted.limit(0), "id").count() == 0


def test_classes_are_named_by_sixteen_bytes(make_docs):
    (row,) = neardup.sketches(make_docs([(1, "a b c d e f")]), 4).collect()
    assert len(row["class"]) == 16
