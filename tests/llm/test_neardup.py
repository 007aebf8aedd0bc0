import random

from brute import near_components, shingles
from shelfcast.llm.neardup import keep_first, near_duplicates


def components_of(df):
    return {r["id"]: r["component_id"] for r in df.collect()}


def test_agrees_with_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = near_duplicates(docs, width=4).collect()
    assert {r["id"]: r["component_id"] for r in found} == near_components(rows, 4)
    sizes = {i: len(shingles(t, 4)) for i, t in rows}
    assert {r["id"]: r["n_shingles"] for r in found} == sizes
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in found)


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def test_large_groups_of_near_copies(make_docs):
    """Two groups with more members than a short list holds, one shared passage, and short texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, passage = [], " ".join(rng.choices(vocabulary, k=12))
    for _ in range(2):
        base = rng.choices(vocabulary, k=120)
        rows += [edited(rng, base, rng.randrange(4)) for _ in range(90)]
    rows += [passage + " " + " ".join(rng.choices(vocabulary, k=60)) for _ in range(90)]
    rows += ["a b c d e", "a b c d e f", "a b c d e f g", "a b", "A b", "a", "", None, " \n\t"]
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    assert components_of(near_duplicates(make_docs(rows), width=4)) == near_components(rows, 4)


def test_large_group_of_much_edited_copies(make_docs, monkeypatch):
    """Copies that are similar to the least edited ones only; the pairs that stay open do not grow with their square."""
    from shelfcast.llm import neardup

    rng = random.Random(8)
    base = rng.choices([f"w{i}" for i in range(900)], k=130)
    rows = [(i, edited(rng, base, rng.choice((0, 1, 2, 3, 5, 6, 7)))) for i in range(300)]
    # Half as long as the base: similar to each other, never to the whole.
    rows += [(400 + i, edited(rng, base[:65], rng.randrange(3))) for i in range(100)]
    left, pairs = [], neardup.prefix_pairs

    def counted(*args):
        open_pairs = pairs(*args)
        left.append(open_pairs.count())
        return open_pairs

    monkeypatch.setattr(neardup, "prefix_pairs", counted)
    assert components_of(near_duplicates(make_docs(rows), width=4)) == near_components(rows, 4)
    assert not left or left[0] < 2 * len(rows)


def test_bands_of_sizes_lose_no_pair(make_docs, spark):
    """Every similar pair of sets is among the pairs by prefixes, also where the sizes are at the edge of a band."""
    from pyspark.sql import functions as F

    from shelfcast.llm.neardup import prefix_pairs, prefixes

    rng = random.Random(3)
    pool = rng.sample(range(10**6), 140)
    sets = {f"c{n}-{i}": sorted(rng.sample(pool[:n + 8], n)) for n in (4, 5, 8, 10, 16, 20, 64, 80, 100, 125) for i in range(6)}
    frame = spark.createDataFrame(list(sets.items()), "class STRING, set ARRAY<BIGINT>")
    found = prefix_pairs(prefixes(frame, 80).withColumn("root", F.col("class")), 80).select("a", "b").distinct().collect()
    found = {frozenset((r["a"], r["b"])) for r in found}
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = set(sets[a]), set(sets[b])
            if x != y and 100 * len(x & y) >= 80 * len(x | y):
                assert frozenset((a, b)) in found


def test_nulls_ties_repeats_and_clashing_columns(make_docs, spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([(7, text), (3, text), (None, text), (5, None), (6, ""), (3, text)])
    clash = docs.selectExpr("*", "1 AS found", "2 AS id", "3 AS class", "4 AS n")
    found = sorted((r["id"] or -1, r["component_id"], r["kept"]) for r in near_duplicates(clash).collect())
    assert found == [(-1, 3, False), (3, 3, True), (3, 3, True), (5, 5, True), (6, 6, True), (7, 3, False)]
    kept = keep_first(clash)
    assert kept.columns == clash.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6]
    empty = make_docs([])
    assert near_duplicates(empty).count() == 0 and keep_first(empty).count() == 0


def test_keep_first_of_repeated_rows(spark, make_docs):
    """One of the rows that repeat the kept id and text stays; other texts of that id stay as their own groups do."""
    from pyspark.sql import functions as F

    from shelfcast.llm.neardup import keep_first

    long = " ".join(f"w{i}" for i in range(60))
    near = long + " more"
    docs = [(5, long), (5, long), (5, long), (9, near), (7, "short text"), (7, "short text"), (None, "no id"), (3, None), (3, None)]
    frame = make_docs(docs).withColumns({"r1": F.lit(1), "again": F.lit("x"), "_id": F.lit(2)})
    out = keep_first(frame)
    assert out.columns == frame.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted({(5, long), (7, "short text"), (None, "no id"), (3, None)}, key=str)
