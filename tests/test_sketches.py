import pytest
from pyspark.sql import functions as F

from shelfcast.operators import sketches as sk
from shelfcast.sources import store


@pytest.fixture(scope="module")
def rows(spark):
    """One key with most rows, a key with few, and a key with NULL values only."""
    many = spark.range(60_000).select(
        (F.floor(F.col("id") / 50) % 5 + 3).cast("int").alias("week"),
        F.when(F.col("id") % 50 == 0, "few").otherwise("hot").alias("key"),
        (F.xxhash64("id") % 20_000).alias("product_id"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)) / 7).alias("demand"),
    )
    none = spark.createDataFrame([(3, "none", None, None)], many.schema)
    return many.unionByName(none)


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketches") / "weekly")
    made = sk.weekly_sketches(rows, ["key"], ["product_id"], ["demand"])
    return store.load_features(spark, store.save_features(made, path))


def test_merged_counts_and_quantiles_stay_within_their_bounds(rows, stored):
    chosen = rows.where("week BETWEEN 4 AND 6")
    exact = {r["key"]: r for r in chosen.groupBy("key").agg(
        F.count_distinct("product_id").alias("n"), F.count("demand").alias("rows"), F.sort_array(F.collect_list("demand")).alias("all")
    ).collect()}
    found = sk.over_weeks(stored, ["key"], 4, 6).select(
        "key", sk.count_of("product_id_seen").alias("n"), sk.rows_of("demand_spread").alias("rows"),
        *[sk.quantile_of("demand_spread", q / 10).alias(f"q{q}") for q in (1, 5, 9)],
    ).collect()
    assert {r["key"] for r in found} == {"hot", "few"}
    for r in found:
        want = exact[r["key"]]
        assert r["rows"] == want["rows"]
        # Exact below the sketch's size; four standard errors beyond.
        allowed = 0 if want["n"] < 2**sk.ENTRIES else 4 * want["n"] / 2 ** (sk.ENTRIES / 2)
        assert abs(r["n"] - want["n"]) <= allowed
        for q in (1, 5, 9):
            below = sum(v <= r[f"q{q}"] for v in want["all"])
            assert r[f"q{q}"] in want["all"]
            assert abs(below / want["rows"] - q / 10) < 2 * sk.RANK_ERROR
    assert exact["hot"]["n"] > 2**sk.ENTRIES > exact["few"]["n"]


def test_only_missing_values(stored):
    row = sk.over_weeks(stored, ["key"], 3, 3).where("key = 'none'").select(
        sk.count_of("product_id_seen"), sk.rows_of("demand_spread"), sk.quantile_of("demand_spread", 0.5)
    ).first()
    assert tuple(row) == (0, 0, None)


def test_values_seen_again(rows, stored):
    early, late = sk.over_weeks(stored, ["key"], 3, 4), sk.over_weeks(stored, ["key"], 5, 7)
    found = {r["key"]: r for r in sk.seen_again(early, late, ["key"], "product_id").collect()}
    one = rows.where("key = 'few' AND week <= 4").select("product_id").distinct()
    two = rows.where("key = 'few' AND week > 4").select("product_id").distinct()
    assert (found["few"]["early"], found["few"]["late"], found["few"]["both"]) == (one.count(), two.count(), one.intersect(two).count())


def test_a_range_reads_its_weeks_only(stored):
    plan = sk.over_weeks(stored, ["key"], 4, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week" in plan


def test_stored_sets_are_exact_beyond_a_sketch(spark, rows, tmp_path):
    """A key with some 20,000 ids, negative ids, NULL ids among others, a key with NULL ids only and a NULL key."""
    odd = spark.createDataFrame(
        [(3, None, 5, 1.0), (6, None, 5, 1.0), (6, "none", None, None), (3, "few", None, 1.0), (6, "few", -7, 1.0)],
        "week INT, key STRING, product_id BIGINT, demand DOUBLE")
    known = rows.withColumn("product_id", F.col("product_id") * 11).unionByName(odd)
    made = store.load_features(spark, store.save_features(sk.weekly_members(known, ["key"], "product_id"), str(tmp_path / "members")))
    found = {r["key"]: tuple(r)[1:] for r in sk.members_over(made, ["key"], (3, 5), (6, 9)).collect()}
    ids = {}
    for r in known.where("key IS NOT NULL").groupBy("key").agg(
        F.collect_set(F.when(F.col("week") <= 5, F.col("product_id"))).alias("early"),
        F.collect_set(F.when(F.col("week") >= 6, F.col("product_id"))).alias("late"),
    ).collect():
        early, late = set(r["early"]), set(r["late"])
        ids[r["key"]] = (len(early), len(late), len(early & late))
    assert ids["hot"][0] > 1 << sk.ENTRIES
    assert found == ids
