"""Skewed inputs and samplers against brute force; plan shape of the main jobs."""

import hashlib
import itertools
import math
import random
import statistics
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from shelfcast.catalog import fixtures
from shelfcast.operators import baskets as bk, features as ft, filters, hierarchy as hi, models as md
from shelfcast.operators.skew import find_hot_keys, lookup_join
from shelfcast.plans import demand
from test_semantics import requests, sales_rows


@pytest.fixture(scope="module")
def skewed():
    """One client, one product and one route own more than a third of the rows."""
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        hot = rng.random() < 0.4
        client, product, route = (1, 1, 1) if hot else (rng.randint(2, 60), rng.randint(2, 20), rng.randint(2, 9))
        rows.append((rng.randint(3, 9), route % 3, route, client, product, rng.choice([0, 1, 2, 3, 50])))
    return rows


def test_weekly_medians_with_a_hot_key(spark, skewed):
    groups = defaultdict(list)
    for w, _, r, c, p, d in skewed:
        groups[c, w].append(d)
    out = ft.weekly_stats(sales_rows(spark, skewed), ft.CLIENT_WEEK).collect()
    assert {(r["client_id"], r["week"]): (r["c_total"], r["c_median"]) for r in out} == {
        k: (sum(v), statistics.median(v)) for k, v in groups.items()}


def test_build_features_equals_the_single_tables(spark, skewed):
    known = sales_rows(spark, skewed)
    brands = spark.createDataFrame([(1, "B", 3)], "product_id LONG, brand STRING, cat_brand INT")
    built = ft.build_features(known, brands)
    for table, grain in ((built.client_week, ft.CLIENT_WEEK), (built.route_week, ft.ROUTE_WEEK),
                         (built.pair_week, ft.PAIR_WEEK), (built.product_route_week, ft.PRODUCT_ROUTE_WEEK)):
        single = ft.weekly_stats(known, grain)
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, single.collect()))
    assert sorted(map(tuple, built.pair.collect())) == sorted(map(tuple, ft.pair_stats(known).collect()))


def test_tiers_with_a_hot_key_match_brute_force(spark, skewed):
    wanted = [(10, r % 3, r, c, p) for r in (1, 2, 30) for c in (1, 2, 90) for p in (1, 2, 70)]
    sums = {t.name: defaultdict(list) for t in hi.TIERS}
    place = {"agency_id": 1, "route_id": 2, "client_id": 3, "product_id": 4}
    for row in skewed:
        for t in hi.TIERS:
            sums[t.name][tuple(row[place[k]] for k in t.keys)].append(math.log1p(row[5]))
    level = statistics.mean(r[5] for r in skewed) - 0.9
    out = {r["id"]: r["hp1"] for r in demand.hierarchy_forecast(requests(spark, wanted), sales_rows(spark, skewed),
                                                               {"hp1": hi.HIER1}).collect()}
    for i, row in enumerate(wanted):
        expected = level
        for t, scale, offset in ((hi.P, 0.76, 0.25), (hi.PR, 0.76, 0.1), (hi.PCA, 0.70, 0.7)):
            values = sums[t.name].get(tuple(row[place[k]] for k in t.keys))
            if values:
                expected = math.exp(statistics.mean(values)) * scale + offset
        assert out[f"r{i}"] == pytest.approx(expected)


def test_hot_keys_are_found_and_bounded(spark, skewed):
    hot = find_hot_keys(sales_rows(spark, skewed), [("client_id",), ("product_id", "route_id"), ("week",)], fraction=1.0)
    pieces = math.ceil(4 * 8 * sum(row[3] == 1 for row in skewed) / len(skewed))
    assert [(r["client_id"], r["pieces"]) for r in hot["client_id",].collect()] == [(1, pieces)]
    assert [(r["product_id"], r["route_id"]) for r in hot["product_id", "route_id"].collect()] == [(1, 1)]
    assert ("week",) not in hot
    assert find_hot_keys(sales_rows(spark, skewed[:20]), [("client_id",)]) == {}


def test_salted_joins_give_the_plain_result(spark, skewed):
    known = sales_rows(spark, skewed)
    wanted = requests(spark, [(10 + i % 2, a, r, c, p) for i, (_, a, r, c, p, _) in enumerate(skewed)])
    brands = spark.createDataFrame([(1, "B", 3)], "product_id LONG, brand STRING, cat_brand INT")
    tables = ft.build_features(known, brands)
    hot = find_hot_keys(wanted, [*ft.FEATURE_KEYS, *[t.keys for t in hi.TIERS]], fraction=1.0)
    assert set(hot) == {*ft.FEATURE_KEYS, *[t.keys for t in hi.TIERS]}
    columns = ["id", *ft.PAIR_COLUMNS, *ft.LAG_MEDIANS]
    salted, plain = (ft.model_table(wanted, tables, 9, hot=h).select(columns) for h in (hot, {}))
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))
    salted, plain = (hi.predict_hierarchies(wanted, known, {"h": hi.HIER3}, hot=h) for h in (hot, {}))
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))


def test_a_hot_key_is_split_over_partitions(spark, skewed):
    wanted = requests(spark, [(10, a, r, c, p) for _, a, r, c, p, _ in skewed])
    hot = find_hot_keys(wanted, [("client_id",)], fraction=1.0)
    table = ft.weekly_lookup(ft.weekly_stats(sales_rows(spark, skewed), ft.CLIENT_WEEK), ft.CLIENT_WEEK)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(wanted, table, ["client_id"], hot)
        places = joined.where("client_id = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert places > 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 300), fraction=st.sampled_from([0.0, 0.001, 0.05, 0.5, 1.0]))
def test_exact_sample_takes_the_lowest_hashes(spark, n, fraction):
    df = spark.range(n).select(F.concat(F.lit("k"), "id").alias("id"))
    keys = sorted((f"k{i}" for i in range(n)), key=lambda k: (hashlib.md5(k.encode()).hexdigest(), k))
    got = {r["id"] for r in filters.exact_sample(df, fraction).collect()}
    assert got == set(keys[: round(fraction * n)])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=200))
def test_category_codes_are_ranks(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v LONG").repartition(4)
    got = {r["v"]: r["v_code"] for r in md.category_codes(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values)))}


def test_samples_and_splits_are_whole(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    left, right = filters.hash_split(df, 0.7, key="id")
    assert left.count() + right.count() == 5000 and abs(left.count() - 3500) < 150
    folds = md.with_fold(df, 5).groupBy("fold").count().collect()
    assert len(folds) == 5 and sum(r["count"] for r in folds) == 5000
    assert filters.hash_sample(df, 0.05, salt="x").exceptAll(filters.hash_sample(df, 0.05)).count() > 0


def test_rules_match_brute_force_with_one_hot_item(spark):
    rng = random.Random(3)
    baskets = {c: {1} | {i for i in range(2, 7) if rng.random() < 0.5} for c in range(80)}
    baskets |= {c: {100 + c} for c in range(80, 100)}  # baskets without a frequent item still count
    pairs = spark.createDataFrame([(c, i) for c, items in baskets.items() for i in items], "client_id LONG, product_id LONG")
    freq = Counter(s for items in baskets.values() for k in range(1, 5) for s in itertools.combinations(sorted(items), k))
    frequent = {s: n for s, n in freq.items() if n / 100 >= 0.1}
    found = bk.frequent_itemsets(pairs, 0.1, max_len=4)
    assert {tuple(r["items"]): r["freq"] for r in found.collect()} == frequent
    expected = {}
    for s, n in frequent.items():
        for x in s:
            left = tuple(i for i in s if i != x)
            confidence = n / (freq[left] if left else 100)
            if confidence >= 0.5:
                expected[left, x] = (confidence, confidence / (freq[x,] / 100))
    got = {(tuple(r["antecedent"]), r["consequent"]): (r["confidence"], r["lift"]) for r in bk.rules(found, 0.5).collect()}
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(expected[k]) for k in got)
    assert bk.rules(found, 0.5, include_empty=False).where(F.size("antecedent") == 0).count() == 0


def plan_of(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0] if "== Initial Plan ==" in text else text


def test_feature_tables_scan_the_sales_twice(spark, sf_dir):
    tables = ft.build_features(filters.demand_between(fixtures.sales(spark, sf_dir)), fixtures.brands(spark, sf_dir))
    plan = plan_of(ft.model_table(fixtures.forecast_requests(spark, sf_dir), tables, last_known_week=9))
    assert plan.count("lineitem.parquet") == 3  # two passes over the history and the requests
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_tiers_share_one_pass_over_the_sales(spark, sf_dir):
    attached = hi.attach_tiers(fixtures.forecast_requests(spark, sf_dir), hi.fit_tiers(fixtures.sales(spark, sf_dir)))
    plan = plan_of(attached)
    assert plan.count("lineitem.parquet") == 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_week_filter_and_columns_reach_the_scan(spark, tmp_path, skewed):
    path = str(tmp_path / "sales")
    sales_rows(spark, skewed).write.partitionBy("week").parquet(path)
    df = filters.week_range(filters.demand_between(spark.read.parquet(path))).groupBy("client_id").agg(F.sum("demand"))
    plan = plan_of(df)
    assert "ReadSchema: struct<client_id:bigint,demand:int>" in plan
    assert "GreaterThan(demand,-1)" in plan and "LessThanOrEqual(demand,5000)" in plan
    assert "(week#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
