"""How often rows and tables of the demand features are shuffled."""

import math

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import features as ft
from shelfcast.operators import hierarchy as hi
from shelfcast.operators.models import LATEST_INPUTS, PAIR_MEDIAN_INPUTS
from shelfcast.plans import demand as plan

COLUMNS = "id STRING, week INT, agency_id BIGINT, channel_id INT, route_id BIGINT, client_id BIGINT, product_id BIGINT, demand INT"


@pytest.fixture
def sales(spark):
    rows = [(f"{i}", 3 + i % 7, i % 2, 1, i % 5, i % 11, i % 13, i % 17) for i in range(400)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark.createDataFrame([*rows, *rows[:40]], COLUMNS)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture
def brands(spark):
    return spark.createDataFrame([(i, "b", i % 3) for i in range(9)], "product_id BIGINT, brand STRING, cat_brand INT")


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count(" Exchange ")


def test_pair_tables_meet_rows_without_further_shuffles(sales, brands):
    tables = ft.build_features(sales, brands)
    pair = ft.weekly_lookup(tables.pair_week, ft.PAIR_WEEK).join(tables.pair, list(ft.PAIR))
    # Counts and their rows dealt by pair, for either table.
    assert shuffles(pair) <= 4


def test_training_rows_meet_only_lags_that_are_read(sales, brands):
    tables = ft.build_features(sales, brands)
    rows = ft.model_table(sales, tables, needed=PAIR_MEDIAN_INPUTS)
    assert not [c for c in rows.columns if c.startswith(("c1_", "pr1_", "r1_")) or c.endswith("_mean") and c != "pc_mean"]
    whole = ft.model_table(sales, tables)
    for inputs in (PAIR_MEDIAN_INPUTS, LATEST_INPUTS):
        few = ft.model_table(sales, tables, needed=inputs).select("id", *inputs)
        assert sorted(few.collect()) == sorted(whole.select("id", *inputs).collect())
    assert shuffles(plan.model_table(sales, tables, needed=PAIR_MEDIAN_INPUTS)) < shuffles(whole) - 5


def test_out_of_fold_groups_are_shuffled_once(sales):
    tiers = (hi.PR, hi.P)
    # For either tier: the base sums, the group's sums, and the rows.
    assert shuffles(hi.out_of_fold_features(sales, 3, tiers=tiers)) <= 6
    found = {r["id"]: r["p"] for r in hi.out_of_fold_features(sales, 3, tiers=tiers).collect()}
    folded = sales.withColumn("fold", hi.hash_bucket(F.col("id")) % 3).collect()
    for row in folded:
        others = [math.log1p(r["demand"]) for r in folded if r["product_id"] == row["product_id"] and r["fold"] != row["fold"]]
        scale, offset = hi.TIER_INPUTS["p"]
        assert found[row["id"]] == pytest.approx(math.exp(sum(others) / len(others)) * scale + offset)
