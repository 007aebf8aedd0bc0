"""Semantics fixed in the survey, on literal rows."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import scalars
from shelfcast.operators import baskets as bk, credit as cr, ensemble as en, evaluate, explore, features as ft, filters
from shelfcast.operators import hierarchy as hi, models as md
from shelfcast.schema import SALES, TABLES
from shelfcast.sources import store, tables


def sales_rows(spark, rows):
    """Sales from ``(week, agency, route, client, product, demand)`` tuples."""
    full = [(f"s{i}", w, a, 1, r, c, p, d, float(d), 0, 0.0, d) for i, (w, a, r, c, p, d) in enumerate(rows)]
    return spark.createDataFrame(full, f"id STRING, {SALES}")


def requests(spark, rows):
    full = [(f"r{i}", w, a, 1, r, c, p) for i, (w, a, r, c, p) in enumerate(rows)]
    return spark.createDataFrame(full, TABLES["forecast_requests"])


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_sums_skip_missing_values_unless_strict(spark):
    rows = spark.createDataFrame([(1, 10), (1, None), (2, 5)], "k INT, v INT")
    lenient = {r["k"]: r["s"] for r in rows.groupBy("k").agg(F.sum("v").alias("s")).collect()}
    strict = rows.groupBy("k").agg(scalars.strict(F.sum("v"), F.col("v")).alias("s")).collect()
    assert lenient == {1: 10, 2: 5}
    assert {r["k"]: r["s"] for r in strict} == {1: None, 2: 5}


def test_nan_falls_through_a_step(spark):
    df = spark.createDataFrame([("a", float("nan"), 1.0), ("b", 2.0, 1.0)], "id STRING, pca DOUBLE, pr DOUBLE")
    two = hi.Hierarchy((hi.Step((("pca", 1.0),), 0.0), hi.Step((("pr", 1.0),), 0.0)), hi.Fallback())
    out = by_id(df.select("id", hi.step_through(two, F.lit(-1.0)).alias("v")), "v")
    assert out["a"] == pytest.approx(math.e) and out["b"] == pytest.approx(math.e**2)


def test_log_of_minus_one_is_filtered_not_infinite(spark):
    df = sales_rows(spark, [(5, 1, 1, 1, 1, d) for d in (-1, 0, 5000, 5001)])
    kept = filters.demand_between(df)
    assert sorted(r["demand"] for r in kept.collect()) == [0, 5000]
    assert kept.where(scalars.log_demand(F.col("demand")).isNull()).count() == 0


def test_demand_bounds_open_and_closed(spark):
    df = sales_rows(spark, [(5, 1, 1, 1, 1, d) for d in (0, 1, 2, 99, 100)])
    inside = filters.demand_between(df, 1, 100, high_open=True)
    assert sorted(r["demand"] for r in inside.collect()) == [2, 99]
    closed = filters.demand_between(df, 1, 100, low_open=False)
    assert sorted(r["demand"] for r in closed.collect()) == [1, 2, 99, 100]


def test_client_without_units_has_no_rate_or_price(spark):
    df = sales_rows(spark, [(5, 1, 1, 7, 1, 0)])
    names = spark.createDataFrame([(7, "A"), (7, "B"), (8, "C")], TABLES["clients"])
    rows = explore.client_sales(df, names).collect()
    assert [(r["client_name"], r["return_rate"], r["avg_price"]) for r in rows] == [("A", None, None), ("B", None, None)]


def test_multi_counts_rows_not_weeks(spark):
    df = sales_rows(spark, [(5, 1, 1, 1, 1, 3), (5, 1, 1, 2, 1, 3), (5, 1, 2, 2, 1, 4)])
    assert {r["client_id"]: r["multi"] for r in ft.pair_stats(df).collect()} == {1: 0, 2: 1}


def test_even_median_interpolates(spark):
    df = sales_rows(spark, [(5, 1, 1, 1, 1, d) for d in (10, 3, 1, 2)])
    row = ft.weekly_stats(df, ft.CLIENT_WEEK).first()
    assert (row["c_total"], row["c_mean"], row["c_median"]) == (16, 4.0, 2.5)


def test_approximate_median_is_an_input_value(spark):
    df = sales_rows(spark, [(5, 1, 1, 1, 1, d) for d in (10, 3, 1, 2)])
    assert ft.weekly_stats(df, ft.CLIENT_WEEK, approximate=True).first()["c_median"] in (2.0, 3.0)


def test_pair_agency_known_but_product_route_missing(spark):
    known = sales_rows(spark, [(5, 1, 1, 1, 1, 9), (5, 2, 3, 1, 2, 3)])
    wanted = requests(spark, [(10, 1, 2, 1, 1)])
    out = hi.predict_hierarchies(wanted, known, {"h1": hi.HIER1, "h3": hi.HIER3}).first()
    client = math.expm1((math.log1p(9) + math.log1p(3)) / 2)
    assert out["h1"] == pytest.approx(10 * 0.70 + 0.7)
    assert out["h3"] == pytest.approx(client * 0.822 + 0.855)


def test_unknown_request_gets_the_global_level(spark):
    known = sales_rows(spark, [(5, 1, 1, 1, 1, 9), (5, 1, 1, 1, 1, 4), (5, 1, 1, 1, 1, 5)])
    wanted = requests(spark, [(10, 5, 5, 5, 5)])
    out = hi.predict_hierarchies(
        wanted, known, {"mean": hi.HIER1, "july": hi.JULY_AB}, (hi.PCA, hi.PR, hi.P, hi.PC_MEDIAN)
    ).first()
    assert out["mean"] == pytest.approx(6 - 0.9) and out["july"] == 5.0


def test_joins_keep_every_request_once(spark):
    known = sales_rows(spark, [(w, a, r, c, p, w + a + r + c + p) for w in (6, 7, 8, 9) for a in (1, 2) for r in (1, 2)
                               for c in (1, 2, 3) for p in (1, 2)])
    wanted = requests(spark, [(w, a, r, c, p) for w in (10, 11) for a in (1, 3) for r in (1, 4) for c in (1, 9) for p in (1, 7)])
    brands = spark.createDataFrame([(1, "B", 3)], TABLES["brands"])
    table = ft.model_table(wanted, ft.build_features(known, brands), last_known_week=9)
    assert table.count() == wanted.count() == table.select("id").distinct().count()
    pred = hi.predict_hierarchies(wanted, known, {"h": hi.HIER3})
    assert pred.count() == wanted.count() and pred.where("h IS NULL").count() == 0


def test_brand_missing_or_null_is_unknown(spark):
    brands = spark.createDataFrame([(1, "B", 3), (2, None, 4)], TABLES["brands"])
    out = ft.brand_feature(requests(spark, [(10, 1, 1, 1, p) for p in (1, 2, 3)]), brands)
    assert by_id(out, "cat_brand") == {"r0": 3, "r1": 16, "r2": 16}


def test_lag_one_never_passes_the_last_known_week(spark):
    wanted = requests(spark, [(10, 1, 1, 1, 1), (11, 1, 1, 1, 1)])
    rows = ft.lag_weeks(wanted, last_known_week=9).collect()
    assert [(r["prev1"], r["prev2"], r["prev3"]) for r in rows] == [(9, 8, 7), (9, 9, 8)]
    known = sales_rows(spark, [(w, 1, 1, 1, 1, w) for w in (7, 8, 9)])
    lagged = ft.attach_lags(wanted, ft.weekly_stats(known, ft.ROUTE_WEEK), ft.ROUTE_WEEK, ("median",), last_known_week=9)
    assert {r["id"]: (r["r1_median"], r["r2_median"], r["r3_median"]) for r in lagged.collect()} == {
        "r0": (9.0, 8.0, 7.0), "r1": (9.0, 9.0, 8.0)}


def test_lag_of_a_week_without_sales_is_missing(spark):
    known = sales_rows(spark, [(7, 1, 1, 1, 1, 5), (9, 1, 1, 1, 1, 6)])
    lagged = ft.attach_lags(known, ft.weekly_stats(known, ft.PAIR_WEEK), ft.PAIR_WEEK, ("total",))
    assert {r["week"]: (r["pcw1_total"], r["pcw2_total"]) for r in lagged.collect()} == {7: (None, None), 9: (None, 5)}


def test_prediction_cleaning(spark):
    raw = spark.createDataFrame([(-1.0,), (0.0,), (50.0,), (5000.0,), (None,)], "p DOUBLE")
    out = raw.select(scalars.clean_prediction(F.col("p")).alias("a"), scalars.clean_prediction(F.col("p"), 3, 1000).alias("b"))
    assert [(r["a"], r["b"]) for r in out.collect()] == [(0.0, 3.0), (0.0, 0.0), (50.0, 50.0), (5000.0, 1000.0), (None, None)]


def test_caps_leave_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (99.0,), (None,)], "loan DOUBLE")
    assert [r["loan"] for r in filters.cap(df, {"loan": 60.0}).collect()] == [1.0, 60.0, None]


def test_first_submission_wins_over_a_better_later_one(spark):
    board = spark.createDataFrame([(1, 0.9, 1), (1, 0.2, 2), (2, 1.5, 3), (2, 0.1, 4)], TABLES["leaderboard"])
    assert [(r["team_id"], r["score"]) for r in explore.leaderboard_first(board).collect()] == [(1, 0.9)]


def test_label_in_thousands(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 1500, 100000, 20)], "n INT")
    labels = [r[0] for r in df.select(scalars.label_thousands(F.col("n"))).collect()]
    assert labels == ["0 k", "0.001 k", "1.5 k", "100 k", "0.02 k"]


def test_ensemble_stays_between_its_members(spark):
    members = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 10.0), ("b", 5.0, 5.0, 5.0, 5.0)],
                                    "id STRING, boosted DOUBLE, hp1 DOUBLE, hp2 DOUBLE, hp3 DOUBLE")
    a, b = en.ensemble(members).orderBy("id").collect()
    assert a["average_x123"] == 4.0 and a["without_lowest"] == 5.0 and a["without_highest"] == 2.0
    assert {b[c] for c in (*en.AVERAGES, "without_lowest", "without_highest")} == {5.0}
    assert set(en.SUBMISSIONS.values()) <= set(a.asDict())


def test_log_error_clamps_negative_actuals_and_takes_absolute_predictions(spark):
    df = spark.createDataFrame([(-5, 0.0), (3, -3.0)], "actual INT, predicted DOUBLE")
    assert evaluate.rmsle(df, "actual", "predicted", absolute=True).first()["rmsle"] == 0.0


def test_hit_table_counts_the_threshold_as_positive(spark):
    df = spark.createDataFrame([(0.5, 1), (0.49, 1), (0.1, 0)], "p DOUBLE, y INT")
    assert {r["correct"]: r["rows"] for r in evaluate.hit_table(df, "p", "y").collect()} == {1: 2, 0: 1}


def test_best_round_stops_after_patience():
    curve = [5.0, 4.0, 4.5, 4.4, 3.0]
    assert md.best_round(curve) == (5, 3.0)
    assert md.best_round(curve, patience=2) == (2, 4.0)
    assert md.best_round(curve, patience=3) == (5, 3.0)


def test_missing_feature_is_an_error_not_a_dropped_row(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a DOUBLE, b DOUBLE")
    with pytest.raises(Exception, match="null|NULL"):
        md.assemble(df, ["a", "b"]).select("features").collect()


def test_blank_category_is_a_level_of_its_own(spark):
    rows = [(i, float(i % 7), "" if i % 2 else "X", i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame([(i, v, r, int(y)) for i, v, r, y in rows], "idx INT, loan DOUBLE, reason STRING, y INT")
    assert cr.category_levels(df, ["loan", "reason"]) == {"reason": ["", "X"]}
    model = cr.fit_logit(df, ["loan", "reason"], label="y")
    assert [r["term"] for r in model.coefficients(spark).collect()] == ["loan", "reason_1_X", "(intercept)"]
    unseen = df.limit(1).withColumn("reason", F.lit("never seen"))
    assert model.score(unseen).first()["probability"] is not None


def test_imputation_excludes_the_filled_column_and_keeps_known_values(spark):
    rows = [(i, None if i % 10 == 0 else float(i % 4) * 10, float(i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "idx INT, a DOUBLE, b DOUBLE")
    train, test = cr.impute_by_tree(df, df.withColumn("b", F.lit(None).cast("double")), ["a", "b"])
    got = {r["idx"]: (r["a"], r["a_imp_f"]) for r in train.collect()}
    assert all(got[i] == (i % 4 * 10.0, int(i % 10 == 0)) for i in range(200))
    assert test.where("a IS NULL").count() == 0 and "b_imp_f" not in test.columns


def test_csv_scan_is_typed_and_strict(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("client_id,client_name\n1,Ana\n2,\n")
    bad.write_text("client_id,client_name\nx,Ana\n")
    df = tables.read_table(spark, str(good), "clients")
    assert df.dtypes == [("client_id", "bigint"), ("client_name", "string")] and df.count() == 2
    assert tables.read_table(spark, str(good), "clients", columns=["client_name"]).columns == ["client_name"]
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        tables.read_table(spark, str(bad), "clients").collect()
    swapped = tmp_path / "swapped.csv"
    swapped.write_text("client_name,client_id\nAna,1\n")
    with pytest.raises(Exception):
        tables.read_table(spark, str(swapped), "clients").collect()


def test_blank_reason_survives_the_file(spark, tmp_path):
    path = tmp_path / "applicants.csv"
    path.write_text(",".join(["idx", "target_flag", "loan", "mortdue", "value", "reason", "job", "yoj", "derog", "delinq",
                              "clage", "ninq", "clno", "debtinc"]) + "\n1,0,10,,3,,Office,1,0,0,1,0,1,\n")
    row = tables.read_applicants(spark, str(path)).first()
    assert row["reason"] == "" and row["mortdue"] is None and row["debtinc"] is None


def test_feature_store_is_laid_out_by_week(spark, tmp_path):
    known = sales_rows(spark, [(w, 1, 1, 1, 1, w) for w in (7, 8, 9)])
    path = store.save_features(ft.weekly_stats(known, ft.CLIENT_WEEK), str(tmp_path / "cw"))
    assert {p.name for p in (tmp_path / "cw").iterdir() if p.is_dir()} == {"week=7", "week=8", "week=9"}
    pruned = store.load_features(spark, path).where("week = 8")
    assert "PartitionFilters: [isnotnull(week" in pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.first()["c_total"] == 8


def test_params_roundtrip(spark, tmp_path):
    params = {"max_depth": 8, "eta": 0.25}
    assert store.load_params(spark, store.save_params(spark, params, str(tmp_path / "p"))) == params


def test_submission_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "id STRING, hp1 DOUBLE, hp2 DOUBLE")
    store.write_submissions(df, str(tmp_path / "many"), {"one": "hp1", "two": "hp2"})
    assert {p.name for p in (tmp_path / "many").iterdir() if p.is_dir()} == {"model=one", "model=two"}
    store.write_submission(df, str(tmp_path / "single"), "hp2")
    lines = [p.read_text().splitlines() for p in (tmp_path / "single").glob("part-*")]
    assert all(part[0] == "id,demand" for part in lines) and [r for part in lines for r in part[1:]] == ["a,2.0"]


def test_basket_duplicates_and_pairs(spark):
    lines = spark.createDataFrame([(1, 5, 9), (1, 5, 9), (1, 6, 9), (2, 5, 8)], "client_id LONG, product_id LONG, week INT")
    assert {(r["client_id"], r["product_id"]) for r in bk.basket_pairs(lines).collect()} == {(1, 5), (1, 6)}
    assert {r["client_id"]: r["duplicates"] for r in bk.basket_duplicates(lines).collect()} == {1: 1, 2: 0}


def test_fill_median_counts_every_row(spark):
    values = [1, 1, 1, 9, None, None]
    df = spark.createDataFrame([(v,) for v in values], "demand INT")
    expected = statistics.median([v for v in values if v is not None])
    assert sorted(r["demand"] for r in filters.fill_median(df, "demand").collect()) == sorted([1, 1, 1, 9, expected, expected])
