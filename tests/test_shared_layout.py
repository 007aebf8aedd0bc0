"""What the boosted forecasts shuffle and write."""

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import features as ft, models as md
from shelfcast.plans import demand as plan
from shelfcast.sources import store
from test_moved import brands, sales  # noqa: F401

SMALL = md.BoostParams(rounds=6, max_depth=3, partitions=0)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def matrix(spark):
    rows = spark.range(900).select(
        F.concat(F.lit("i"), "id").alias("id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11).cast("double").alias("y"),
        (F.col("id") % 7 + 0.1 * (F.col("id") % 5)).alias("target"))
    return md.with_fold(md.assemble(rows, ["x", "y"]), 3).select("fold", "features", "target")


def test_all_fits_share_one_layout(spark, matrix, monkeypatch):
    laid, laid_out = [], md.laid_out
    monkeypatch.setattr(md, "laid_out", lambda *args: laid.append(laid_out(*args)) or laid[-1])
    model, tuning = md.fit_tuned(matrix, SMALL, 3)
    assert len(laid) == 1 and model.getNumTrees == tuning.best_round
    # Neither the two plans of a fit nor those of the folds shuffle.
    assert "Exchange" not in laid[0]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.undo()
    alone = md.fit_boosted(matrix.repartition(3), md.replace(SMALL, rounds=tuning.best_round))
    assert alone.toDebugString.split("\n")[1:] == model.toDebugString.split("\n")[1:]


def test_training_rows_and_requests_meet_stored_tables_together(sales, brands):  # noqa: F811
    known, asked = sales.where("week <= 8"), sales.where("week = 9").withColumn("week", F.lit(10)).drop("demand")
    tables = ft.build_features(known, brands)
    matrix, table = plan.shared_table(known, asked, tables, 8, 4, 8, folds=3)
    wanted = plan.training_matrix(known, tables, 4, 8, folds=3)
    assert rows_of(matrix) == rows_of(wanted.select(matrix.columns)) and "id" not in matrix.columns
    alone = ft.model_table(asked, tables, 8, needed=md.LATEST_INPUTS)
    assert rows_of(table.select("id", *md.LATEST_INPUTS)) == rows_of(alone.select("id", *md.LATEST_INPUTS))


def test_folds_take_the_place_of_ids(sales):  # noqa: F811
    lines = sales.dropDuplicates(["id"])
    plain, _ = plan.stacked_matrices(lines, lines, 5)
    folded, _ = plan.stacked_matrices(lines, lines, 5, 3)
    assert folded.columns == ["fold", "features", "target"]
    assert rows_of(folded) == rows_of(md.with_fold(plain, 3).select(folded.columns))


def test_written_predictions_go_to_files_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "files")
    kept = store.save_features(spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 3.5)], "id STRING, x DOUBLE, y DOUBLE"), str(tmp_path / "kept"))
    df = spark.read.parquet(kept)
    for models in ({"old": "x"}, {"one": "x", "two": "y"}):
        store.write_submissions(df, path, models, written=True)
    found = spark.read.schema("id STRING, demand DOUBLE, model STRING").option("header", True).csv(path)
    assert rows_of(found) == rows_of(store.submission_long(df, {"one": "x", "two": "y"}).select("id", "demand", "model"))


def test_large_fits_have_few_partitions():
    """A hundred million rows had a thousand partitions, each of which shuffled the statistics of every node."""
    assert [md.boosted_partitions(n) for n in (0, 2_000_000, 2_700_000, 16_500_000, 99_000_000)] == [8, 8, 11, 48, 50]
