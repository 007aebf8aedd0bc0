import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfcast.operators import models as md

MANY = (1 << 18) + 50


def test_positions_are_codes_however_many_values(spark):
    """More values than a table of hashes had places: each value keeps a position of its own."""
    rows = spark.range(0, 2 * MANY, 2).select(
        F.col("id").alias("route_id"), (F.col("id") % 3).alias("agency_id"), F.col("id").cast("double").alias("x"))
    first = spark.createDataFrame([(None, 1, 7.0), (6, None, 0.0)], "route_id BIGINT, agency_id BIGINT, x DOUBLE")
    train, few = md.onehot_matrices(rows, first, ["route_id", "agency_id"], ["x"])
    found = train.select("route_id", "agency_id", "x", *md.vector_entries("features"))
    exact = (F.col("at")[0] == F.col("route_id") / 2) & (F.col("at")[1] == MANY + 1 + F.col("agency_id"))
    whole = (F.col("x") == 0) | (F.col("at")[2] == MANY + 5) & (F.col("value")[2] == F.col("x"))
    assert found.agg(F.count_if(exact & whole & (F.col("width") == MANY + 6))).first()[0] == MANY
    at = {r["route_id"]: r["features"] for r in few.collect()}
    assert at[None] == Vectors.sparse(MANY + 6, [MANY, MANY + 2, MANY + 5], [1.0, 1.0, 7.0])
    assert at[6] == Vectors.sparse(MANY + 6, [3, MANY + 4], [1.0, 1.0])


def test_trees_split_on_rare_values(spark):
    """One row in sixty thousand has the value that decides; its position is marked as one of zeros and ones."""
    rows = spark.range(60_000).select((F.col("id") == 17).cast("int").alias("c"), F.when(F.col("id") == 17, 9.0).otherwise(1.0).alias("target"))
    ready, _ = md.onehot_matrices(rows, rows, ["c"], marked=True)
    model = md.fit_tree(ready, max_depth=2)
    assert model.predict(Vectors.sparse(3, [1], [1.0])) == pytest.approx(9.0)


def test_a_missing_number_is_an_error(spark):
    rows = spark.createDataFrame([(1, None)], "c INT, x DOUBLE")
    with pytest.raises(Exception, match="x is missing"):
        md.onehot_matrices(rows, rows, ["c"], ["x"])[0].select(vector_to_array("features")).collect()
