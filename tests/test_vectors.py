from pyspark.ml.linalg import Vectors

from shelfcast.operators import models as md


def test_a_wide_sparse_vector_is_read_by_its_entries(spark):
    """Spread out, a row of this width would take two gigabytes."""
    wide = spark.createDataFrame([(1, Vectors.sparse(1 << 28, [3, 1 << 27], [1.0, 2.5])), (2, Vectors.dense([0.0, 4.0]))], ["id", "features"])
    found = {r["id"]: tuple(r)[1:] for r in wide.select("id", *md.vector_entries("features")).collect()}
    assert found == {1: ([3, 1 << 27], [1.0, 2.5], 1 << 28), 2: ([0, 1], [0.0, 4.0], 2)}


def test_onehot_query_does_not_spread_its_rows_out(spark, sf_dir):
    from shelfcast.catalog import QUERIES

    plan = QUERIES["q_onehot"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan and "sequence(0" not in plan
