import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shelfcast.operators import models as md
from shelfcast.plans import demand as plan


def test_the_mean_of_the_route_is_an_input(spark):
    """Every pair of product and route occurs once, so only the route's own mean tells its level."""
    lines = spark.range(400).select(
        F.concat(F.lit("i"), "id").alias("id"), (F.col("id") % 3 + 6).cast("int").alias("week"), F.lit(1).alias("agency_id"),
        (F.col("id") % 40).alias("route_id"), F.col("id").alias("client_id"), F.floor(F.col("id") / 40).alias("product_id"),
        F.when(F.col("id") % 40 % 2 == 0, 4).otherwise(49).alias("demand"),
    )
    matrix, rows = plan.stacked_matrices(lines, lines)
    at = md.STACKED_INPUTS.index("r")
    known = rows.select("demand", vector_to_array("features")[at].alias("r")).collect()
    assert len(known) == 400 and all(r["r"] == pytest.approx(r["demand"] + 1) for r in known)
    assert matrix.count() == 400 and matrix.first()["features"].size == len(md.STACKED_INPUTS)
