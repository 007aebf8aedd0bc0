from pyspark.sql import functions as F

from shelfcast.catalog import fixtures
from shelfcast.catalog.models import PUBLISHED, written_forecast
from shelfcast.operators.ensemble import SUBMISSIONS
from shelfcast.operators.models import LEAST_PARTITIONS, ROWS_PER_PARTITION, partitions_for


def test_rounds_from_folds_and_every_file(spark, sf_dir):
    result, files = written_forecast(spark, sf_dir)
    assert PUBLISHED.rounds == 500 and result.tuning is not None
    assert result.model.getNumTrees == result.tuning.best_round
    actual = fixtures.planted_outcomes(spark, sf_dir)
    error = F.sqrt(F.avg(F.pow(F.log1p("demand") - F.log1p("actual"), 2)))
    by_model = files.join(actual, "id").groupBy("model").agg(
        F.count("demand").alias("rows"), F.count_distinct("id").alias("ids"), F.min("demand").alias("least"), error.alias("error")
    )
    found = {r["model"]: r for r in by_model.collect()}
    wanted = fixtures.forecast_requests(spark, sf_dir).count()
    print({m: (r["rows"], round(r["error"], 4)) for m, r in found.items()}, result.tuning.best_round, result.tuning.best_error)
    assert set(found) == set(SUBMISSIONS)
    for r in found.values():
        assert r["rows"] == r["ids"] == wanted and r["least"] >= 0
        assert r["error"] < 1.2 * found["hier1"]["error"]


def test_partitions_grow_with_rows():
    assert partitions_for(0) == partitions_for(LEAST_PARTITIONS * ROWS_PER_PARTITION) == LEAST_PARTITIONS
    assert partitions_for(100 * ROWS_PER_PARTITION + 1) == 101
