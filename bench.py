"""Times the headline queries and prints one JSON line.

Reads BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]. Each query runs once to warm up, then three
times; the median counts. Results are forced with a write to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from shelfcast.catalog import QUERIES, fixtures
from shelfcast.operators.features import build_features
from shelfcast.operators.filters import demand_between
from shelfcast.operators.models import BoostParams, fit_boosted
from shelfcast.plans.demand import training_matrix
from shelfcast.session import build_session

HEADLINE = (
    "q_hier1", "q_hier2", "q_hier3", "q_ensemble", "q_submission_long", "q_rmsle_hier",
    "q_feat_pcw", "q_feat_rw", "q_lag_pcw", "q_model_table_test", "q_model_table_train",
    "q_client_sales", "q_products_per_client", "q_exact_sample", "q_itemsets", "q_rules", "q_standardise",
)
REPEATS = 3


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus) if cpus.isdigit() else 16),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = [timed(lambda: force(QUERIES[name](spark, sf_dir))) for _ in range(REPEATS + 1)]
        seconds[name.removeprefix("q_")] = round(statistics.median(runs[1:]), 3)

    # The model fit alone, on the full training matrix: 20 rounds, depth 8.
    sales = demand_between(fixtures.sales(spark, sf_dir))
    matrix = training_matrix(sales, build_features(sales, fixtures.brands(spark, sf_dir)))
    seconds["boosted_fit"] = round(timed(lambda: fit_boosted(matrix, BoostParams(partitions=8))), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
