"""Sources, sinks, filters, samples and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.catalog import fixtures as fx_tables
from shelfcast.catalog.fixtures import fx
from shelfcast.catalog.registry import query, rounded
from shelfcast.functions import scalars
from shelfcast.operators import credit, filters
from shelfcast.operators.features import PAIR_WEEK, weekly_stats
from shelfcast.operators.hierarchy import HIER1, PCA, PR, P, attach_tiers, fit_tiers
from shelfcast.plans.demand import hierarchy_forecast
from shelfcast.schema import APPLICANT_NUMBERS
from shelfcast.session import fresh_folder
from shelfcast.sources import store, tables

BUCKET = "('0x' || substr(md5({key}), 1, 8))::BIGINT % 10000"


def written_csv(df, purpose: str) -> str:
    """``df`` as CSV files in the shared folder, as a data provider would hand them over."""
    path = fresh_folder(df.sparkSession, purpose) + ".csv"
    df.write.option("header", True).csv(path)
    return path


@query("q_scan_sales", fx("sales") + "SELECT * FROM sales")
def scan_sales(spark, sf_dir):
    return fx_tables.sales(spark, sf_dir)


PRUNED = ["product_id", "agency_id", "route_id", "client_id", "demand"]


@query("q_scan_pruned", fx("sales") + f"SELECT {', '.join(PRUNED)} FROM sales")
def scan_pruned(spark, sf_dir):
    return fx_tables.sales(spark, sf_dir).select(*PRUNED)


@query("q_scan_week_file", fx("sales") + f"SELECT {', '.join(PRUNED)} FROM sales WHERE week = 9")
def scan_week_file(spark, sf_dir):
    """The hold-out week as the CSV file it is delivered in, reading only the columns in use."""
    week = filters.holdout_week(fx_tables.sales(spark, sf_dir))
    return tables.read_table(spark, written_csv(week, "week-nine"), "sales_with_id", columns=PRUNED)


@query("q_scan_clients", fx("clients") + "SELECT * FROM clients")
def scan_clients(spark, sf_dir):
    return tables.read_table(spark, written_csv(fx_tables.clients(spark, sf_dir), "clients"), "clients")


@query("q_scan_brands", fx("brands") + "SELECT * FROM brands")
def scan_brands(spark, sf_dir):
    named = fx_tables.brands(spark, sf_dir).withColumnRenamed("product_id", "PID")
    return tables.read_brands(spark, written_csv(named, "brands"))


@query(
    "q_scan_applicants",
    fx("applicants_all") + "SELECT idx, target_flag, reason, job, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in APPLICANT_NUMBERS) + " FROM applicants_all",
)
def scan_applicants(spark, sf_dir):
    path = written_csv(fx_tables.applicants_all(spark, sf_dir), "applicants")
    return rounded(tables.read_applicants(spark, path))


WEEKLY_SQL = """SELECT {keys}, week, CAST(sum(demand) AS BIGINT) AS {p}_total, round(avg(demand), 6) AS {p}_mean,
       CAST(median(demand) AS DOUBLE) AS {p}_median
FROM sales GROUP BY {keys}, week"""


@query("q_feature_store_roundtrip", fx("sales") + WEEKLY_SQL.format(keys="product_id, client_id", p="pcw"))
def feature_store(spark, sf_dir):
    weekly = weekly_stats(fx_tables.sales(spark, sf_dir), PAIR_WEEK)
    return rounded(store.load_features(spark, store.save_features(weekly, fresh_folder(spark, "features"))))


HIER1_SQL = """, g AS (SELECT avg(demand) - 0.9 AS level FROM sales),
pca AS (SELECT product_id, client_id, agency_id, avg(ln(demand + 1)) AS pca FROM sales GROUP BY ALL),
pr AS (SELECT product_id, route_id, avg(ln(demand + 1)) AS pr FROM sales GROUP BY ALL),
p AS (SELECT product_id, avg(ln(demand + 1)) AS p FROM sales GROUP BY ALL),
hier1 AS (
  SELECT id, coalesce(exp(pca) * 0.70 + 0.7, exp(pr) * 0.76 + 0.1, exp(p) * 0.76 + 0.25, level) AS hp1
  FROM forecast_requests LEFT JOIN pca USING (product_id, client_id, agency_id)
  LEFT JOIN pr USING (product_id, route_id) LEFT JOIN p USING (product_id), g)
"""


def hier1(spark, sf_dir):
    requests, known = fx_tables.forecast_requests(spark, sf_dir), fx_tables.sales(spark, sf_dir)
    return hierarchy_forecast(requests, known, {"hp1": HIER1})


@query(
    "q_submission",
    fx("sales", "forecast_requests") + HIER1_SQL + "SELECT id, round(hp1, 6) AS demand FROM hier1",
)
def submission(spark, sf_dir):
    path = store.write_submission(rounded(hier1(spark, sf_dir)), fresh_folder(spark, "submission"), "hp1")
    return spark.read.schema("id STRING, demand DOUBLE").option("header", True).csv(path)


@query(
    "q_submission_long",
    fx("sales", "forecast_requests") + HIER1_SQL + """
SELECT id, 'hier1' AS model, round(hp1, 6) AS demand FROM hier1
UNION ALL SELECT id, 'shifted' AS model, round(hp1 + 1, 6) AS demand FROM hier1""",
)
def submission_long(spark, sf_dir):
    both = rounded(hier1(spark, sf_dir).withColumn("shifted", F.col("hp1") + 1))
    path = store.write_submissions(
        both, fresh_folder(spark, "submissions"), {"hier1": "hp1", "shifted": "shifted"}
    )
    return spark.read.schema("id STRING, demand DOUBLE, model STRING").option("header", True).csv(path)


@query(
    "q_params_roundtrip",
    "SELECT 8 AS max_depth, CAST(count(*) AS BIGINT) AS rows, round(avg(l_quantity), 6) AS mean_units FROM lineitem",
)
def params_roundtrip(spark, sf_dir):
    row = fx_tables.star(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("rows"), F.round(F.avg("l_quantity"), 6).alias("mean_units")
    ).first()
    path = store.save_params(spark, {"max_depth": 8} | row.asDict(), fresh_folder(spark, "params"))
    loaded = store.load_params(spark, path)
    return spark.createDataFrame([tuple(loaded.values())], "max_depth INT, rows BIGINT, mean_units DOUBLE")


@query(
    "q_demand_filter",
    fx("sales") + """SELECT 'latest' AS bounds, count(*) AS rows FROM sales WHERE demand > -1 AND demand <= 5000
UNION ALL SELECT 'to_1000', count(*) FROM sales WHERE demand > 0 AND demand < 1000
UNION ALL SELECT 'to_100', count(*) FROM sales WHERE demand > 1 AND demand < 100
UNION ALL SELECT 'to_15', count(*) FROM sales WHERE demand > 1 AND demand < 15""",
)
def demand_filter(spark, sf_dir):
    """All ranges counted in one pass."""
    bounds = {
        "latest": filters.in_demand_range(),
        "to_1000": filters.in_demand_range(0, 1000, high_open=True),
        "to_100": filters.in_demand_range(1, 100, high_open=True),
        "to_15": filters.in_demand_range(1, 15, high_open=True),
    }
    counts = fx_tables.sales(spark, sf_dir).agg(*[F.count_if(inside).alias(n) for n, inside in bounds.items()])
    return counts.unpivot([], list(bounds), "bounds", "rows")


@query("q_holdout_week", fx("sales") + "SELECT * FROM sales WHERE week = 9")
def holdout_week(spark, sf_dir):
    return filters.holdout_week(fx_tables.sales(spark, sf_dir))


@query("q_week_range", fx("sales") + "SELECT id, week, demand FROM sales WHERE week > 5 AND week <= 9")
def week_range(spark, sf_dir):
    return filters.week_range(fx_tables.sales(spark, sf_dir)).select("id", "week", "demand")


@query("q_client_subset", fx("sales") + "SELECT id, client_id, demand FROM sales WHERE client_id IN (7, 42, 99, 150)")
def client_subset(spark, sf_dir):
    return filters.for_clients(fx_tables.sales(spark, sf_dir), (7, 42, 99, 150)).select("id", "client_id", "demand")


@query(
    "q_hash_sample",
    fx("sales") + f"SELECT id, week, demand FROM sales WHERE {BUCKET.format(key='id')} < 500",
)
def hash_sample(spark, sf_dir):
    return filters.hash_sample(fx_tables.sales(spark, sf_dir), 0.05).select("id", "week", "demand")


@query(
    "q_exact_sample",
    fx("sales") + """SELECT id, demand FROM sales
QUALIFY row_number() OVER (ORDER BY md5(id), id) <= (SELECT round_even(count(*) * 0.05, 0) FROM sales)""",
)
def exact_sample(spark, sf_dir):
    return filters.exact_sample(fx_tables.sales(spark, sf_dir), 0.05).select("id", "demand")


@query(
    "q_hash_split",
    fx("applicants_train")
    + f"SELECT idx, CASE WHEN {BUCKET.format(key='CAST(idx AS VARCHAR)')} < 7000 THEN 'fit' ELSE 'check' END AS side "
    "FROM applicants_train",
)
def hash_split(spark, sf_dir):
    fit, check = filters.hash_split(fx_tables.applicants_train(spark, sf_dir))
    return fit.select("idx", F.lit("fit").alias("side")).unionByName(check.select("idx", F.lit("check").alias("side")))


@query(
    "q_cap_demand",
    fx("sales") + """SELECT id, CASE WHEN demand > 10 THEN 10 ELSE demand END AS capped_low,
       CASE WHEN demand > 40 THEN 40 ELSE demand END AS capped_high FROM sales""",
)
def cap_demand(spark, sf_dir):
    both = fx_tables.sales(spark, sf_dir).select(
        "id", F.col("demand").alias("capped_low"), F.col("demand").alias("capped_high")
    )
    return filters.cap(both, {"capped_low": 10, "capped_high": 40})


CAP_SQL = ", ".join(
    f"round(CASE WHEN {c} > {v} THEN {v} ELSE {c} END, 6) AS {c}" for c, v in credit.CAPS.items()
)


@query("q_cap_applicants", fx("applicants_all") + f"SELECT idx, {CAP_SQL} FROM applicants_all")
def cap_applicants(spark, sf_dir):
    return rounded(filters.cap(fx_tables.applicants_all(spark, sf_dir).select("idx", *credit.CAPS), credit.CAPS))


@query(
    "q_clean_prediction",
    fx("sales") + """, raw AS (SELECT id, CAST(demand AS DOUBLE) * 50 - 200 AS raw FROM sales)
SELECT id, CASE WHEN raw < 0 THEN 0.0::DOUBLE ELSE raw END AS latest,
       CASE WHEN raw < 0 THEN 3.0::DOUBLE WHEN raw > 1000 THEN 1000.0::DOUBLE ELSE raw END AS earlier FROM raw""",
)
def clean_prediction(spark, sf_dir):
    raw = F.col("demand").cast("double") * 50 - 200
    return fx_tables.sales(spark, sf_dir).select(
        "id",
        scalars.clean_prediction(raw).alias("latest"),
        scalars.clean_prediction(raw, negative=3, cap=1000).alias("earlier"),
    )


ATTACHED_SQL = """, pca AS (SELECT product_id, client_id, agency_id, avg(ln(demand + 1)) AS pca FROM sales GROUP BY ALL),
pr AS (SELECT product_id, route_id, avg(ln(demand + 1)) AS pr FROM sales GROUP BY ALL),
p AS (SELECT product_id, avg(ln(demand + 1)) AS p FROM sales GROUP BY ALL),
attached AS (SELECT id, pca, pr, p FROM forecast_requests LEFT JOIN pca USING (product_id, client_id, agency_id)
             LEFT JOIN pr USING (product_id, route_id) LEFT JOIN p USING (product_id))
"""


def attached(spark, sf_dir):
    tiers = fit_tiers(fx_tables.sales(spark, sf_dir), (PCA, PR, P))
    return attach_tiers(fx_tables.forecast_requests(spark, sf_dir), tiers).select("id", "pca", "pr", "p")


@query(
    "q_fill_features",
    fx("sales", "forecast_requests") + ATTACHED_SQL + """
SELECT id, round(coalesce(pca, 0), 6) AS pca, round(coalesce(pr, 16), 6) AS pr, round(coalesce(p, 7), 6) AS p FROM attached""",
)
def fill_features(spark, sf_dir):
    return rounded(filters.fill_features(attached(spark, sf_dir), {"pca": 0, "pr": 16, "p": 7}))


@query(
    "q_fill_from_column",
    fx("sales", "forecast_requests") + ATTACHED_SQL + """
SELECT id, round(coalesce(pca, p), 6) AS pca, round(coalesce(pr, p), 6) AS pr, round(p, 6) AS p FROM attached""",
)
def fill_from_column(spark, sf_dir):
    return rounded(filters.fill_from(attached(spark, sf_dir), ("pca", "pr"), "p"))


@query(
    "q_fill_median",
    fx("sales") + """, holed AS (SELECT id, CASE WHEN demand > 30 THEN NULL ELSE demand END AS demand FROM sales)
SELECT id, CAST(coalesce(demand, (SELECT median(demand) FROM holed)) AS DOUBLE) AS demand FROM holed""",
)
def fill_median(spark, sf_dir):
    holed = fx_tables.sales(spark, sf_dir).select("id", F.when(F.col("demand") <= 30, F.col("demand")).alias("demand"))
    return filters.fill_median(holed, "demand")


@query(
    "q_row_counts",
    fx("sales", "forecast_requests", "clients") + """SELECT 'sales' AS table_name, count(*) AS rows FROM sales
UNION ALL SELECT 'forecast_requests', count(*) FROM forecast_requests
UNION ALL SELECT 'clients', count(*) FROM clients""",
)
def row_counts(spark, sf_dir):
    named = {n: getattr(fx_tables, n)(spark, sf_dir) for n in ("sales", "forecast_requests", "clients")}
    parts = [filters.row_count(df).select(F.lit(n).alias("table_name"), "rows") for n, df in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "q_scalar_math",
    fx("sales") + """SELECT id, round(ln(demand + 1), 6) AS log_demand, round(greatest(ln(demand + 1), 0), 6) AS target,
       round(exp(ln(demand + 1)) - 1, 6) AS restored, round(demand / 7.0::DOUBLE, 10) AS tenth_place,
       round(exp(demand / 50.0::DOUBLE) - 1, 6) AS grown, abs(CAST(demand AS INT) - 25) AS distance FROM sales""",
)
def scalar_math(spark, sf_dir):
    demand = F.col("demand")
    return rounded(
        fx_tables.sales(spark, sf_dir).select(
            "id",
            scalars.log_demand(demand).alias("log_demand"),
            scalars.log_target(demand).alias("target"),
            scalars.from_log(scalars.log_demand(demand)).alias("restored"),
            (demand / 7).alias("tenth_place"),
            F.expm1(demand / 50).alias("grown"),
            F.abs(demand - 25).alias("distance"),
        ),
        tenth_place=10,
    )
