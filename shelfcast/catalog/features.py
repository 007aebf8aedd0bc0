"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.catalog import fixtures as fx_tables
from shelfcast.catalog.fixtures import fx
from shelfcast.catalog.registry import query, rounded
from shelfcast.catalog.scans import BUCKET
from shelfcast.catalog.scans import WEEKLY_SQL
from shelfcast.operators import features as ft
from shelfcast.operators.filters import demand_between, week_range
from shelfcast.operators.hierarchy import out_of_fold_features, tier_features
from shelfcast.schema import SALES_COLUMNS
from shelfcast.session import cut_lineage, fresh_folder
from shelfcast.sources import store

GRAINS = {"pcw": ft.PAIR_WEEK, "cw": ft.CLIENT_WEEK, "rw": ft.ROUTE_WEEK, "prw": ft.PRODUCT_ROUTE_WEEK}
LAST_WEEK = 9


def history(spark, sf_dir):
    return demand_between(fx_tables.sales(spark, sf_dir))


def weekly_sql(grain: ft.Grain) -> str:
    """Weekly statistics as a named table, unrounded."""
    keys, p = ", ".join(grain.keys), grain.prefix
    return f"""w_{p} AS (SELECT {keys}, week, CAST(sum(demand) AS BIGINT) AS total, avg(demand) AS mean,
       CAST(median(demand) AS DOUBLE) AS median FROM sales GROUP BY {keys}, week)"""


def lag_joins(grain: ft.Grain, lags: dict[int, str], base: str = "b") -> str:
    """One left join per lag, in the long form the map lookup replaces."""
    p = grain.prefix
    return "\n".join(
        f"LEFT JOIN w_{p} {p}{k} ON "
        + " AND ".join(f"{base}.{key} = {p}{k}.{key}" for key in grain.keys)
        + f" AND {p}{k}.week = {week}"
        for k, week in lags.items()
    )


def lag_select(grain: ft.Grain, fill: set[str]) -> str:
    out = []
    for k in ft.LAGS:
        for s in ft.STATS:
            name = f"{grain.prefix}{k}_{s}"
            value = f"{grain.prefix}{k}.{s}"
            value = f"coalesce({value}, 0)" if name in fill else value
            out.append(f"{value} AS {name}" if s == "total" else f"round({value}, 6) AS {name}")
    return ",\n       ".join(out)


TRAIN_LAGS = {1: "b.week - 1", 2: "b.week - 2", 3: "b.week - 3"}
TEST_LAGS = {1: f"{LAST_WEEK}", 2: "b.week - 2", 3: "b.week - 3"}

for _name, _grain in GRAINS.items():

    @query(f"q_feat_{_name}", fx("sales") + WEEKLY_SQL.format(keys=", ".join(_grain.keys), p=_grain.prefix))
    def weekly(spark, sf_dir, grain=_grain):
        return rounded(ft.weekly_stats(history(spark, sf_dir), grain))

    @query(
        f"q_lag_{_name}",
        fx("sales", "forecast_requests")
        + f", {weekly_sql(_grain)}\nSELECT b.id, {lag_select(_grain, set())}\nFROM forecast_requests b\n"
        + lag_joins(_grain, TEST_LAGS),
    )
    def lagged(spark, sf_dir, grain=_grain):
        requests = fx_tables.forecast_requests(spark, sf_dir)
        table = ft.weekly_stats(history(spark, sf_dir), grain)
        joined = ft.attach_lags(requests, table, grain, last_known_week=LAST_WEEK)
        return rounded(joined.select("id", *ft.lag_columns(grain)))


PAIR_SQL = """pairs AS (SELECT product_id, client_id, CAST(sum(demand) AS BIGINT) AS pc_total, avg(demand) AS pc_mean,
       CAST(median(demand) AS DOUBLE) AS pc_median,
       CAST(CASE WHEN stddev_samp(demand) IS NULL THEN 0 ELSE 1 END AS INT) AS multi
FROM sales GROUP BY product_id, client_id)"""


@query(
    "q_feat_pc",
    fx("sales") + f", {PAIR_SQL}\nSELECT product_id, client_id, pc_total, round(pc_mean, 6) AS pc_mean, "
    "pc_median, multi FROM pairs",
)
def pair_features(spark, sf_dir):
    return rounded(ft.pair_stats(history(spark, sf_dir)))


@query(
    "q_pair_attach",
    fx("sales", "forecast_requests") + f", {PAIR_SQL}\nSELECT id, multi, pc_total, round(pc_mean, 6) AS pc_mean, "
    "pc_median FROM forecast_requests LEFT JOIN pairs USING (product_id, client_id)",
)
def pair_attach(spark, sf_dir):
    pairs = ft.pair_stats(history(spark, sf_dir))
    joined = ft.attach_pair_features(fx_tables.forecast_requests(spark, sf_dir), pairs)
    return rounded(joined.select("id", *ft.PAIR_COLUMNS))


@query(
    "q_lag_weeks",
    fx("sales", "forecast_requests") + """SELECT id, CAST(9 AS INT) AS prev1, CAST(week - 2 AS INT) AS prev2,
       CAST(week - 3 AS INT) AS prev3 FROM forecast_requests
UNION ALL SELECT id, week - 1, week - 2, week - 3 FROM sales""",
)
def lag_weeks(spark, sf_dir):
    requests = ft.lag_weeks(fx_tables.forecast_requests(spark, sf_dir), last_known_week=LAST_WEEK)
    rows = ft.lag_weeks(fx_tables.sales(spark, sf_dir))
    columns = ["id", "prev1", "prev2", "prev3"]
    return requests.select(columns).unionByName(rows.select(columns))


BRAND_SQL = "CASE WHEN brand IS NULL THEN 16 ELSE cat_brand END"


@query(
    "q_brand_fill",
    fx("forecast_requests", "brands")
    + f"SELECT id, product_id, {BRAND_SQL} AS cat_brand FROM forecast_requests LEFT JOIN brands USING (product_id)",
)
def brand_fill(spark, sf_dir):
    requests, brands = fx_tables.forecast_requests(spark, sf_dir), fx_tables.brands(spark, sf_dir)
    return ft.brand_feature(requests, brands).select("id", "product_id", "cat_brand")


@query("q_log_target", fx("sales") + "SELECT id, round(greatest(ln(demand + 1), 0), 6) AS target FROM sales")
def log_target(spark, sf_dir):
    known = fx_tables.sales(spark, sf_dir)
    return rounded(known.select("id", ft.log_target(F.col("demand")).alias("target")))


FILLED = set(ft.ZERO_FILLED)
TABLE_COLUMNS = (
    "id", "week", "agency_id", "channel_id", "route_id", "client_id", "product_id", "cat_brand", *ft.PAIR_COLUMNS,
    *[c for g in GRAINS.values() for c in ft.lag_columns(g)],
)


def model_table_sql(source: str, where: str, lags: dict[int, str], target: str) -> str:
    tables = ",\n".join(weekly_sql(g) for g in GRAINS.values())
    selects = ",\n       ".join(lag_select(g, FILLED) for g in GRAINS.values())
    joins = "\n".join(lag_joins(g, lags) for g in GRAINS.values())
    return f"""{fx("sales", "forecast_requests", "brands")}, {PAIR_SQL},
{tables}
SELECT b.id, b.week, b.agency_id, 1.0::DOUBLE AS channel_id, b.route_id, b.client_id, b.product_id,
       {BRAND_SQL} AS cat_brand, coalesce(multi, 0) AS multi, coalesce(pc_total, 0) AS pc_total,
       round(coalesce(pc_mean, 0), 6) AS pc_mean, coalesce(pc_median, 0) AS pc_median,
       {selects}{target}
FROM {source} b LEFT JOIN brands ON b.product_id = brands.product_id
LEFT JOIN pairs ON b.product_id = pairs.product_id AND b.client_id = pairs.client_id
{joins}
{where}"""


@query(
    "q_model_table_train",
    model_table_sql(
        "sales", "WHERE b.week > 5 AND b.week <= 9", TRAIN_LAGS, ",\n       round(greatest(ln(demand + 1), 0), 6) AS target"
    ),
)
def model_table_train(spark, sf_dir):
    """Order lines meet their orders once; the features and the rows they are attached to read the written lines."""
    known = cut_lineage(history(spark, sf_dir).select(*SALES_COLUMNS))
    tables = ft.build_features(known, fx_tables.brands(spark, sf_dir), written=True)
    return rounded(ft.model_table(week_range(known), tables).select(*TABLE_COLUMNS, "target"))


@query("q_model_table_test", model_table_sql("forecast_requests", "", TEST_LAGS, ""))
def model_table_test(spark, sf_dir):
    tables = ft.build_features(history(spark, sf_dir), fx_tables.brands(spark, sf_dir))
    requests = fx_tables.forecast_requests(spark, sf_dir)
    return rounded(ft.model_table(requests, tables, last_known_week=LAST_WEEK).select(*TABLE_COLUMNS))


@query("q_matrix_store_roundtrip", model_table_sql("forecast_requests", "", TEST_LAGS, ""))
def matrix_store(spark, sf_dir):
    """The model-ready request table, stored by week and read back."""
    path = store.save_features(model_table_test(spark, sf_dir), fresh_folder(spark, "request-matrix"))
    return store.load_features(spark, path).select(*TABLE_COLUMNS)


@query(
    "q_tier_features",
    fx("sales", "forecast_requests") + """
, pca AS (SELECT product_id, client_id, agency_id, exp(avg(ln(demand + 1))) * 0.75 + 0.75 AS pca FROM sales GROUP BY ALL),
pr AS (SELECT product_id, route_id, exp(avg(ln(demand + 1))) * 0.8 + 0.1 AS pr FROM sales GROUP BY ALL),
p AS (SELECT product_id, exp(avg(ln(demand + 1))) * 1.15 + 0.25 AS p FROM sales GROUP BY ALL)
SELECT id, round(coalesce(pca, p), 6) AS pca, round(coalesce(pr, p), 6) AS pr, round(coalesce(p, 7), 6) AS p
FROM forecast_requests LEFT JOIN pca USING (product_id, client_id, agency_id)
LEFT JOIN pr USING (product_id, route_id) LEFT JOIN p USING (product_id)""",
)
def tier_inputs(spark, sf_dir):
    requests, known = fx_tables.forecast_requests(spark, sf_dir), fx_tables.sales(spark, sf_dir)
    return rounded(tier_features(requests, known).select("id", "pca", "pr", "p"))


def others_sql(name: str, keys: str, scale: float, offset: float) -> str:
    """Scaled group means of each row without the rows of its own fold."""
    return f"""{name} AS (SELECT id, CASE WHEN n_all > n THEN exp((s_all - s) / (n_all - n)) * {scale} + {offset} END AS {name} FROM (
  SELECT id, sum(y) OVER (PARTITION BY {keys}) AS s_all, count(y) OVER (PARTITION BY {keys}) AS n_all,
         sum(y) OVER (PARTITION BY {keys}, fold) AS s, count(y) OVER (PARTITION BY {keys}, fold) AS n FROM folded))"""


@query(
    "q_out_of_fold",
    fx("sales") + f""", folded AS (SELECT *, ({BUCKET.format(key='id')}) % 5 AS fold, ln(demand + 1) AS y FROM sales),
{others_sql('pca', 'product_id, client_id, agency_id', 0.75, 0.75)},
{others_sql('pr', 'product_id, route_id', 0.8, 0.1)},
{others_sql('p', 'product_id', 1.15, 0.25)}
SELECT id, round(coalesce(pca, p), 6) AS pca, round(coalesce(pr, p), 6) AS pr, round(coalesce(p, 7), 6) AS p
FROM pca JOIN pr USING (id) JOIN p USING (id)""",
)
def out_of_fold(spark, sf_dir):
    """Group means as training inputs, from the other folds."""
    return rounded(out_of_fold_features(fx_tables.sales(spark, sf_dir)).select("id", "pca", "pr", "p"))
