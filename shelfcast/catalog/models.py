"""Model queries. Settings with a closed-form answer are compared exactly, the others by contract."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shelfcast.catalog import fixtures as fx_tables
from shelfcast.catalog.fixtures import fx
from shelfcast.catalog.hierarchy import HP1, HP2, HP3, attached_sql, holdout_sql
from shelfcast.catalog.registry import query, rounded
from shelfcast.catalog.scans import BUCKET
from shelfcast.functions.scalars import log_target
from shelfcast.operators import models as md, trees
from shelfcast.operators.ensemble import SUBMISSIONS
from shelfcast.operators.features import build_features
from shelfcast.operators.filters import demand_between
from shelfcast.operators.tuning import SearchSpace, random_search, read_trials
from shelfcast.plans import demand as plan
from shelfcast.session import cut_lineage, fresh_folder
from shelfcast.sources import store

# One tree on one input with few values: every leaf is a group, so the fit is the group mean.
ONE_TREE = md.BoostParams(
    max_depth=8, eta=1.0, gamma=0.0, subsample=1.0, colsample=1.0, min_child=1, rounds=1, partitions=8
)
# The published settings: rounds from five folds of up to 500 rounds with early stopping, partitions from the rows.
PUBLISHED = md.BoostParams(rounds=500, partitions=0)
FOLDS = 5


def agency_rows(spark, sf_dir):
    rows = fx_tables.sales(spark, sf_dir).select("id", "agency_id", log_target(F.col("demand")).alias("target"))
    return md.assemble(rows, ["agency_id"])


def per_agency(model, rows):
    one_each = rows.dropDuplicates(["agency_id"])
    return rounded(model.setPredictionCol("mean_target").transform(one_each).select("agency_id", "mean_target"))


AGENCY_SQL = fx("sales") + """SELECT agency_id, round(avg(greatest(ln(demand + 1), 0)), 6) AS mean_target
FROM sales GROUP BY agency_id"""


@query("q_gbt_group_mean", AGENCY_SQL)
def gbt_group_mean(spark, sf_dir):
    rows = agency_rows(spark, sf_dir)
    return per_agency(md.fit_boosted(rows, ONE_TREE), rows)


@query("q_tree_group_mean", AGENCY_SQL)
def tree_group_mean(spark, sf_dir):
    rows = agency_rows(spark, sf_dir)
    return per_agency(md.fit_tree(rows, max_depth=8), rows)


@query("q_forest_group_mean", AGENCY_SQL)
def forest_group_mean(spark, sf_dir):
    rows = agency_rows(spark, sf_dir)
    return per_agency(md.fit_forest(rows, n_trees=1, mtry=None, max_depth=8, bootstrap=False), rows)


@query(
    "q_cv_folds",
    fx("sales") + f"SELECT id, CAST(({BUCKET.format(key='id')}) % 5 AS INT) AS fold FROM sales",
)
def cv_folds(spark, sf_dir):
    return md.with_fold(fx_tables.sales(spark, sf_dir), 5).select("id", "fold")


@query(
    "q_cv_group_mean",
    fx("sales") + f""", t AS (SELECT agency_id, greatest(ln(demand + 1), 0) AS y,
       ({BUCKET.format(key='id')}) % 3 AS fold FROM sales),
others AS (SELECT f.fold, t.agency_id, avg(y) AS mean FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold
           GROUP BY f.fold, t.agency_id),
errors AS (SELECT t.fold, sqrt(avg(pow(y - mean, 2))) AS rmse FROM t JOIN others o
           ON t.fold = o.fold AND t.agency_id = o.agency_id GROUP BY t.fold)
SELECT CAST(1 AS INT) AS round, round(avg(rmse), 6) AS error FROM errors""",
)
def cv_group_mean(spark, sf_dir):
    result = md.cv_rounds(cut_lineage(agency_rows(spark, sf_dir).select("id", "features", "target")), ONE_TREE, folds=3)
    curve = spark.createDataFrame(list(enumerate(result.curve, start=1)), "round INT, error DOUBLE")
    return rounded(curve)


@query(
    "q_search_ledger",
    fx("sales") + f""", t AS (SELECT agency_id, greatest(ln(demand + 1), 0) AS y,
       ({BUCKET.format(key='id')}) % 3 AS fold FROM sales),
others AS (SELECT f.fold, t.agency_id, avg(y) AS mean FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold
           GROUP BY f.fold, t.agency_id),
errors AS (SELECT t.fold, sqrt(avg(pow(y - mean, 2))) AS rmse FROM t JOIN others o
           ON t.fold = o.fold AND t.agency_id = o.agency_id GROUP BY t.fold)
SELECT CAST(trial AS INT) AS trial, (SELECT count(*) FROM sales) AS rows, CAST(1 AS INT) AS rounds, round(avg(rmse), 6) AS error
FROM errors, (SELECT unnest(range(1, 4)) AS trial) GROUP BY trial""",
)
def search_ledger(spark, sf_dir):
    """A search of three trials that goes on from the ledger of a shorter one; each is a group mean, as SQL has it."""
    matrix = cut_lineage(agency_rows(spark, sf_dir).select("id", "features", "target"))
    space = SearchSpace((8, 8), (1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (1.0, 1.0), (1, 1))
    ledger = fresh_folder(spark, "ledger")
    for trials in (1, 3):
        random_search(matrix, space, trials, base=ONE_TREE, folds=3, ledger=ledger)
    found = read_trials(spark, ledger)
    return rounded(found.select("trial", "rows", F.size("curve").alias("rounds"), F.col("curve")[0].alias("error")))


@query(
    "q_index_categories",
    fx("sales", "forecast_requests") + """, v AS (
  SELECT DISTINCT route_id FROM (SELECT route_id FROM sales UNION ALL SELECT route_id FROM forecast_requests)),
codes AS (SELECT route_id, dense_rank() OVER (ORDER BY route_id) - 1 AS route_id_code FROM v)
SELECT id, route_id_code FROM sales JOIN codes USING (route_id)
UNION ALL SELECT id, route_id_code FROM forecast_requests JOIN codes USING (route_id)""",
)
def index_categories(spark, sf_dir):
    train, test = md.index_categories(
        fx_tables.sales(spark, sf_dir), fx_tables.forecast_requests(spark, sf_dir), ["route_id"]
    )
    return train.select("id", "route_id_code").unionByName(test.select("id", "route_id_code"))


@query(
    "q_assemble",
    fx("forecast_requests") + """SELECT id, CAST(week AS DOUBLE) AS f0, CAST(agency_id AS DOUBLE) AS f1,
       CAST(route_id AS DOUBLE) AS f2, CAST(product_id AS DOUBLE) AS f3, CAST(client_id AS DOUBLE) AS f4, """
    + ", ".join(f"CAST(channel_id = {c} AS INT)::DOUBLE AS f{5 + c}" for c in range(6))
    + ", 0::DOUBLE AS f11, CAST(12 AS INT) AS width FROM forecast_requests",
)
def assemble(spark, sf_dir):
    """Numeric ids and one expanded category: every position of the vector."""
    requests = fx_tables.forecast_requests(spark, sf_dir)
    columns = ["week", "agency_id", "route_id", "product_id", "client_id", "channel_id"]
    values = vector_to_array("features")
    wide = md.fit_assembler(requests, columns, onehot=["channel_id"]).transform(requests).select("id", values.alias("v"))
    return wide.select("id", *[F.get("v", F.lit(i)).alias(f"f{i}") for i in range(12)], F.size("v").alias("width"))


ONE_HOT = ("week", "agency_id", "route_id")


def positions_sql(tables: str) -> str:
    """Positions of the ones of each row: a place per value of each category and one for NULL, side by side."""
    codes = [f"codes_{c} AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS code, count(*) OVER () AS size FROM ("
             f"SELECT {c} FROM sales UNION SELECT {c} FROM forecast_requests))" for c in ONE_HOT]
    start, places = "0", []
    for c in ONE_HOT:
        places.append(f"{start} + codes_{c}.code")
        start += f" + codes_{c}.size + 1"
    joins = " ".join(f"JOIN codes_{c} USING ({c})" for c in ONE_HOT)
    shown = ", ".join(f"CAST({p} AS INT) AS at_{c}" for p, c in zip(places, ONE_HOT))
    return f"{tables}, {', '.join(codes)}\nSELECT id, {shown}, CAST({start} + 1 AS INT) AS width FROM forecast_requests {joins}"


@query("q_onehot", positions_sql(fx("sales", "forecast_requests")))
def onehot(spark, sf_dir):
    """All positions of the sparse one-hot matrix; the channel follows as a number."""
    requests = fx_tables.forecast_requests(spark, sf_dir)
    _, rows = md.onehot_matrices(fx_tables.sales(spark, sf_dir), requests, ONE_HOT, ["channel_id"])
    found = rows.select("id", *md.vector_entries("features"))
    ones = F.filter(F.arrays_zip("at", "value"), lambda e: (e["value"] == 1) & (e["at"] < F.col("width") - 1))
    found = found.select("id", ones["at"].alias("at"), "width")
    return found.select("id", *[F.get("at", F.lit(i)).alias(f"at_{c}") for i, c in enumerate(ONE_HOT)], "width")


@query("q_onehot_group_mean", AGENCY_SQL)
def onehot_group_mean(spark, sf_dir):
    """A tree on one-hot codes that is deep enough isolates every value."""
    rows = fx_tables.sales(spark, sf_dir).select("id", "agency_id", log_target(F.col("demand")).alias("target"))
    ready, _ = md.onehot_matrices(rows, rows, ["agency_id"], marked=True)
    return per_agency(md.fit_tree(ready, max_depth=12), ready)


def planted_lines(spark, sf_dir, known_only=False):
    """Lines with planted demand, written once: the order lines meet their orders in one pass."""
    lines = fx_tables.sales(spark, sf_dir) if known_only else fx_tables.sales_all(spark, sf_dir)
    return plan.written_sales(fx_tables.planted(lines))


def sales_of(lines):
    return lines.where(F.col("week") <= 9)


def requests_of(lines):
    return lines.where(F.col("week") >= 10).drop("demand")


def full_forecast(spark, sf_dir, lines):
    return plan.forecast(
        sales_of(lines), requests_of(lines), fx_tables.brands(spark, sf_dir), PUBLISHED, tune_folds=FOLDS, written=True
    )


@query(
    "q_gbt_contract",
    fx("planted_sales", "planted_outcomes") + """, c AS (
  SELECT avg(greatest(ln(demand + 1), 0)) AS level FROM planted_sales WHERE week > 5)
SELECT count(*) AS rows, count(DISTINCT id) AS ids, 0::BIGINT AS missing, 0::BIGINT AS negative, 0::BIGINT AS outside,
       round(sqrt(avg(pow(ln(actual + 1) - level, 2))), 6) AS constant_rmsle, CAST(1 AS INT) AS learns
FROM planted_outcomes, c""",
)
def gbt_contract(spark, sf_dir):
    """The whole forecast: one row per request, no missing or negative value, averages between the extremes.

    ``learns``: its error is below half of that of the best constant, which SQL computes as well.
    """
    lines = planted_lines(spark, sf_dir)
    known = sales_of(lines).where(F.col("week") > 5)
    level = known.agg(F.avg(log_target(F.col("demand"))).alias("level")).scalar()
    outcomes = lines.where(F.col("week") >= 10).select("id", F.col("demand").alias("actual"))
    out = full_forecast(spark, sf_dir, lines).predictions.join(outcomes, "id", "left")
    slack = F.lit(1e-9)
    outside = (F.col("average_x123") < F.col("min_prediction") - slack) | (
        F.col("average_x123") > F.col("max_prediction") + slack
    )
    error = lambda p: F.sqrt(F.avg(F.pow(F.log1p("actual") - p, 2)))
    totals = out.withColumn("level", level).agg(
        F.count("*").alias("rows"),
        F.count_distinct("id").alias("ids"),
        F.count_if(F.col("boosted").isNull()).alias("missing"),
        F.count_if(F.col("boosted") < 0).alias("negative"),
        F.count_if(outside).alias("outside"),
        error(F.col("level")).alias("constant_rmsle"),
        error(F.log1p("boosted")).alias("error"),
    )
    return rounded(totals.withColumn("learns", (F.col("error") < 0.5 * F.col("constant_rmsle")).cast("int")).drop("error"))


BACKOFF_FILES = ("hier1", "hier2", "hier3", "hier12", "hier123")


def written_forecast(spark, sf_dir):
    """The forecast from stored features, and all its prediction files, read again."""
    lines, brands = planted_lines(spark, sf_dir), fx_tables.brands(spark, sf_dir)
    made = build_features(demand_between(sales_of(lines)), brands, written=True)
    kept = store.save_feature_set(made, fresh_folder(spark, "features"))
    result = plan.forecast(
        sales_of(lines), requests_of(lines), brands, PUBLISHED, tune_folds=FOLDS,
        features=store.load_feature_set(spark, kept), written=True,
    )
    path = plan.write_forecast(result, fresh_folder(spark, "forecast"))
    return result, spark.read.schema("id STRING, demand DOUBLE, model STRING").option("header", True).csv(path)


MIXED_FILES = tuple(m for m in SUBMISSIONS if m not in BACKOFF_FILES and m != "boosted")


@query(
    "q_forecast_files",
    attached_sql(fx("planted_sales", "forecast_requests"), "planted_sales") + f""",
hp AS (SELECT id, {HP1} AS hier1, {HP2} AS hier2, {HP3} AS hier3 FROM attached, g),
wide AS (SELECT *, (hier1 + hier2) / 2 AS hier12, (hier1 + hier2 + hier3) / 3 AS hier123 FROM hp)
SELECT id, model, round(demand, 6) AS demand, 0::DOUBLE AS deviation
FROM wide UNPIVOT (demand FOR model IN ({', '.join(BACKOFF_FILES)}))
UNION ALL SELECT id, model, NULL, 0::DOUBLE
FROM forecast_requests, (SELECT unnest([{', '.join(f"'{m}'" for m in ('boosted', *MIXED_FILES))}]) AS model)""",
)
def forecast_files(spark, sf_dir):
    """From stored features to all thirteen prediction files.

    The back-off files are compared by value. Of the others, ``deviation`` is the distance from what the boosted and
    back-off files of the same request give; the boosted file's is 0 where its demand is a number of 0 or more.
    """
    _, files = written_forecast(spark, sf_dir)
    # The files are moved once: all lines of a request come together, and apart again beside its members.
    members = F.map_from_entries(F.collect_list(F.when(F.col("model").isin("boosted", "hier1", "hier2", "hier3"), F.struct("model", "demand"))))
    lines = files.where(F.col("id").isNotNull()).repartition("id")
    parts = lines.groupBy("id").agg(F.collect_list(F.struct("model", "demand")).alias("lines"), members.alias("m"))
    x, h1, h2, h3 = (F.col("m")[c] for c in ("boosted", "hier1", "hier2", "hier3"))
    whole, low, high = x + h1 + h2 + h3, F.least(x, h1, h2, h3), F.greatest(x, h1, h2, h3)
    expected = {
        "boosted": F.greatest(x, F.lit(0.0)), "boosted_hier1": (x + h1) / 2, "boosted_hier2": (x + h2) / 2,
        "boosted_hier3": (x + h3) / 2, "boosted_hier12": (x + h1 + h2) / 3, "boosted_hier123": whole / 4,
        "minus_low": (whole - low) / 3, "minus_high": (whole - high) / 3,
    }
    wanted = F.coalesce(*[F.when(F.col("model") == m, v) for m, v in expected.items()])
    deviation = F.when(F.col("model").isin(*BACKOFF_FILES), F.lit(0.0)).otherwise(F.abs(F.col("demand") - wanted))
    shown = F.when(F.col("model").isin(*BACKOFF_FILES), F.col("demand"))
    lined = parts.select("id", "m", F.inline("lines"))
    return rounded(lined.select("id", "model", shown.alias("demand"), F.round(deviation, 6).alias("deviation")))


@query(
    "q_importance_contract",
    f"""SELECT {len(md.LATEST_INPUTS)}::BIGINT AS inputs, 1::DOUBLE AS total, {len(md.LATEST_INPUTS)}::BIGINT AS names,
       CAST(1 AS INT) AS agrees, CAST(1 AS INT) AS planted_lead""",
)
def importance_contract(spark, sf_dir):
    """Importances from the node table: they are shares, equal the model's own, and those of the planted effect lead.

    Demand is planted by route and agency, so the route and its lags, those of product and route and of the pair, and
    the agency hold more than half; a model that has learned nothing has no gains at all.
    """
    model = full_forecast(spark, sf_dir, planted_lines(spark, sf_dir)).model
    nodes = cut_lineage(trees.tree_nodes(spark, model, md.LATEST_INPUTS))
    own = md.importance(spark, model, md.LATEST_INPUTS).withColumnRenamed("importance", "own")
    table = trees.importance_of(nodes, md.LATEST_INPUTS).join(own, "feature")
    by_route = F.col("feature").rlike("^(route_id|agency_id|r[0-9]_.*|pr[0-9]_.*|pcw[0-9]_.*)$")
    return rounded(
        table.agg(
            F.count("*").alias("inputs"),
            F.sum("importance").alias("total"),
            F.count_distinct("feature").alias("names"),
            (F.max(F.abs(F.col("importance") - F.col("own"))) < 1e-9).cast("int").alias("agrees"),
            (F.sum(F.when(by_route, F.col("importance"))) > 0.5).cast("int").alias("planted_lead"),
        )
    )


HOLDOUT_CONSTANT_SQL = fx("planted_sales") + """, actual AS (SELECT * FROM planted_sales WHERE week = 9),
c AS (SELECT avg(greatest(ln(demand + 1), 0)) AS level FROM planted_sales WHERE week BETWEEN {first} AND 8)
SELECT count(*) AS rows, CAST(sum(demand) AS BIGINT) AS actual_total, 0::BIGINT AS missing, 0::BIGINT AS negative,
       round(sqrt(avg(pow(ln(demand + 1) - level, 2))), 6) AS constant_rmsle, CAST(1 AS INT) AS learns FROM actual, c"""


CONTRACT = ("rows", "actual_total", "missing", "negative", "constant_rmsle", "learns")


def holdout_contract(scored, known, first):
    """Totals of the hold-out, and whether the error is below half of the best constant's, which SQL computes as well."""
    return rounded(holdout_totals(scored, known, first).select(*CONTRACT))


def holdout_totals(scored, known, first):
    train = known.where(F.col("week").between(first, 8))
    level = train.agg(F.avg(log_target(F.col("demand"))).alias("level")).scalar()
    error = lambda p: F.sqrt(F.avg(F.pow(F.log1p("demand") - p, 2)))
    totals = scored.withColumn("level", level).agg(
        F.count("*").alias("rows"),
        F.sum("demand").alias("actual_total"),
        F.count_if(F.col("boosted").isNull()).alias("missing"),
        F.count_if(F.col("boosted") < 0).alias("negative"),
        error(F.col("level")).alias("constant_rmsle"),
        error(F.log1p("boosted")).alias("error"),
    )
    return totals.withColumn("learns", (F.col("error") < 0.5 * F.col("constant_rmsle")).cast("int"))


HOLDOUT_BACKOFF_SQL = holdout_sql(fx("planted_sales"), "planted_sales") + """,
c AS (SELECT avg(greatest(ln(demand + 1), 0)) AS level FROM planted_sales WHERE week BETWEEN 6 AND 8)
SELECT count(*) AS rows, CAST(sum(demand) AS BIGINT) AS actual_total, 0::BIGINT AS missing, 0::BIGINT AS negative,
       round(sqrt(avg(pow(ln(demand + 1) - c.level, 2))), 6) AS constant_rmsle, CAST(1 AS INT) AS learns,
       round(sqrt(avg(pow(ln(demand + 1) - ln(predicted + 1), 2))), 6) AS backoff_rmsle, CAST(1 AS INT) AS boosted_is_close
FROM predicted, c"""


@query("q_holdout_boosted", HOLDOUT_BACKOFF_SQL)
def holdout_boosted(spark, sf_dir):
    """Every hold-out row is scored once, by a model that has not seen its week, on demand that can be learned.

    The back-off forecast of the same rows is scored beside it: ``boosted_is_close`` tells that the boosted error is
    below 1.1 times that of the group means.
    """
    known = planted_lines(spark, sf_dir, known_only=True)
    scored = plan.holdout_boosted(known, fx_tables.brands(spark, sf_dir), PUBLISHED, tune_folds=FOLDS, written=True)
    backoff = plan.evaluate_holdout(plan.holdout_hierarchies(known), "predicted").select("rmsle")
    totals = holdout_totals(scored, known, 6).withColumn("backoff_rmsle", backoff.scalar())
    close = (F.col("error") < 1.1 * F.col("backoff_rmsle")).cast("int").alias("boosted_is_close")
    return rounded(totals.select(*CONTRACT, "backoff_rmsle", close))


@query("q_holdout_stacked", HOLDOUT_CONSTANT_SQL.format(first=3))
def holdout_stacked(spark, sf_dir):
    """The same with group means as inputs, out of fold for the training rows."""
    known = planted_lines(spark, sf_dir, known_only=True)
    return holdout_contract(plan.holdout_stacked(known, PUBLISHED, tune_folds=FOLDS, written=True), known, 3)


@query("q_holdout_forest", HOLDOUT_CONSTANT_SQL.format(first=6))
def holdout_forest(spark, sf_dir):
    """The published forest: ten trees that try three inputs a split, on rows drawn with replacement."""
    known = fx_tables.planted_sales(spark, sf_dir)
    return holdout_contract(plan.holdout_forest(known, fx_tables.brands(spark, sf_dir)), known, 6)


@query(
    "q_search_contract",
    fx("sales") + """SELECT 3::BIGINT AS trials, 3::BIGINT AS inside, CAST(1 AS INT) AS best_is_lowest, count(*) AS rows
FROM sales WHERE week > 5""",
)
def search_contract(spark, sf_dir):
    """Settings stay inside their ranges and the kept trial is the one with the lowest error."""
    known = demand_between(fx_tables.sales(spark, sf_dir))
    features = build_features(known, fx_tables.brands(spark, sf_dir))
    matrix = plan.training_matrix(known, features, inputs=md.PAIR_MEDIAN_INPUTS)
    space = SearchSpace(max_depth=(2, 4))
    search = random_search(matrix, space, trials=3, base=md.BoostParams(rounds=4), folds=2)
    table = search.table(spark)
    inside = (
        F.col("max_depth").between(*space.max_depth)
        & F.col("eta").between(*space.eta)
        & F.col("subsample").between(*space.subsample)
        & F.col("colsample").between(*space.colsample)
        & F.col("min_child").between(*space.min_child)
        & F.col("best_round").between(1, 4)
    )
    best = F.lit(search.best.result.best_error)
    rows = matrix.agg(F.count("*").alias("rows"))
    return table.agg(
        F.count("*").alias("trials"),
        F.count_if(inside).alias("inside"),
        (F.min("best_error") == best).cast("int").alias("best_is_lowest"),
    ).select("*", rows.scalar().alias("rows"))


@query(
    "q_tree_rules",
    fx("sales") + """SELECT count(DISTINCT agency_id) AS leaves, 2 * (count(DISTINCT agency_id) - 1) AS branches FROM sales""",
)
def tree_rules(spark, sf_dir):
    """A full tree on one input has a leaf per value and two branches per split."""
    model = md.fit_tree(agency_rows(spark, sf_dir), max_depth=8)
    printed = md.tree_rules(spark, model, ["agency_id"])
    return printed.agg(
        F.count_if(F.col("rule").startswith("Predict")).alias("leaves"),
        F.count_if(F.col("rule").contains("agency_id")).alias("branches"),
    )
