"""Back-off forecast, ensemble and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.catalog import fixtures as fx_tables
from shelfcast.catalog.fixtures import fx as whole_fx, warm_fx as fx
from shelfcast.catalog.registry import query, rounded
from shelfcast.functions.scalars import midpoint
from shelfcast.operators import ensemble as en, evaluate, hierarchy as hi
from shelfcast.operators.skew import find_hot_keys
from shelfcast.plans import demand

TIER_KEYS = {t.name: t.keys for t in hi.TIERS}
G = "avg(ln(demand + 1))"


def tier_sql(name: str, value: str = G, source: str = "sales", keys: tuple[str, ...] | None = None) -> str:
    columns = ", ".join(keys or TIER_KEYS[name])
    return f"{name} AS (SELECT {columns}, {value} AS {name} FROM {source} GROUP BY {columns})"


def attach_sql(names, source: str, keys=TIER_KEYS) -> str:
    return source + " " + " ".join(f"LEFT JOIN {n} USING ({', '.join(keys[n])})" for n in names)


def tables(spark, sf_dir):
    return fx_tables.forecast_requests(spark, sf_dir), fx_tables.warm_sales(spark, sf_dir)


for _tier in hi.TIERS:

    @query(
        f"q_tier_{_tier.name}",
        fx("sales") + f"SELECT {', '.join(_tier.keys)}, round({G}, 6) AS {_tier.name} FROM sales GROUP BY ALL",
    )
    def one_tier(spark, sf_dir, tier=_tier):
        return rounded(hi.fit_tiers(fx_tables.warm_sales(spark, sf_dir), [tier])[tier.name])


@query(
    "q_tier_global",
    fx("sales") + """SELECT 'mean_less' AS level, round(avg(demand) - 0.9, 6) AS global_level FROM sales
UNION ALL SELECT 'mean', round(avg(demand), 6) FROM sales
UNION ALL SELECT 'median', round(CAST(median(demand) AS DOUBLE), 6) FROM sales""",
)
def tier_global(spark, sf_dir):
    known = fx_tables.warm_sales(spark, sf_dir)
    levels = {
        "mean_less": hi.Fallback("mean", -0.9),
        "mean": hi.Fallback("mean"),
        "median": hi.Fallback("median"),
    }
    parts = [hi.global_level(known, f).withColumn("level", F.lit(n)) for n, f in levels.items()]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


ALL_TIERS = ("pca", "pcr", "pr", "pa", "p", "c")


def attached_sql(tables: str, source: str = "sales") -> str:
    """``tables`` and the requests with the group means of ``source``; the overall level is in ``g``."""
    return (
        tables
        + ", "
        + ",\n".join(tier_sql(n, source=source) for n in ALL_TIERS)
        + f",\nattached AS (SELECT * FROM {attach_sql(ALL_TIERS, 'forecast_requests')}),\n"
        + f"g AS (SELECT avg(demand) - 0.9 AS level FROM {source})\n"
    )


ATTACHED_SQL = attached_sql(fx("sales", "forecast_requests"))
HP1 = "coalesce(exp(pca) * 0.70 + 0.7, exp(pr) * 0.76 + 0.1, exp(p) * 0.76 + 0.25, level)"
HP2 = "coalesce(exp(pcr) * 0.70 + 0.7, exp(pa) * 0.75 + 0.1, exp(p) * 0.76 + 0.25, level)"
HP3 = """coalesce((exp(pca) - 1) * 0.7173 + (exp(pr) - 1) * 0.1859 + 0.12, (exp(pr) - 1) * 0.741 + 0.192,
    (exp(c) - 1) * 0.822 + 0.855, (exp(pa) - 1) * 0.53 + 0.95, (exp(p) - 1) * 0.49 + 1, level)"""


@query(
    "q_tier_attach",
    ATTACHED_SQL + "SELECT id, " + ", ".join(f"round({n}, 6) AS {n}" for n in ALL_TIERS) + " FROM attached",
)
def tier_attach(spark, sf_dir):
    requests, known = tables(spark, sf_dir)
    return rounded(hi.attach_tiers(requests, hi.fit_tiers(known)).select("id", *ALL_TIERS))


for _name, _column, _hierarchy, _sql in (
    ("q_hier1", "hp1", hi.HIER1, HP1),
    ("q_hier2", "hp2", hi.HIER2, HP2),
    ("q_hier3", "hp3", hi.HIER3, HP3),
):

    @query(_name, ATTACHED_SQL + f"SELECT id, round({_sql}, 6) AS {_column} FROM attached, g")
    def backoff(spark, sf_dir, column=_column, hierarchy=_hierarchy):
        requests, known = tables(spark, sf_dir)
        return rounded(demand.hierarchy_forecast(requests, known, {column: hierarchy}))


@query(
    "q_hier3_v1",
    ATTACHED_SQL + """SELECT id, round(coalesce(exp(pcr) * 0.70 + 0.7, exp(pa) * 0.75 + 0.1, exp(c) * 0.76 + 0.25,
    exp(p) * 0.76 + 0.25, level + 0.9), 6) AS hp3 FROM attached, g""",
)
def hier3_v1(spark, sf_dir):
    requests, known = tables(spark, sf_dir)
    return rounded(demand.hierarchy_forecast(requests, known, {"hp3": hi.HIER3_V1}))


JULY_KEYS = TIER_KEYS | {"pc": ("product_id", "client_id")}


def july_sql(middle: str, middle_value: str) -> str:
    names = ("pca", middle, "p")
    return (
        fx("sales", "forecast_requests")
        + f", {tier_sql('pca')}, {tier_sql(middle, middle_value, keys=JULY_KEYS[middle])}, {tier_sql('p')},\n"
        + "g AS (SELECT CAST(median(demand) AS DOUBLE) AS level FROM sales)\n"
        + f"""SELECT id, round(coalesce(exp(pca) * 0.75 + 0.75, exp({middle}) * 0.8 + 0.1, exp(p) * 1.15 + 0.25, level), 6)
       AS july FROM {attach_sql(names, 'forecast_requests', JULY_KEYS)}, g"""
    )


for _name, _hierarchy, _tiers, _sql in (
    ("q_hier_july_a", hi.JULY_AB, (hi.PCA, hi.PC_MEDIAN, hi.P), july_sql("pc", "median(ln(demand + 1))")),
    ("q_hier_july_b", hi.JULY_AB, (hi.PCA, hi.PC, hi.P), july_sql("pc", G)),
    ("q_hier_july_c", hi.JULY_C, (hi.PCA, hi.PR, hi.P), july_sql("pr", G)),
):

    @query(_name, _sql)
    def july(spark, sf_dir, hierarchy=_hierarchy, tiers=_tiers):
        requests, known = tables(spark, sf_dir)
        return rounded(hi.predict_hierarchies(requests, known, {"july": hierarchy}, tiers))


@query(
    "q_pair_returns",
    whole_fx("sales") + """SELECT product_id, client_id, round(exp(avg(ln(return_units + 1))) - 1, 6) AS pair_returns
FROM sales WHERE return_units > 0 GROUP BY ALL""",
)
def pair_returns(spark, sf_dir):
    return rounded(hi.pair_returns(fx_tables.sales(spark, sf_dir)))


@query(
    "q_means_early",
    whole_fx("sales") + f""", pa AS (SELECT product_id, agency_id, exp({G}) * 0.57928 AS om FROM sales GROUP BY ALL),
pac AS (SELECT product_id, agency_id, client_id, exp({G}) - 0.91 AS apm FROM sales GROUP BY ALL)
SELECT product_id, agency_id, client_id, round(om, 6) AS om, round(apm, 6) AS apm,
       (SELECT CAST(median(demand) AS DOUBLE) FROM sales) AS overall FROM pac JOIN pa USING (product_id, agency_id)""",
)
def means_early(spark, sf_dir):
    known = fx_tables.sales(spark, sf_dir)
    return rounded(hi.early_means(known, find_hot_keys(known, [("product_id", "agency_id")])))


@query(
    "q_tier_coverage",
    ATTACHED_SQL + """, labelled AS (SELECT
  CASE WHEN pca IS NOT NULL THEN 'pca' WHEN pr IS NOT NULL THEN 'pr' WHEN p IS NOT NULL THEN 'p' ELSE 'global' END AS hier1,
  CASE WHEN pcr IS NOT NULL THEN 'pcr' WHEN pa IS NOT NULL THEN 'pa' WHEN p IS NOT NULL THEN 'p' ELSE 'global' END AS hier2,
  CASE WHEN pca IS NOT NULL AND pr IS NOT NULL THEN 'pca+pr' WHEN pr IS NOT NULL THEN 'pr' WHEN c IS NOT NULL THEN 'c'
       WHEN pa IS NOT NULL THEN 'pa' WHEN p IS NOT NULL THEN 'p' ELSE 'global' END AS hier3 FROM attached)
SELECT hierarchy, tier, count(*) AS rows FROM labelled UNPIVOT (tier FOR hierarchy IN (hier1, hier2, hier3)) GROUP BY ALL""",
)
def tier_coverage(spark, sf_dir):
    requests, known = tables(spark, sf_dir)
    attached = hi.attach_tiers(requests, hi.fit_tiers(known))
    named = {"hier1": hi.HIER1, "hier2": hi.HIER2, "hier3": hi.HIER3}
    labels = attached.select("id", *[hi.answering_tier(h).alias(n) for n, h in named.items()])
    long = labels.unpivot(["id"], list(named), "hierarchy", "tier")
    return long.groupBy("hierarchy", "tier").agg(F.count("*").alias("rows"))


def holdout_sql(tables: str, source: str = "sales") -> str:
    """``tables`` and the back-off forecast of the hold-out week of ``source`` beside its demand, as ``predicted``."""
    return (
        tables
        + f", before AS (SELECT * FROM {source} WHERE week < 9), actual AS (SELECT * FROM {source} WHERE week = 9),\n"
        + ",\n".join(tier_sql(n, source="before") for n in ("pca", "pr", "p"))
        + f""",
g AS (SELECT avg(demand) AS level FROM before),
predicted AS (
  SELECT id, demand, coalesce(exp(pca) * 0.7 + 0.7, exp(pr) * 0.8 + 0.1, exp(p) * 1.1 + 0.25, level) AS predicted
  FROM {attach_sql(('pca', 'pr', 'p'), 'actual')}, g)
"""
    )


HOLDOUT_SQL = holdout_sql(fx("sales"))


@query("q_hier_holdout", HOLDOUT_SQL + "SELECT id, demand, round(predicted, 6) AS predicted FROM predicted")
def hier_holdout(spark, sf_dir):
    return rounded(demand.holdout_hierarchies(fx_tables.warm_sales(spark, sf_dir)))


SCORE_SQL = """round(sqrt(avg(pow(ln(demand + 1) - ln({p} + 1), 2))), 6) AS rmsle,
       CAST(sum(demand) AS BIGINT) AS actual_total, round(sum({p}), 2) AS predicted_total, count(*) AS rows"""


@query("q_rmsle_hier", HOLDOUT_SQL + f"SELECT {SCORE_SQL.format(p='predicted')} FROM predicted")
def rmsle_hier(spark, sf_dir):
    scored = demand.holdout_hierarchies(fx_tables.warm_sales(spark, sf_dir))
    return rounded(demand.evaluate_holdout(scored, "predicted"), predicted_total=2)


@query(
    "q_holdout_scores",
    fx("sales")
    + ", before AS (SELECT * FROM sales WHERE week < 9), actual AS (SELECT * FROM sales WHERE week = 9),\n"
    + ",\n".join(tier_sql(n, source="before") for n in ALL_TIERS)
    + f""",
g AS (SELECT avg(demand) - 0.9 AS level FROM before),
predicted AS (SELECT id, demand, {HP1} AS hp1, {HP2} AS hp2 FROM {attach_sql(ALL_TIERS, 'actual')}, g)
SELECT 'hp1' AS model, {SCORE_SQL.format(p='hp1')} FROM predicted
UNION ALL SELECT 'hp2', {SCORE_SQL.format(p='hp2')} FROM predicted""",
)
def holdout_scores(spark, sf_dir):
    known = fx_tables.warm_sales(spark, sf_dir)
    scored = demand.holdout_hierarchies(known, hierarchies={"hp1": hi.HIER1, "hp2": hi.HIER2})
    return rounded(demand.holdout_scores(scored, ["hp1", "hp2"]), predicted_total=2)


@query(
    "q_rmsle_multi",
    whole_fx("sales") + """, t AS (SELECT CASE WHEN demand > 40 THEN NULL ELSE demand END AS a1, units_sold AS p1,
       return_units AS a2, CAST(demand AS DOUBLE) / 2 AS p2 FROM sales)
SELECT round(sqrt((sum(pow(ln(a1 + 1) - ln(p1 + 1), 2)) + sum(pow(ln(a2 + 1) - ln(p2 + 1), 2))) / (count(a1) + count(a2))), 6)
       AS rmsle, count(a1) + count(a2) AS values FROM t""",
)
def rmsle_multi(spark, sf_dir):
    pairs = fx_tables.sales(spark, sf_dir).select(
        F.when(F.col("demand") <= 40, F.col("demand")).alias("a1"),
        F.col("units_sold").alias("p1"),
        F.col("return_units").alias("a2"),
        (F.col("demand") / 2).alias("p2"),
    )
    return rounded(evaluate.rmsle_multi(pairs, [("a1", "p1"), ("a2", "p2")]))


# The boosted column of the ensemble queries is a stand-in that SQL can compute.
STAND_IN_SQL = ATTACHED_SQL + f""", hp AS (SELECT id, {HP1} AS hp1, {HP2} AS hp2, {HP3} AS hp3 FROM attached, g),
e AS (SELECT *, hp1 * 1.1 + 0.5 AS x FROM hp)
"""


def stand_in(spark, sf_dir):
    hp = demand.hierarchy_forecast(*tables(spark, sf_dir))
    return en.combine_predictions(hp.select("id", (F.col("hp1") * 1.1 + 0.5).alias("boosted")), hp)


@query(
    "q_ensemble",
    STAND_IN_SQL + """SELECT id, round(x, 6) AS boosted, round(hp1, 6) AS hp1, round(hp2, 6) AS hp2, round(hp3, 6) AS hp3,
  round(least(x, hp1, hp2, hp3), 6) AS min_prediction, round(greatest(x, hp1, hp2, hp3), 6) AS max_prediction,
  round((hp3 + hp2 + hp1 + x) / 4, 6) AS average_x123, round((hp2 + hp1 + x) / 3, 6) AS average_x12,
  round((hp3 + x) / 2, 6) AS average_x3, round((hp2 + x) / 2, 6) AS average_x2, round((hp1 + x) / 2, 6) AS average_x1,
  round((hp1 + hp2) / 2, 6) AS average_h12, round((hp1 + hp2 + hp3) / 3, 6) AS average_h123,
  round((hp1 + hp2 + hp3 + x - least(x, hp1, hp2, hp3)) / 3, 6) AS without_lowest,
  round((hp1 + hp2 + hp3 + x - greatest(x, hp1, hp2, hp3)) / 3, 6) AS without_highest FROM e""",
)
def ensemble(spark, sf_dir):
    return rounded(en.ensemble(stand_in(spark, sf_dir)))


@query("q_midpoint", STAND_IN_SQL + "SELECT id, round((x + hp1) / 2, 6) AS demand FROM e")
def midpoints(spark, sf_dir):
    return rounded(stand_in(spark, sf_dir).select("id", midpoint(F.col("boosted"), F.col("hp1")).alias("demand")))
