"""Credit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.catalog import fixtures as fx_tables
from shelfcast.catalog.fixtures import fx
from shelfcast.catalog.registry import query, rounded
from shelfcast.catalog.scans import BUCKET
from shelfcast.operators import credit as cr, evaluate
from shelfcast.operators.filters import hash_split
from shelfcast.plans.credit import PREDICTORS, score_applicants
from shelfcast.schema import APPLICANT_NUMBERS
from shelfcast.session import cut_lineage, fresh_folder
from shelfcast.sources import store


@query(
    "q_missing_profile",
    fx("applicants_train") + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing FROM applicants_train" for c in PREDICTORS
    ),
)
def missing_profile(spark, sf_dir):
    return cr.missing_profile(fx_tables.applicants_train(spark, sf_dir), PREDICTORS)


@query(
    "q_missing_flags",
    fx("applicants_all") + "SELECT idx, "
    + ", ".join(f"CAST({c} IS NULL AS INT) AS {c}_imp_f" for c in APPLICANT_NUMBERS) + " FROM applicants_all",
)
def missing_flags(spark, sf_dir):
    flagged = cr.missing_flags(fx_tables.applicants_all(spark, sf_dir), APPLICANT_NUMBERS)
    return flagged.select("idx", *[f"{c}_imp_f" for c in APPLICANT_NUMBERS])


@query(
    "q_pooled_stats",
    fx("applicants_all") + "SELECT "
    + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_sd" for c in cr.STANDARDISED)
    + " FROM applicants_all",
)
def pooled_stats(spark, sf_dir):
    return rounded(cr.pooled_stats(*fx_tables.applicants(spark, sf_dir), cr.STANDARDISED))


@query(
    "q_standardise",
    fx("applicants_all") + "SELECT idx, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in cr.STANDARDISED)
    + " FROM applicants_all",
)
def standardise(spark, sf_dir):
    train, test = cr.standardise(*fx_tables.applicants(spark, sf_dir))
    return rounded(train.unionByName(test).select("idx", *cr.STANDARDISED))


@query(
    "q_interactions",
    fx("applicants_all") + "SELECT idx, round(delinq * debtinc, 6) AS int_var1, round(delinq * loan, 6) AS int_var2 "
    "FROM applicants_all",
)
def interactions(spark, sf_dir):
    return rounded(cr.interactions(fx_tables.applicants_all(spark, sf_dir)).select("idx", *cr.INTERACTIONS))


@query(
    "q_threshold_table",
    fx("applicants_train") + """SELECT CAST((loan / 80000 >= 0.5) = (target_flag = 1) AS INT) AS correct, count(*) AS rows
FROM applicants_train GROUP BY ALL""",
)
def threshold_table(spark, sf_dir):
    scored = fx_tables.applicants_train(spark, sf_dir).withColumn("score", F.col("loan") / 80000)
    return evaluate.hit_table(scored, "score", "target_flag")


@query(
    "q_impute_group_mean",
    fx("applicants_all", "applicants_train") + """, means AS (
  SELECT reason, avg(debtinc) AS mean FROM applicants_train GROUP BY reason)
SELECT idx, round(coalesce(debtinc, mean), 6) AS debtinc, CAST(debtinc IS NULL AS INT) AS debtinc_imp_f
FROM applicants_all JOIN means USING (reason)""",
)
def impute_group_mean(spark, sf_dir):
    """With one category as predictor a tree predicts that category's mean."""
    train, test = cr.impute_by_tree(*fx_tables.applicants(spark, sf_dir), ["reason"], ["debtinc"], min_rows=1)
    return rounded(train.unionByName(test).select("idx", "debtinc", "debtinc_imp_f"))


@query(
    "q_impute_contract",
    fx("applicants_all") + "SELECT count(*) AS rows, 0::BIGINT AS missing, "
    + ", ".join(f"round(sum({c}), 2) AS known_{c}" for c in APPLICANT_NUMBERS) + " FROM applicants_all",
)
def impute_contract(spark, sf_dir):
    """No value is left missing and every known value is unchanged."""
    train, test = cr.impute_by_tree(*fx_tables.applicants(spark, sf_dir), PREDICTORS)
    both = train.unionByName(test)
    left = F.greatest(*[F.col(c).isNull().cast("int") for c in APPLICANT_NUMBERS])
    known = {
        c: F.round(F.sum(F.when(F.col(f"{c}_imp_f") == 0, F.col(c)) if f"{c}_imp_f" in both.columns else F.col(c)), 2)
        for c in APPLICANT_NUMBERS
    }
    return both.agg(
        F.count("*").alias("rows"), F.sum(left).alias("missing"), *[v.alias(f"known_{c}") for c, v in known.items()]
    )


BINARY_SQL = fx("applicants_train") + """, t AS (SELECT CAST(reason = 'HomeImp' AS INT) AS x, target_flag AS y FROM applicants_train),
p AS (SELECT avg(y) FILTER (x = 0) AS p0, avg(y) FILTER (x = 1) AS p1 FROM t)
"""


def binary_logit(spark, sf_dir):
    rows = fx_tables.applicants_train(spark, sf_dir).select(
        (F.col("reason") == "HomeImp").cast("int").alias("x"), "target_flag"
    )
    return cr.fit_logit(rows, ["x"], tol=1e-12), rows


@query(
    "q_logit_binary",
    BINARY_SQL + """SELECT '(intercept)' AS term, round(ln(p0 / (1 - p0)), 6) AS estimate FROM p
UNION ALL SELECT 'x', round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 6) FROM p""",
)
def logit_binary(spark, sf_dir):
    fitted, _ = binary_logit(spark, sf_dir)
    return rounded(fitted.coefficients(spark).select("term", "estimate"))


@query(
    "q_aic_single",
    BINARY_SQL + """SELECT round(-2 * sum(y * ln(CASE x WHEN 1 THEN p1 ELSE p0 END)
       + (1 - y) * ln(1 - CASE x WHEN 1 THEN p1 ELSE p0 END)) + 4, 4) AS aic FROM t, p""",
)
def aic_single(spark, sf_dir):
    fitted, rows = binary_logit(spark, sf_dir)
    rows_read = rows.agg(F.count("*").alias("n"))
    return rows_read.select(F.round(F.lit(fitted.aic), 4).alias("aic"))


def prepared(spark, sf_dir):
    train, test = cr.prepare_applicants(*fx_tables.applicants(spark, sf_dir), PREDICTORS)
    return cut_lineage(train), test


# Log likelihood of the share of flags alone, which every useful model has to beat.
NULL_SQL = "-2 * sum(y * ln(m) + (1 - y) * ln(1 - m))"


def deviance(p):
    y = F.col("target_flag")
    return -2 * F.sum(F.when(y == 1, F.log(p)).otherwise(F.log(1 - p)))


@query(
    "q_stepwise_contract",
    fx("applicants_train") + f""", t AS (SELECT target_flag AS y, avg(target_flag) OVER () AS m FROM applicants_train)
SELECT count(*) AS rows, round({NULL_SQL} + 2, 4) AS null_aic, CAST(1 AS INT) AS beats_null, CAST(1 AS INT) AS beats_all,
       CAST(1 AS INT) AS aic_holds FROM t""",
)
def stepwise_contract(spark, sf_dir):
    """Selection over all 21 terms: its AIC, computed again from the scored rows, is below the full and the empty model's."""
    train, _ = prepared(spark, sf_dir)
    model, moves = cr.stepwise_aic(train, [t for t in cr.LOGIT_TERMS if t in train.columns])
    scored = model.score(train, "p").withColumn("m", train.agg(F.avg("target_flag")).scalar())
    sums = scored.agg(F.count("*").alias("rows"), (deviance(F.col("m")) + 2).alias("null_aic"), deviance(F.col("p")).alias("own"))
    size = len(model.model.coefficients) + 1
    return rounded(sums.select(
        "rows",
        "null_aic",
        (F.lit(model.aic) < F.col("null_aic")).cast("int").alias("beats_null"),
        F.lit(int(len(moves) > 1 and model.aic < moves[0].aic)).alias("beats_all"),
        (F.abs(F.col("own") + 2 * size - model.aic) < 1e-3).cast("int").alias("aic_holds"),
    ), places=4)


@query(
    "q_mlp_contract",
    fx("applicants_train") + f""", split AS (SELECT *, {BUCKET.format(key='CAST(idx AS VARCHAR)')} < 7000 AS inside FROM applicants_train),
t AS (SELECT target_flag AS y, (SELECT avg(target_flag) FROM split WHERE inside) AS m FROM split WHERE NOT inside)
SELECT count(*) AS rows, 0::BIGINT AS outside, round({NULL_SQL}, 4) AS null_deviance, CAST(1 AS INT) AS beats_null FROM t""",
)
def mlp_contract(spark, sf_dir):
    """Twenty networks on all terms, fitted on the split's larger part; their mean beats the share of flags on the rest."""
    train, _ = prepared(spark, sf_dir)
    inside, outside = hash_split(train)
    networks = cr.fit_mlp_ensemble(inside, [t for t in cr.LOGIT_TERMS if t in train.columns])
    scored = networks.score(outside).withColumn("m", inside.agg(F.avg("target_flag")).scalar())
    p = F.col("probability")
    totals = scored.agg(
        F.count("*").alias("rows"),
        F.count_if(p.isNull() | (p < 0) | (p > 1)).alias("outside"),
        deviance(F.col("m")).alias("null_deviance"),
        deviance(F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))).alias("own"),
    )
    return rounded(totals.withColumn("beats_null", (F.col("own") < F.col("null_deviance")).cast("int")).drop("own"), places=4)


@query(
    "q_credit_contract",
    fx("applicants_test", "applicants_train") + f""", t AS (SELECT target_flag AS y, avg(target_flag) OVER () AS m FROM applicants_train)
SELECT (SELECT count(*) FROM applicants_test) AS scored, 0::BIGINT AS outside, 2::BIGINT AS files,
       (SELECT count(*) FROM applicants_train WHERE {BUCKET.format(key='CAST(idx AS VARCHAR)')} >= 7000) AS validated,
       CAST(1 AS INT) AS better_than_even, round({NULL_SQL}, 4) AS null_deviance, CAST(1 AS INT) AS beats_null FROM t""",
)
def credit_contract(spark, sf_dir):
    """End to end with selection and twenty networks, both score files written and read again.

    ``better_than_even``: more rows of the validation part are right than wrong.
    ``beats_null``: the chosen model's deviance on its training rows is below that of the share of flags.
    """
    train, test = fx_tables.applicants(spark, sf_dir)
    result = score_applicants(train, test, select_terms=True, networks=20)
    folder = fresh_folder(spark, "credit-scores")
    scores = cut_lineage(result.scores.withColumnRenamed("idx", "index"))
    names = {"logit": "p_target_flag", "networks": "p_target_flag_network"}
    path = store.write_submissions(scores, folder, names, key="index", name="p_target_flag")
    files = spark.read.schema("index BIGINT, p_target_flag DOUBLE, model STRING").option("header", True).csv(path)
    p = F.col("p_target_flag")
    read = files.agg(
        F.count_distinct("index").alias("scored"),
        F.count_if(p.isNull() | (p < 0) | (p > 1)).alias("outside"),
        (F.count("*") / F.count_distinct("index")).cast("long").alias("files"),
    )
    right = F.sum(F.when(F.col("correct") == 1, F.col("rows")).otherwise(0))
    hits = result.hits.agg(F.sum("rows").alias("validated"), right.alias("right"))
    own = result.logit.score(result.ready, "p").withColumn("m", result.ready.agg(F.avg("target_flag")).scalar())
    fit = own.agg(deviance(F.col("m")).alias("null_deviance"), deviance(F.col("p")).alias("own"))
    parts = read.withColumns({
        "validated": hits.select("validated").scalar(),
        "better_than_even": hits.select((F.col("right") * 2 > F.col("validated")).cast("int")).scalar(),
        "null_deviance": fit.select("null_deviance").scalar(),
        "beats_null": fit.select((F.col("own") < F.col("null_deviance")).cast("int")).scalar(),
    })
    return rounded(parts, places=4)


@query(
    "q_credit_submission",
    BINARY_SQL + """, test AS (SELECT idx, reason FROM applicants_all WHERE idx % 4 = 0)
SELECT idx AS "index", round(CASE WHEN reason = 'HomeImp' THEN p1 ELSE p0 END, 6) AS p_target_flag FROM test, p""",
)
def credit_submission(spark, sf_dir):
    """Scores of a one-input logistic model, written and read back as the delivered file."""
    fitted, _ = binary_logit(spark, sf_dir)
    test = fx_tables.applicants_test(spark, sf_dir).withColumn("x", (F.col("reason") == "HomeImp").cast("int"))
    scored = rounded(fitted.score(test).withColumnRenamed("idx", "index"))
    path = store.write_submission(
        scored, fresh_folder(spark, "credit-submission"), "probability", key="index", name="p_target_flag"
    )
    return spark.read.schema("index BIGINT, p_target_flag DOUBLE").option("header", True).csv(path)
