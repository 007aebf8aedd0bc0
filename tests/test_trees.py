"""Trees as tables, against the models' own results and against DuckDB working from the node table."""

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfcast.catalog import fixtures
from shelfcast.catalog.models import holdout_contract
from shelfcast.functions.scalars import log_target
from shelfcast.operators import models as md, trees
from shelfcast.operators.hierarchy import out_of_fold_features, tier_features
from shelfcast.session import cut_lineage

INPUTS = ("agency_id", "channel_id", "week", "product_id")


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    known = fixtures.planted_sales(spark, sf_dir).select("id", *INPUTS, log_target(F.col("demand")).alias("target"))
    return cut_lineage(md.assemble(known, INPUTS))


FITS = {
    "tree": lambda rows: md.fit_tree(rows, max_depth=5),
    "boosted": lambda rows: md.fit_boosted(rows, md.BoostParams(rounds=5, max_depth=4, partitions=8)),
    "forest": lambda rows: md.fit_forest(rows, n_trees=10, mtry=3, max_depth=4),
    "one leaf": lambda rows: md.fit_tree(rows, max_depth=0),
}


@pytest.mark.parametrize("kind", FITS)
def test_node_table(spark, rows, kind, tmp_path):
    model = FITS[kind](rows)
    nodes = cut_lineage(trees.tree_nodes(spark, model, INPUTS))
    scored = trees.score_nodes(model.setPredictionCol("own").transform(rows), nodes, INPUTS, "walked")
    assert scored.agg(F.max(F.abs(F.col("own") - F.col("walked")))).first()[0] < 1e-9
    own = dict(zip(INPUTS, model.featureImportances.toArray()))
    found = {r["feature"]: r["importance"] for r in trees.importance_of(nodes, INPUTS, per_tree=kind == "forest").collect()}
    assert found == pytest.approx(own, abs=1e-9)

    nodes.write.parquet(str(tmp_path / "nodes"))
    scored.select("id", *INPUTS, "walked").write.parquet(str(tmp_path / "rows"))
    con = duckdb.connect()
    value = "CASE n.input " + " ".join(f"WHEN '{c}' THEN r.{c}" for c in INPUTS) + " END"
    worst = con.execute(f"""
        WITH RECURSIVE n AS (SELECT * FROM read_parquet('{tmp_path}/nodes/*.parquet')),
        r AS (SELECT * FROM read_parquet('{tmp_path}/rows/*.parquet')),
        walk AS (SELECT id, n.tree, n.node FROM r, n WHERE n.node = 0
          UNION ALL SELECT w.id, w.tree, CASE WHEN {value} <= n.threshold THEN n."left" ELSE n."right" END
          FROM walk w JOIN n USING (tree, node) JOIN r ON r.id = w.id WHERE n."left" IS NOT NULL),
        summed AS (SELECT id, sum(n.prediction * n.tree_weight) AS p FROM walk JOIN n USING (tree, node)
                   WHERE n."left" IS NULL GROUP BY id)
        SELECT max(abs(p - walked)), count(*) FROM summed JOIN r USING (id)""").fetchone()  # fmt: skip
    assert worst[0] < 1e-9 and worst[1] == rows.count()


def test_split_table_conditions_hold(spark, rows):
    """Rows counted by a leaf's conditions are the leaf's rows."""
    model = md.fit_tree(rows, max_depth=3)
    table = trees.split_table(cut_lineage(trees.tree_nodes(spark, model, INPUTS))).collect()
    assert sum(r["rows"] for r in table if r["leaf"]) == rows.count() and sum(r["rule"] == "" for r in table) == 1
    for r in table:
        inside = rows
        for part in filter(None, r["rule"].split(" and ")):
            low, _, rest = part.partition(" < ") if " < " in part else ("", "", part)
            name, _, high = rest.partition(" <= ")
            inside = inside.where(F.col(name) > float(low)) if low else inside
            inside = inside.where(F.col(name) <= float(high)) if high else inside
        mean = inside.agg(F.count("*"), F.avg("target")).first()
        assert mean[0] == r["rows"] and mean[1] == pytest.approx(r["prediction"]) and 0 < r["share"] <= 1


def test_constant_model_fails_the_contract(spark, sf_dir):
    known = fixtures.planted_sales(spark, sf_dir)
    level = known.where(F.col("week").between(6, 8)).agg(F.avg(log_target(F.col("demand")))).scalar()
    nothing = known.where(F.col("week") == 9).select("id", "demand", F.expm1(level).alias("boosted"))
    assert holdout_contract(nothing, known, 6).first()["learns"] == 0


def test_rows_are_not_in_their_own_means(spark):
    rows = spark.createDataFrame(
        [(f"i{i}", 1, 1, 1, i, 5 + 90 * (i == 3)) for i in range(40)],
        "id STRING, product_id INT, agency_id INT, route_id INT, client_id INT, demand INT",
    )
    out = {r["id"]: r for r in out_of_fold_features(rows).collect()}
    fold = {r["id"]: r["fold"] for r in md.with_fold(rows, 5).collect()}
    usual = 6 * 1.15 + 0.25
    for i, r in out.items():
        assert r["pca"] == r["p"]  # every client is alone in its group, so the product answers
        assert (r["p"] == pytest.approx(usual)) == (fold[i] == fold["i3"])
    assert len(out) == 40 and tier_features(rows, rows).count() == 40
    alone = out_of_fold_features(rows.limit(1)).first()
    assert alone["p"] == 7.0 and alone["pr"] is None or alone["pr"] == 7.0


def test_the_holdout_is_scored_beside_the_group_means():
    from shelfcast.catalog import ORACLES

    sql = ORACLES["q_holdout_boosted"]
    assert "backoff_rmsle" in sql and "boosted_is_close" in sql and "constant_rmsle" in sql
