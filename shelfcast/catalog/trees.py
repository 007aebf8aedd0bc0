"""Trees as tables: nodes, importances and split tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.catalog import fixtures as fx_tables
from shelfcast.catalog.fixtures import fx
from shelfcast.catalog.registry import query, rounded
from shelfcast.catalog.scans import BUCKET
from shelfcast.functions.scalars import log_target
from shelfcast.operators import credit as cr, models as md, trees
from shelfcast.operators.filters import hash_split
from shelfcast.plans.credit import PREDICTORS
from shelfcast.session import cut_lineage

INPUTS = ("agency_id", "channel_id", "week")


def best_splits_sql(level: str, source: str) -> str:
    """Per node of ``source``, the split of one input that lowers the squared error most."""
    error = lambda n, s, q: f"({q} / {n} - pow({s} / {n}, 2))"
    rest = error("(n - n_left)", "(s - s_left)", "(q - q_left)")
    return f"""{level}_values AS (
  SELECT node, input, value, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s, sum(y * y) AS q
  FROM (SELECT node, y, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in INPUTS)} FROM {source})
  UNPIVOT (value FOR input IN ({', '.join(INPUTS)})) GROUP BY node, input, value),
{level}_sides AS (
  SELECT node, input, (value + lead(value) OVER up) / 2 AS threshold, sum(n) OVER up AS n_left, sum(s) OVER up AS s_left,
         sum(q) OVER up AS q_left, sum(n) OVER own AS n, sum(s) OVER own AS s, sum(q) OVER own AS q FROM {level}_values
  WINDOW up AS (PARTITION BY node, input ORDER BY value), own AS (PARTITION BY node, input)),
{level}_gains AS (
  SELECT node, input, threshold, n, s / n AS prediction, {error('n', 's', 'q')} - n_left / n * {error('n_left', 's_left', 'q_left')}
         - (n - n_left) / n * {rest} AS gain FROM {level}_sides WHERE threshold IS NOT NULL),
{level} AS (SELECT node, arg_max(input, gain) AS input, arg_max(threshold, gain) AS threshold, max(gain) AS gain, max(n) AS n,
                   max(prediction) AS prediction FROM {level}_gains GROUP BY node)"""


def descend_sql(rows: str, level: str, left: str, right: str) -> str:
    value = "CASE input " + " ".join(f"WHEN '{c}' THEN {c}" for c in INPUTS) + " END"
    return (f"SELECT CASE WHEN {value} <= threshold THEN {left} ELSE {right} END AS node, {', '.join(INPUTS)}, y "
            f"FROM {rows} JOIN {level} USING (node)")


# Nodes are numbered down the left side first: 0, its left part 1 with 2 and 3, its right part 4 with 5 and 6.
NODES_SQL = fx("planted_sales") + f""", rows_0 AS (
  SELECT 0 AS node, {', '.join(INPUTS)}, greatest(ln(demand + 1), 0) AS y FROM planted_sales),
{best_splits_sql('top', 'rows_0')},
rows_1 AS ({descend_sql('rows_0', 'top', '1', '4')}),
{best_splits_sql('low', 'rows_1')},
rows_2 AS ({descend_sql('rows_1', 'low', 'node + 1', 'node + 2')}),
inner_nodes AS (SELECT *, node + 1 AS l, CASE node WHEN 0 THEN 4 ELSE node + 2 END AS r FROM (FROM top UNION ALL FROM low))
"""


def few_valued(spark, sf_dir):
    rows = fx_tables.planted_sales(spark, sf_dir).select("id", *INPUTS, log_target(F.col("demand")).alias("target"))
    return md.assemble(rows, INPUTS)


@query(
    "q_tree_table",
    NODES_SQL + """SELECT CAST(node AS INT) AS node, input, threshold, CAST(l AS INT) AS "left", CAST(r AS INT) AS "right",
       round(gain, 8) AS gain, CAST(n AS BIGINT) AS rows, round(prediction, 6) AS prediction FROM inner_nodes
UNION ALL SELECT CAST(node AS INT), NULL, NULL, NULL, NULL, NULL, count(*), round(avg(y), 6) FROM rows_2 GROUP BY node""",
)
def tree_table(spark, sf_dir):
    """Every node of a tree of depth two, against the best splits found by trying all of them."""
    nodes = trees.tree_nodes(spark, md.fit_tree(few_valued(spark, sf_dir), max_depth=2), INPUTS)
    shown = nodes.select("node", "input", "threshold", "left", "right", "gain", "rows", "prediction")
    return rounded(shown, gain=8)


@query(
    "q_tree_importance",
    NODES_SQL + f""", gained AS (SELECT input, sum(gain * n) AS g FROM inner_nodes GROUP BY input)
SELECT feature, round(coalesce(g, 0) / (SELECT sum(g) FROM gained), 6) AS importance
FROM (SELECT unnest([{', '.join(f"'{c}'" for c in INPUTS)}]) AS feature) LEFT JOIN gained ON input = feature""",
)
def tree_importance(spark, sf_dir):
    nodes = trees.tree_nodes(spark, md.fit_tree(few_valued(spark, sf_dir), max_depth=2), INPUTS)
    return rounded(trees.importance_of(nodes, INPUTS))


@query(
    "q_tree_score",
    NODES_SQL + """SELECT id, round(leaf, 6) AS predicted FROM (
  SELECT s.id, avg(greatest(ln(s.demand + 1), 0)) OVER (PARTITION BY
    CASE WHEN t.pass THEN CASE WHEN l.pass THEN 2 ELSE 3 END ELSE CASE WHEN r.pass THEN 5 ELSE 6 END END) AS leaf
  FROM planted_sales s,
  LATERAL (SELECT CASE input WHEN 'agency_id' THEN s.agency_id WHEN 'channel_id' THEN s.channel_id ELSE s.week END <= threshold
           AS pass FROM top) t,
  LATERAL (SELECT CASE input WHEN 'agency_id' THEN s.agency_id WHEN 'channel_id' THEN s.channel_id ELSE s.week END <= threshold
           AS pass FROM low WHERE node = 1) l,
  LATERAL (SELECT CASE input WHEN 'agency_id' THEN s.agency_id WHEN 'channel_id' THEN s.channel_id ELSE s.week END <= threshold
           AS pass FROM low WHERE node = 4) r)""",
)
def tree_score(spark, sf_dir):
    """Rows scored from the node table alone."""
    rows = few_valued(spark, sf_dir)
    nodes = cut_lineage(trees.tree_nodes(spark, md.fit_tree(rows, max_depth=2), INPUTS))
    return rounded(trees.score_nodes(rows, nodes, INPUTS, "predicted", depth=2).select("id", "predicted"))


@query(
    "q_split_table",
    fx("applicants_train") + f"""SELECT count(*) AS rows, CAST(sum(target_flag) AS BIGINT) AS flagged, CAST(1 AS INT) AS several,
       CAST(1 AS INT) AS separates FROM applicants_train WHERE {BUCKET.format(key='CAST(idx AS VARCHAR)')} < 7000""",
)
def applicant_splits(spark, sf_dir):
    """The tree over all terms of the fitted part of the applicants: leaves hold every row and every flag once.

    ``separates``: the leaves' squared error is at least a twentieth below that of one leaf.
    """
    train, _ = cr.prepare_applicants(*fx_tables.applicants(spark, sf_dir), PREDICTORS)
    fitted, _ = hash_split(cut_lineage(train))
    table = cut_lineage(cr.applicant_splits(fitted))
    leaves, p = F.col("leaf"), F.col("prediction")
    error = F.sum(F.when(leaves, F.col("rows") * p * (1 - p)))
    top = F.max(F.when(F.col("node") == 0, F.col("rows") * p * (1 - p)))
    return table.agg(
        F.sum(F.when(leaves, F.col("rows"))).alias("rows"),
        F.round(F.sum(F.when(leaves, F.col("rows") * p))).cast("long").alias("flagged"),
        (F.count_if(leaves) > 2).cast("int").alias("several"),
        (error < 0.95 * top).cast("int").alias("separates"),
    )
