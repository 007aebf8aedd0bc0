"""Exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.catalog import fixtures as fx_tables
from shelfcast.catalog.fixtures import fx
from shelfcast.catalog.registry import query, rounded
from shelfcast.operators import explore

CLIENT_SALES_SQL = """, totals AS (
  SELECT client_id, CAST(sum(units_sold) AS BIGINT) AS units, sum(sales_amount) AS amount,
         CAST(sum(return_units) AS BIGINT) AS return_units, sum(return_amount) AS return_amount,
         CAST(sum(demand) AS BIGINT) AS net_units
  FROM sales GROUP BY client_id),
named AS (
  SELECT client_id, client_name, units, round(amount, 2) AS amount, return_units,
         round(return_amount, 2) AS return_amount, net_units,
         round(return_units / nullif(units + return_units, 0), 6) AS return_rate,
         round(amount / nullif(units, 0), 6) AS avg_price, round(amount - return_amount, 2) AS net_amount
  FROM totals JOIN clients USING (client_id))
"""


@query("q_client_sales", fx("sales", "clients") + CLIENT_SALES_SQL + "SELECT * FROM named")
def client_sales(spark, sf_dir):
    report = explore.client_sales(fx_tables.sales(spark, sf_dir), fx_tables.clients(spark, sf_dir))
    return rounded(report, amount=2, return_amount=2, net_amount=2)


@query(
    "q_top_clients",
    fx("sales", "clients") + CLIENT_SALES_SQL + """SELECT client_id, client_name, amount, units, return_rate FROM named
ORDER BY amount DESC, client_id, client_name LIMIT 50""",
)
def top_clients(spark, sf_dir):
    top = explore.top_clients(fx_tables.sales(spark, sf_dir), fx_tables.clients(spark, sf_dir))
    return rounded(top, amount=2)


DISTINCT = {
    "q_channels_per_agency": ("agency_id", "channel_id"),
    "q_routes_per_client": ("client_id", "route_id"),
    "q_products_per_client": ("client_id", "product_id"),
    "q_products_per_route": ("route_id", "product_id"),
}
for _name, (_key, _column) in DISTINCT.items():

    @query(_name, fx("sales") + f"SELECT {_key}, count(DISTINCT {_column}) AS n FROM sales GROUP BY {_key}")
    def distinct_per_key(spark, sf_dir, key=_key, column=_column):
        return explore.n_distinct_by(fx_tables.sales(spark, sf_dir), key, column)


for _name, _column, _width in (("q_hist_week", "week", 1), ("q_hist_agency", "agency_id", 2)):

    @query(
        _name,
        fx("sales") + f"""SELECT CAST(floor({_column} / {_width}) * {_width} AS DOUBLE) AS bin_start, count(*) AS rows
FROM sales GROUP BY ALL""",
    )
    def column_histogram(spark, sf_dir, column=_column, width=_width):
        return explore.histogram(fx_tables.sales(spark, sf_dir), column, width)


LABEL_SQL = "concat(regexp_replace(CAST(CAST(rows / 1000.0 AS DECIMAL(20,3)) AS VARCHAR), '\\.?0+$', ''), ' k')"
for _name, _source, _width in (
    ("q_hist_channels", "q_channels_per_agency", 0.5),
    ("q_hist_routes", "q_routes_per_client", 1),
    ("q_hist_products_client", "q_products_per_client", 1),
    ("q_hist_products_route", "q_products_per_route", 1),
):
    _key, _column = DISTINCT[_source]

    @query(
        _name,
        fx("sales") + f""", counts AS (SELECT {_key}, count(DISTINCT {_column}) AS n FROM sales GROUP BY {_key}),
bins AS (SELECT CAST(floor(n / {_width}) * {_width} AS DOUBLE) AS bin_start, count(*) AS rows FROM counts GROUP BY ALL)
SELECT bin_start, rows, {LABEL_SQL} AS label FROM bins""",
    )
    def distinct_histogram(spark, sf_dir, key=_key, column=_column, width=_width):
        counts = explore.n_distinct_by(fx_tables.sales(spark, sf_dir), key, column)
        return explore.labelled_histogram(counts, "n", width)


@query(
    "q_repeat_pair_pct",
    fx("sales") + """, pairs AS (SELECT product_id, client_id, count(*) AS n FROM sales GROUP BY ALL)
SELECT round((SELECT count(*) FROM pairs WHERE n >= 2) / (SELECT count(*) FROM sales) * 100, 6) AS repeat_pct""",
)
def repeat_pair_pct(spark, sf_dir):
    return rounded(explore.repeat_pair_pct(fx_tables.sales(spark, sf_dir)))


FIRST_SQL = """, firsts AS (SELECT * FROM leaderboard
QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY submitted_seq) = 1),
kept AS (SELECT * FROM firsts WHERE score < 1.0)
"""


@query(
    "q_leaderboard_first",
    fx("leaderboard") + FIRST_SQL + "SELECT team_id, round(score, 6) AS score, submitted_seq FROM kept",
)
def leaderboard_first(spark, sf_dir):
    return rounded(explore.leaderboard_first(fx_tables.leaderboard(spark, sf_dir)))


@query(
    "q_leaderboard_hist",
    fx("leaderboard") + FIRST_SQL + """SELECT round(floor(score / 0.0001::DOUBLE) * 0.0001::DOUBLE, 6) AS bin_start,
       count(*) AS rows FROM kept GROUP BY ALL""",
)
def leaderboard_hist(spark, sf_dir):
    firsts = explore.leaderboard_first(fx_tables.leaderboard(spark, sf_dir))
    return rounded(explore.histogram(firsts, "score", 0.0001))


@query(
    "q_leaderboard_lines",
    fx("leaderboard") + FIRST_SQL + """SELECT CAST(line AS DOUBLE) AS line, count(score) AS teams
FROM (VALUES (0.83), (0.53), (0.486), (0.4602)) v(line) LEFT JOIN kept ON score <= line GROUP BY line""",
)
def leaderboard_lines(spark, sf_dir):
    return explore.leaderboard_lines(explore.leaderboard_first(fx_tables.leaderboard(spark, sf_dir)))
