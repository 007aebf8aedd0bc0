"""Queries from stored weekly sketches, exact as long as a key has fewer values than a sketch holds, and from bitmaps."""

from __future__ import annotations

from shelfcast.catalog import fixtures as fx_tables
from shelfcast.catalog.fixtures import fx
from shelfcast.catalog.registry import query
from shelfcast.operators import sketches as sk
from shelfcast.session import fresh_folder
from shelfcast.sources import store


def stored(spark, sf_dir):
    """Sketches per week, agency and route, written by week and read again."""
    made = sk.weekly_sketches(
        fx_tables.sales(spark, sf_dir), ["agency_id", "route_id"], ["client_id", "product_id"], ["demand"]
    )
    return store.load_features(spark, store.save_features(made, fresh_folder(spark, "sketches")))


@query(
    "q_sketch_distinct",
    fx("sales") + """SELECT route_id, count(DISTINCT product_id) AS products, count(DISTINCT client_id) AS clients,
       count(demand) AS rows
FROM sales WHERE week BETWEEN 4 AND 8 GROUP BY route_id""",
)
def sketch_distinct(spark, sf_dir):
    merged = sk.over_weeks(stored(spark, sf_dir), ["route_id"], 4, 8)
    return merged.select(
        "route_id",
        sk.count_of("product_id_seen").alias("products"),
        sk.count_of("client_id_seen").alias("clients"),
        sk.rows_of("demand_spread").alias("rows"),
    )


@query(
    "q_sketch_seen_again",
    fx("sales") + """, e AS (SELECT DISTINCT agency_id, client_id FROM sales WHERE week BETWEEN 3 AND 5),
l AS (SELECT DISTINCT agency_id, client_id FROM sales WHERE week BETWEEN 6 AND 9),
ne AS (SELECT agency_id, count(client_id) AS early FROM e GROUP BY agency_id),
nl AS (SELECT agency_id, count(client_id) AS late FROM l GROUP BY agency_id),
nb AS (SELECT agency_id, count(*) AS shared FROM e JOIN l USING (agency_id, client_id) GROUP BY agency_id)
SELECT agency_id, early, late, coalesce(shared, 0) AS "both"
FROM ne JOIN nl USING (agency_id) LEFT JOIN nb USING (agency_id)""",
)
def sketch_seen_again(spark, sf_dir):
    """Clients of an agency in its early weeks, in its late weeks and in both, from stored weekly sets.

    An agency has more clients than a sketch holds, so its sets are bitmaps, which are exact at any size.
    """
    made = sk.weekly_members(fx_tables.sales(spark, sf_dir), ["agency_id"], "client_id")
    tables = store.load_features(spark, store.save_features(made, fresh_folder(spark, "members")))
    return sk.members_over(tables, ["agency_id"], (3, 5), (6, 9))
