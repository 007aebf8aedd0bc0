"""Column types of every table the engine reads. Types are declared, never inferred."""

from __future__ import annotations

SALES = "week INT, agency_id BIGINT, channel_id INT, route_id BIGINT, client_id BIGINT, product_id BIGINT, " \
        "units_sold INT, sales_amount DOUBLE, return_units INT, return_amount DOUBLE, demand INT"

TABLES: dict[str, str] = {
    "sales": SALES,
    "sales_with_id": f"id STRING, {SALES}",
    "forecast_requests": "id STRING, week INT, agency_id BIGINT, channel_id INT, route_id BIGINT, "
                         "client_id BIGINT, product_id BIGINT",
    "clients": "client_id BIGINT, client_name STRING",
    "brands": "product_id BIGINT, brand STRING, cat_brand INT",
    "leaderboard": "team_id BIGINT, score DOUBLE, submitted_seq BIGINT",
    "applicants": "idx BIGINT, target_flag INT, loan DOUBLE, mortdue DOUBLE, value DOUBLE, reason STRING, "
                  "job STRING, yoj DOUBLE, derog DOUBLE, delinq DOUBLE, clage DOUBLE, ninq DOUBLE, "
                  "clno DOUBLE, debtinc DOUBLE",
}

# What the demand forecasts read of the sales.
SALES_COLUMNS = ("id", "week", "agency_id", "route_id", "client_id", "product_id", "demand")

# Demand keys, from the widest table to the back-off tables.
PAIR = ("product_id", "client_id")

APPLICANT_CATEGORIES = ("reason", "job")
APPLICANT_NUMBERS = ("loan", "mortdue", "value", "yoj", "derog", "delinq", "clage", "ninq", "clno", "debtinc")
