"""Basket queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfcast.catalog import fixtures as fx_tables
from shelfcast.catalog.fixtures import fx
from shelfcast.catalog.registry import query, rounded
from shelfcast.operators import baskets as bk

MAX_LEN = 5
SUPPORT = 0.01
CONFIDENCE = 0.5


def level_sql(k: int) -> str:
    """Sets of ``k`` items in ascending order, by joining baskets with themselves."""
    columns = ", ".join(f"p{i}.product_id AS i{i}" for i in range(k))
    joins = "".join(
        f" JOIN pairs p{i} ON p{i - 1}.client_id = p{i}.client_id AND p{i - 1}.product_id < p{i}.product_id" for i in range(1, k)
    )
    return f"s{k} AS (SELECT {columns}, count(*) AS freq FROM pairs p0{joins} GROUP BY ALL)"


def names(k: int, without: int | None = None) -> str:
    left = [f"i{i}" for i in range(k) if i != without]
    return f"concat_ws(',', {', '.join(left)})"


PAIRS_SQL = """, lines AS (SELECT * FROM basket_lines WHERE week > 8 AND week <= 9),
pairs AS (SELECT DISTINCT client_id, product_id FROM lines),
n AS (SELECT count(DISTINCT client_id) AS baskets FROM pairs)
"""
LEVELS = range(1, MAX_LEN + 1)
ITEMSETS_SQL = (
    PAIRS_SQL + ", " + ",\n".join(level_sql(k) for k in LEVELS) + ",\nsets AS ("
    + " UNION ALL ".join(f"SELECT {names(k)} AS items, freq FROM s{k}" for k in LEVELS)
    + f"),\nitemsets AS (SELECT items, freq, freq / baskets AS support FROM sets, n WHERE freq >= {SUPPORT} * baskets)\n"
)
SPLITS_SQL = " UNION ALL ".join(
    f"SELECT {names(k, i)} AS antecedent, i{i} AS consequent, freq FROM s{k}" for k in LEVELS[1:] for i in range(k)
)
RULES_SQL = ITEMSETS_SQL + f""",
splits AS ({SPLITS_SQL}),
rules AS (
  SELECT antecedent, consequent, splits.freq, splits.freq / baskets AS support, splits.freq / l.freq AS confidence,
         splits.freq / l.freq / (r.freq / baskets) AS lift
  FROM splits JOIN sets l ON antecedent = l.items JOIN s1 r ON consequent = r.i0, n
  WHERE splits.freq >= {SUPPORT} * baskets AND splits.freq / l.freq >= {CONFIDENCE}
  UNION ALL SELECT '' AS antecedent, i0, freq, freq / baskets, freq / baskets, 1.0::DOUBLE FROM s1, n
  WHERE freq >= {CONFIDENCE} * baskets AND freq >= {SUPPORT} * baskets)
"""


def pairs(spark, sf_dir):
    return bk.basket_pairs(fx_tables.basket_lines(spark, sf_dir))


def found_rules(spark, sf_dir):
    return bk.rules(bk.frequent_itemsets(pairs(spark, sf_dir), SUPPORT, MAX_LEN), CONFIDENCE)


def text(column: str):
    """Item sets as text, so that every engine compares them alike."""
    return F.array_join(column, ",").alias(column)


@query("q_basket_pairs", fx("basket_lines") + PAIRS_SQL + "SELECT client_id, product_id FROM pairs")
def basket_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


@query(
    "q_baskets",
    fx("basket_lines") + PAIRS_SQL
    + "SELECT client_id, string_agg(product_id, ',' ORDER BY product_id) AS items FROM pairs GROUP BY client_id",
)
def baskets(spark, sf_dir):
    return bk.baskets(pairs(spark, sf_dir)).select("client_id", text("items"))


@query(
    "q_basket_duplicates",
    fx("basket_lines") + "SELECT client_id, count(product_id) - count(DISTINCT product_id) AS duplicates "
    "FROM basket_lines WHERE week = 9 GROUP BY client_id",
)
def basket_duplicates(spark, sf_dir):
    return bk.basket_duplicates(fx_tables.basket_lines(spark, sf_dir).where(F.col("week") == 9))


@query(
    "q_top_items",
    fx("basket_lines") + PAIRS_SQL + """SELECT product_id, count(*) AS freq, round(count(*) / any_value(baskets), 6) AS support
FROM pairs, n GROUP BY product_id ORDER BY freq DESC, product_id LIMIT 25""",
)
def top_items(spark, sf_dir):
    return rounded(bk.item_support(pairs(spark, sf_dir), 25))


@query("q_itemsets", fx("basket_lines") + ITEMSETS_SQL + "SELECT items, freq, round(support, 6) AS support FROM itemsets")
def itemsets(spark, sf_dir):
    found = bk.frequent_itemsets(pairs(spark, sf_dir), SUPPORT, MAX_LEN)
    return rounded(found.select(text("items"), "freq", "support"))


RULE_COLUMNS_SQL = """antecedent, consequent, freq, round(support, 6) AS support, round(confidence, 6) AS confidence,
       round(lift, 6) AS lift"""


def rule_rows(found):
    return rounded(found.select(text("antecedent"), "consequent", "freq", "support", "confidence", "lift"))


@query("q_rules", fx("basket_lines") + RULES_SQL + f"SELECT {RULE_COLUMNS_SQL} FROM rules")
def rules(spark, sf_dir):
    return rule_rows(found_rules(spark, sf_dir))


@query(
    "q_rules_top_lift",
    fx("basket_lines") + RULES_SQL + f"""SELECT {RULE_COLUMNS_SQL} FROM rules
ORDER BY round(rules.lift, 6) DESC, freq DESC, consequent,
         list_transform(string_split(nullif(antecedent, ''), ','), lambda x: CAST(x AS BIGINT)) NULLS FIRST LIMIT 20""",
)
def rules_top_lift(spark, sf_dir):
    return rule_rows(bk.top_rules(found_rules(spark, sf_dir), 20))


@query(
    "q_rule_edges",
    fx("basket_lines") + RULES_SQL + """SELECT concat(antecedent, '=>', consequent) AS rule, 'right' AS side,
       consequent AS product_id FROM rules
UNION ALL SELECT concat(antecedent, '=>', consequent), 'left', CAST(unnest(string_split(antecedent, ',')) AS BIGINT)
FROM rules WHERE antecedent <> ''""",
)
def rule_edges(spark, sf_dir):
    return bk.rule_edges(found_rules(spark, sf_dir))
