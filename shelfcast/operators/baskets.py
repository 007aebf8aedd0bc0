"""Market-basket analysis: item sets per client, frequent itemsets and association rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.session import materialize


def basket_pairs(sales: DataFrame, after: int = 8, last: int = 9) -> DataFrame:
    """Distinct (client, product) pairs of the weeks in ``(after, last]``."""
    chosen = sales.where((F.col("week") > after) & (F.col("week") <= last))
    return chosen.select("client_id", "product_id").distinct()


def baskets(pairs: DataFrame) -> DataFrame:
    """One sorted item set per client. Its size is at most the number of products."""
    return pairs.groupBy("client_id").agg(F.array_sort(F.collect_set("product_id")).alias("items"))


def basket_duplicates(lines: DataFrame) -> DataFrame:
    """Repeated items per basket: lines less distinct items."""
    return lines.groupBy("client_id").agg(
        (F.count("product_id") - F.count_distinct("product_id")).alias("duplicates")
    )


def basket_count(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_distinct("client_id").alias("baskets"))


def item_support(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Share of baskets holding each item, optionally the ``k`` most frequent."""
    freq = pairs.groupBy("product_id").agg(F.count("*").alias("freq"))
    support = freq.withColumn("support", F.col("freq") / basket_count(pairs).scalar())
    return support.orderBy(F.desc("freq"), "product_id").limit(k) if k else support


def frequent_itemsets(pairs: DataFrame, min_support: float, max_len: int = 5) -> DataFrame:
    """Itemsets held by at least ``min_support`` of the baskets, up to ``max_len`` items.

    Level by level: a candidate of k items joins two frequent sets of k - 1 that differ in the last item, and is
    counted only in baskets that hold the first of them; nothing longer than ``max_len`` is ever made. Baskets are
    rows (client, set), so a basket or an item of any size is spread like every other row.
    """
    pairs = materialize(pairs, "basket-pairs")
    least = min_support * pairs.select("client_id").distinct().count()
    baskets_in_all = basket_count(pairs)

    def level(rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy("items").agg(F.count("*").alias("freq")).where(F.col("freq") >= least), "itemsets")

    held = pairs.where(F.col("product_id").isNotNull()).select("client_id", F.array("product_id").alias("items"))
    frequent = level(held)
    found = frequent
    held = materialize(held.join(frequent, "items", "left_semi"), "held")
    single = held.select("client_id", F.col("items")[0].alias("item"))
    for _ in range(1, max_len):
        if frequent.limit(1).count() == 0:
            break
        known = frequent.select(F.col("items").alias("other"))
        grown = held.join(single, "client_id").where(F.col("item") > F.element_at("items", -1))
        other = F.concat(F.slice("items", 1, F.size("items") - 1), F.array("item"))
        grown = grown.join(known, other == F.col("other"), "left_semi")
        grown = grown.select("client_id", F.concat("items", F.array("item")).alias("items"))
        frequent = level(grown)
        held = materialize(grown.join(frequent, "items", "left_semi"), "held")
        found = found.unionByName(frequent)
    return found.select("items", "freq", (F.col("freq") / baskets_in_all.scalar()).alias("support"))


def rules(itemsets: DataFrame, min_confidence: float = 0.5, include_empty: bool = True) -> DataFrame:
    """Rules with one item on the right, from the table of frequent itemsets.

    Every part of a frequent set is itself in the table, so supports come from equi-joins on item
    sets. ``include_empty`` adds rules with nothing on the left, whose confidence is the support.
    """
    known = itemsets.select(F.col("items").alias("antecedent"), F.col("support").alias("left_support"))
    single = itemsets.where(F.size("items") == 1).select(
        F.col("items")[0].alias("consequent"), F.col("support").alias("right_support")
    )
    split = itemsets.where(F.size("items") > 1).select(
        "items", "freq", "support", F.explode("items").alias("consequent")
    )
    split = split.withColumn("antecedent", F.array_except("items", F.array("consequent"))).drop("items")
    full = split.join(known, "antecedent").withColumn("confidence", F.col("support") / F.col("left_support"))
    columns = ["antecedent", "consequent", "freq", "support", "confidence", "lift"]
    out = (
        full.where(F.col("confidence") >= min_confidence)
        .join(single, "consequent")
        .withColumn("lift", F.col("confidence") / F.col("right_support"))
        .select(columns)
    )
    if not include_empty:
        return out
    empty = itemsets.where((F.size("items") == 1) & (F.col("support") >= min_confidence)).select(
        F.slice("items", 1, 0).alias("antecedent"),
        F.col("items")[0].alias("consequent"),
        "freq",
        "support",
        F.col("support").alias("confidence"),
        F.lit(1.0).alias("lift"),
    )
    return out.unionByName(empty)


def top_rules(found: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` rules with the highest lift; ties go to more baskets, then to the smaller item sets."""
    lift = F.round("lift", 6)
    return found.orderBy(F.desc(lift), F.desc("freq"), "consequent", "antecedent").limit(k)


def rule_edges(found: DataFrame) -> DataFrame:
    """Rule graph rows: which items stand on which side of each rule."""
    rule = F.concat(F.array_join("antecedent", ","), F.lit("=>"), F.col("consequent").cast("string"))
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.col("antecedent").alias("items")),
        F.struct(F.lit("right").alias("side"), F.array("consequent").alias("items")),
    )
    return found.select(rule.alias("rule"), F.inline(sides)).select(
        "rule", "side", F.explode("items").alias("product_id")
    )
