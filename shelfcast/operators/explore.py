"""Sales exploration: totals per client, distinct counts, histograms, the score board."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfcast.functions.scalars import label_thousands, ratio, strict


def client_sales(sales: DataFrame, clients: DataFrame, strict_nulls: bool = False) -> DataFrame:
    """Totals, return rate and average price per client name, largest sales first.

    Rows are summed per client before the join, so the join sees one row per client. A client listed
    under two names gives two rows. The join strategy is left to the size Spark measures.
    """
    sums = {
        "units": "units_sold",
        "amount": "sales_amount",
        "return_units": "return_units",
        "return_amount": "return_amount",
        "net_units": "demand",
    }
    totals = sales.groupBy("client_id").agg(
        *[
            (strict(F.sum(c), F.col(c)) if strict_nulls else F.sum(c)).alias(name)
            for name, c in sums.items()
        ]
    )
    measures = totals.withColumns(
        {
            "return_rate": ratio(F.col("return_units"), F.col("units") + F.col("return_units")),
            "avg_price": ratio(F.col("amount"), F.col("units")),
            "net_amount": F.col("amount") - F.col("return_amount"),
        }
    )
    return measures.join(clients, "client_id").orderBy(F.desc("amount"), "client_id", "client_name")


def top_clients(sales: DataFrame, clients: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` largest clients with what a tree map of them needs."""
    return client_sales(sales, clients).limit(k).select(
        "client_id", "client_name", "amount", "units", "return_rate"
    )


def n_distinct_by(df: DataFrame, key: str, column: str, name: str = "n", approximate: bool = False) -> DataFrame:
    """Distinct values of ``column`` per ``key``.

    The exact count drops duplicates per (key, value) first, so a key that owns most rows is spread
    over its values.
    """
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(key).agg(count(F.col(column)).alias(name))


def histogram(df: DataFrame, column: str, width: float = 1) -> DataFrame:
    """Rows per bin ``[start, start + width)`` of a numeric column."""
    start = (F.floor(F.col(column) / width) * width).cast("double")
    return df.groupBy(start.alias("bin_start")).agg(F.count("*").alias("rows"))


def labelled_histogram(df: DataFrame, column: str, width: float = 1) -> DataFrame:
    """A histogram whose counts also carry an axis label in thousands."""
    return histogram(df, column, width).withColumn("label", label_thousands(F.col("rows")))


def repeat_pair_pct(sales: DataFrame) -> DataFrame:
    """Pairs sold more than once, as a percentage of sales rows (not of pairs), from one pass."""
    pairs = sales.groupBy("product_id", "client_id").agg(F.count("*").alias("rows"))
    return pairs.select((F.count_if(F.col("rows") > 1) / F.sum("rows") * 100).alias("repeat_pct"))


def first_per_key(df: DataFrame, key: str, order: str, keep: Sequence[str]) -> DataFrame:
    """First row per key in the given order.

    A minimum over (order, kept columns) combines before the shuffle; ranking the rows of a key in a
    window would sort all of them in one task.
    """
    first = F.min(F.struct(F.col(order), *[F.col(c) for c in keep if c != order])).alias("first")
    return df.groupBy(key).agg(first).select(key, *[F.col(f"first.{c}").alias(c) for c in keep])


def leaderboard_first(board: DataFrame, below: float = 1.0) -> DataFrame:
    """Each team's first submission, kept when its score is below the limit."""
    firsts = first_per_key(board, "team_id", "submitted_seq", ["score", "submitted_seq"])
    return firsts.where(F.col("score") < below)


# The score lines drawn over the score-board histogram.
SCORE_LINES = (0.83, 0.53, 0.486, 0.4602)


def leaderboard_lines(firsts: DataFrame, lines: Sequence[float] = SCORE_LINES) -> DataFrame:
    """Teams at or below each score line; one pass over the teams for all lines."""
    counts = firsts.agg(
        *[F.count_if(F.col("score") <= line).alias(str(i)) for i, line in enumerate(lines)],
    )
    pairs = F.array(*[F.struct(F.lit(x).alias("line"), F.col(str(i)).alias("teams")) for i, x in enumerate(lines)])
    return counts.select(F.inline(pairs))
