"""Joins of rows to a table with one row per key, when some keys own a large share of the rows.

Spark splits skewed join partitions at run time only where both sides come straight from a shuffle.
Here the table side usually is an aggregate that is already partitioned by its key, so hot keys are
found beforehand and split by a salt.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

Keys = tuple[str, ...]


def find_hot_keys(
    rows: DataFrame, key_sets: Iterable[Sequence[str]], fraction: float = 0.01, min_rows: int = 50
) -> dict[Keys, DataFrame]:
    """Keys that would fill more than two average shuffle partitions, with the pieces to split them into.

    Shares are estimated from a sample of the key columns. The sample decides only how rows are
    spread, never which rows are joined. A share above ``2 / partitions`` leaves at most half as many
    keys as there are partitions, so the result is small by construction.
    """
    sets = list(dict.fromkeys(tuple(keys) for keys in key_sets))
    names = list(dict.fromkeys(k for keys in sets for k in keys))
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = rows.select(*names).sample(fraction, seed=1)
    counts = sample.groupingSets([[], *[[F.col(k) for k in keys] for keys in sets]], *names).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n")
    )
    # The grand total comes first, then at most partitions / 2 keys per set that are large enough.
    found = counts.orderBy(F.desc("n"), F.desc("level")).limit(1 + len(sets) * partitions // 2).collect()
    total = found[0]["n"] if found else 0
    floor = max(min_rows, 2 * total / partitions)
    found = [r for r in found[1:] if r["n"] >= floor]
    if not found:
        return {}
    types = dict(rows.select(*names).dtypes)
    hot = {}
    for keys in sets:
        level = sum(1 << (len(names) - 1 - i) for i, name in enumerate(names) if name not in keys)
        picked = [
            # A piece is a quarter of an average partition, so that pieces meeting by chance stay small.
            (*[r[k] for k in keys], -(-4 * r["n"] * partitions // total))
            for r in found
            if r["level"] == level
        ]
        if picked:
            schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "pieces INT"])
            hot[keys] = spark.createDataFrame(picked, schema)
    return hot


def lookup_join(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], hot: Mapping[Keys, DataFrame] | None = None
) -> DataFrame:
    """Left join to a table with unique ``keys``.

    Without hot keys this is a plain join. Otherwise the rows of a hot key are dealt out over its
    pieces and its one table row is repeated per piece; all other rows keep piece 0.
    """
    keys = list(keys)
    pieces = (hot or {}).get(tuple(keys))
    if pieces is None:
        return rows.join(table, keys, "left")
    deal = F.xxhash64("id" if "id" in rows.columns else F.struct(*rows.columns))
    # Rows with a NULL key match nothing, but they may be hot as well: they are dealt out like the others.
    marks = F.broadcast(pieces.select(*[F.col(k).alias(f"__{k}") for k in keys], "pieces"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    dealt = rows.join(marks, same, "left").drop(*[f"__{k}" for k in keys]).withColumn(
        "piece", F.coalesce(F.pmod(deal, F.col("pieces")).cast("int"), F.lit(0))
    )
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1))
    repeated = table.join(F.broadcast(pieces), keys, "left").withColumn("piece", copies).drop("pieces")
    return dealt.drop("pieces").join(repeated, [*keys, "piece"], "left").drop("piece")
