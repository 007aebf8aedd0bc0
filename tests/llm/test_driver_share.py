"""What near-duplicates asks of the driver and deals to tasks follows the rows that it is about."""

import random

from pyspark.sql import functions as F

from shelfcast.llm import graph, neardup


def test_map_has_the_size_that_its_rows_need(spark):
    assert neardup.map_bits(0) == neardup.map_bits(500) == neardup.LEAST_BITS
    assert neardup.map_bits(100_000) == 1 << 23 and neardup.map_bits(10**9) == neardup.MAP_BITS
    rows = spark.range(50_000).select(F.col("id").cast("string").alias("key"), "id")
    wanted = rows.where("id % 500 = 3").select(F.col("key").alias("id"))
    found = {r["key"] for r in neardup.perhaps_in(rows, "key", wanted, "id").collect()}
    assert {str(i) for i in range(3, 50_000, 500)} <= found and len(found) < 110


def test_elements_of_sets_are_dealt_evenly(spark, monkeypatch):
    """Sets that lie in one partition give their rows, one per element, in as many tasks as a shuffle has."""
    sets = spark.range(400).select(F.col("id").cast("string").cast("binary").alias("class"),
                                   F.sequence(F.col("id"), F.col("id") + 30).alias("set")).coalesce(1)
    made, write = {}, neardup.materialize

    def kept(df, purpose):
        made[purpose] = out = write(df, purpose)
        if purpose == "elements":
            made["sizes"] = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        return out

    monkeypatch.setattr(neardup, "materialize", kept)
    neardup.prefixes(sets, 80)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(made["sizes"]) == min(tasks, 400) and max(made["sizes"]) <= 2 * 400 * 31 / tasks


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (300, 301)]
    edges += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)]
    top = {n: n for e in edges for n in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = graph.components(spark.createDataFrame(edges + edges[:9], "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == top
