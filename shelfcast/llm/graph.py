"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfcast.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge; the root is the smallest node of the component.

    A round gives every node the smallest label among itself and its neighbours, then that label's own label. Labels
    are a written table, so a node with very many neighbours is a skewed join side that is split at run time, and
    minima are combined before the shuffle.
    """
    one_way = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    other = edges.select(F.col(b).alias("src"), F.col(a).alias("dst"))
    both = materialize(one_way.unionByName(other).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["src"] == labels["node"]).select(F.col("dst").alias("node"), "root")
        # Own labels and those of neighbours meet in one shuffle; only an own label counts as the old one.
        spread = labels.withColumn("old", F.col("root")).unionByName(near, allowMissingColumns=True)
        lower = materialize(spread.groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old")), "labels")
        if lower.where("root != old").isEmpty():
            return labels
        up = lower.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = lower.join(up, lower["root"] == up["up"]).select("node", F.least("root", "top").alias("root"))
        labels = materialize(jumped, "labels")
