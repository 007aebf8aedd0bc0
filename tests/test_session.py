import os

import pytest
from pyspark.sql import functions as F

from shelfcast.session import fresh_folder, materialize, scratch, settle, shared_root


def folders(spark):
    root = shared_root(spark).removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_settle_leaves_the_result_alone(spark):
    before = folders(spark)

    def build():
        step = materialize(spark.range(100).withColumn("k", F.col("id") % 7), "step")
        inner = settle(spark, "inner", lambda: materialize(step, "deep").groupBy("k").count())
        return step.join(inner, "k")

    out = settle(spark, "outcome", build)
    assert out.count() == 100 and out.columns == ["k", "id", "count"]
    left = folders(spark) - before
    assert len(left) == 1 and left.pop().startswith("outcome-")


def test_scratch_is_removed_after_a_failure(spark):
    before = folders(spark)
    with pytest.raises(ValueError), scratch(spark) as path:
        materialize(spark.range(3), "lost")
        assert fresh_folder(spark, "x").startswith(path)
        raise ValueError
    assert folders(spark) == before and not fresh_folder(spark, "x").startswith(path)
