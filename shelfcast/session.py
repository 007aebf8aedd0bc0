"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; ``conf`` overrides.

    On a cluster the launcher sizes executors and ``spark.sql.shuffle.partitions``;
    AQE then merges small shuffle partitions and splits skewed join partitions.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot join key even where the split costs one more shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Hash instead of sort where the measured partitions of one side are small.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    builder = SparkSession.builder.appName("shelfcast")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where that is unset, a folder in the warehouse, which a session's executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "shelfcast-work")


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder, or the current ``scratch`` folder; nothing is created or removed."""
    return os.path.join(_SCRATCH.get() or shared_root(spark), f"{purpose}-{uuid.uuid4().hex}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there, by way of Spark's file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables that are written inside; it is removed at the end, by way of Spark's file system."""
    path = fresh_folder(spark, "scratch")
    token = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(token)
        remove_folder(spark, path)


def settle(spark: SparkSession, purpose: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written; all tables that it wrote on the way are removed.

    Shuffle files of plans that nobody holds any more go when the driver collects its memory, so it is asked to.
    """
    path = fresh_folder(spark, purpose)
    with scratch(spark):
        made = build()
        made.write.parquet(path)
        schema = made.schema
        del made
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def materialize(df: DataFrame, purpose: str = "table") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and continue from the files.

    This cuts the lineage, survives lost executors, and later reads still prune columns. A later join sees both sides
    as plain scans, which is what run-time skew handling needs.
    """
    path = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and continue from the written copy."""
    return materialize(df)


def shuffled_once(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in the partitions and the order that it gives them; plans on top share its shuffle.

    Every plan of ``df`` itself would shuffle again. Files of a lost executor are made again from the rows below.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)
