"""Stored feature tables, model parameters and prediction files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfcast.operators.features import FeatureTables
from shelfcast.session import remove_folder


def save_features(df: DataFrame, path: str, by_week: bool | None = None) -> str:
    """Write a feature table as Parquet; tables with a week are laid out by week by default.

    Rows are dealt to tasks by week first, so a task writes few files; a week too large for one task is split.
    """
    if by_week if by_week is not None else "week" in df.columns:
        df.hint("rebalance", "week").write.mode("overwrite").partitionBy("week").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def load_features(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored feature table; a filter on ``week`` prunes folders."""
    return spark.read.parquet(path)


def save_feature_set(features: FeatureTables, path: str) -> str:
    """Write all feature tables of one history, a folder each below ``path``."""
    for field in fields(features):
        save_features(getattr(features, field.name), f"{path}/{field.name}")
    return path


def load_feature_set(spark: SparkSession, path: str) -> FeatureTables:
    return FeatureTables(**{f.name: load_features(spark, f"{path}/{f.name}") for f in fields(FeatureTables)})


def save_params(spark: SparkSession, params: Mapping[str, int | float | str], path: str) -> str:
    """Write one model's parameters as a one-row table."""
    spark.createDataFrame([tuple(params.values())], list(params)).write.mode("overwrite").parquet(path)
    return path


def load_params(spark: SparkSession, path: str) -> dict:
    rows = spark.read.parquet(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} does not hold exactly one parameter row")
    return rows[0].asDict()


def submission(df: DataFrame, prediction: str, key: str = "id", name: str = "demand") -> DataFrame:
    return df.select(key, F.col(prediction).alias(name))


def write_submission(df: DataFrame, path: str, prediction: str, key: str = "id", name: str = "demand") -> str:
    """Write ``(key, prediction)`` as CSV with a header, one part file per task."""
    submission(df, prediction, key, name).write.mode("overwrite").option("header", True).csv(path)
    return path


def submission_long(df: DataFrame, models: Mapping[str, str], key: str = "id", name: str = "demand") -> DataFrame:
    """One row per request and model, from one pass over the predictions."""
    wide = df.select(key, *[F.col(c).cast("double").alias(m) for m, c in models.items()])
    return wide.unpivot([key], list(models), "model", name)


def write_submissions(df: DataFrame, path: str, models: Mapping[str, str], written: bool = False, **kwargs) -> str:
    """All prediction files in one job: one folder per model below ``path``.

    ``written`` tells that the predictions are a plain scan. Each file is then a pass of its own over them, which moves
    and sorts nothing.
    """
    if written:
        remove_folder(df.sparkSession, path)
        for model in models:
            rows = submission_long(df, {model: models[model]}, **kwargs).drop("model")
            rows.write.option("header", True).csv(f"{path}/model={model}")
        return path
    long = submission_long(df, models, **kwargs)
    long.hint("rebalance", "model").write.mode("overwrite").partitionBy("model").option("header", True).csv(path)
    return path
