"""Typed table scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from shelfcast.schema import APPLICANT_CATEGORIES, TABLES


def read_table(
    spark: SparkSession,
    path: str,
    table: str | StructType,
    columns: Sequence[str] | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """Scan a CSV, Parquet, ORC or JSON table with its declared schema.

    ``table`` is a name from the schema module, a column list such as ``"a INT, b STRING"``, or a schema.
    ``fmt`` defaults to the file suffix, else Parquet. ``columns`` limits the scan: columnar files
    read only those columns. A malformed text row fails the job instead of becoming NULLs.
    """
    fmt = fmt or next((s for s in ("csv", "orc", "json") if path.rstrip("/").endswith("." + s)), "parquet")
    schema = TABLES.get(table, table) if isinstance(table, str) else table
    reader = spark.read.schema(schema)
    if fmt in ("csv", "json"):
        reader = reader.option("mode", "FAILFAST")
    if fmt == "csv":
        # Compare the header with the schema, so that reordered columns fail instead of shifting.
        reader = reader.option("header", True).option("enforceSchema", False)
    df = reader.format(fmt).load(path)
    return df.select(*columns) if columns else df


def read_brands(spark: SparkSession, path: str, key: str = "PID", **kwargs) -> DataFrame:
    """Brand table; its file calls the product column ``key``."""
    schema = f"{key} BIGINT, brand STRING, cat_brand INT"
    return read_table(spark, path, schema, **kwargs).withColumnRenamed(key, "product_id")


def read_applicants(spark: SparkSession, path: str, **kwargs) -> DataFrame:
    """Credit applicants; a blank category is a category of its own, not a missing value."""
    return blank_as_category(read_table(spark, path, "applicants", **kwargs), APPLICANT_CATEGORIES)


def blank_as_category(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        if not isinstance(df.schema[c].dataType, StringType):
            raise TypeError(f"{c} is not a text column")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})
