"""Checks that return rows, so that a job can act on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_uniqueness(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with a key and distinct keys, per group. Counted per key first, so a heavy key is one row by then."""
    per_key = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.where(F.col(key).isNotNull()).groupBy(*by).agg(
        F.sum("__n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("n_distinct")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and their difference in one pass."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("__n"))
        .agg(F.sum("__n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
        .withColumn("duplicates", F.col("n") - F.col("n_distinct"))
    )


def distinct_values(df: DataFrame, col: Column, name: str) -> DataFrame:
    return df.select(col.alias(name)).distinct()
