"""Reading tables: projected, partition-listed, month-sequenced and sharded scans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, source: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A catalog table or a Parquet path, projected to the columns asked for."""
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    return df.select(*cols) if cols else df


def scan_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read a Parquet directory and expose it to SQL under ``name``."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def at_dates(df: DataFrame, dates: Sequence[str], col: str = "report_dt") -> DataFrame:
    """Only the listed month ends; on a table partitioned by the column this prunes partitions."""
    return df.where(F.col(col).isin([F.lit(d).cast("date") for d in dates]))


def month_sequence(df: DataFrame, col: str = "report_dt") -> DataFrame:
    """Every month end from the first to the last date of the column, computed without a driver round trip."""
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).select(
        F.explode(F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("interval 1 month"))).alias("m")
    ).select(F.last_day("m").alias(col))


def union_shards(shards: Sequence[DataFrame], each: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Union of equally shaped shard tables with the same step applied to each scan."""
    return reduce(DataFrame.unionByName, [each(s) for s in shards])
