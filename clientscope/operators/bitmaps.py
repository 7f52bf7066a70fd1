"""Distinct counts that can be merged: clients as bits, so that months add up without their facts being read again.

A bitmap covers 32,768 neighbouring client numbers. Counts are exact. Numbers should lie close together (row numbers,
sequence ids); where they are spread over the whole range of a long, number the clients first, or a bitmap holds few bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP = ("bucket", "bitmap")


def client_bitmaps(df: DataFrame, by: Sequence[str | Column], key: str | Column) -> DataFrame:
    """by..., bucket, bitmap: the clients found in every group. Rows are combined before the shuffle, a bit for each client.

    A null key is nobody.
    """
    k = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    groups = [F.col(b) if isinstance(b, str) else b for b in by]
    flat = df.select(*groups, k.alias("__k")).where("__k is not null")
    names = flat.columns[:-1]
    placed = flat.select(*[F.col(f"`{n}`") for n in names], F.bitmap_bucket_number("__k").alias("bucket"), F.bitmap_bit_position("__k").alias("__at"))
    return placed.groupBy(*[f"`{n}`" for n in names], "bucket").agg(F.bitmap_construct_agg("__at").alias("bitmap"))


def merged(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bitmaps of coarser groups: who is in any of the finer ones."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def common(bitmaps: DataFrame, by: Sequence[str], over: str) -> DataFrame:
    """The bitmaps of who is in all groups of ``over``, group by group of ``by``."""
    needed = bitmaps.select(*by, over).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("__all"))
    both = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("__n"))
    same = [F.col(f"a.{b}").eqNullSafe(F.col(f"b.{b}")) for b in by]
    joined = both.alias("a").join(needed.alias("b"), same, "inner") if by else both.crossJoin(F.broadcast(needed))
    kept = joined.where(F.col("__n") == F.col("__all"))
    return kept.select(*[F.col(f"a.{b}").alias(b) for b in by] if by else [], "bucket", "bitmap")


def clients(bitmaps: DataFrame, by: Sequence[str], name: str = "clients") -> DataFrame:
    """Number of clients of each group; bitmaps of a group and bucket must be merged already."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).cast("bigint").alias(name))
