"""Ranking inside a client. Rows per client are first reduced by aggregation, so a heavy client costs no more."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientscope.functions.numbers import gap_percent


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """One row per key: the largest by ``order`` (compared left to right), ties by the columns themselves.

    ``max`` of a struct combines map-side, so unlike ``row_number() = 1`` a heavy key reaches the shuffle as one row per
    task. With strings in the struct each map task sorts its own rows for that.
    """
    ordered = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *[F.col(c) for c in cols])
    best = df.groupBy(*keys).agg(F.max(ordered).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in cols])


def rank_in_client(df: DataFrame, key: str, order: Sequence[Column], out: str = "rn") -> DataFrame:
    """Row number inside the client. For frames with a bounded number of rows per client (one per category)."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(key).orderBy(*order)))


def wide_top(df: DataFrame, key: str, rank: str, n: int, cols: Sequence[str]) -> DataFrame:
    """Rank rows to columns ``top<i>_<col>``."""
    return (
        df.where(F.col(rank) <= n)
        .groupBy(key)
        .agg(*[F.max(F.when(F.col(rank) == i, F.col(c))).alias(f"top{i}_{c}") for i in range(1, n + 1) for c in cols])
    )


def with_runner_up(df: DataFrame, key: str, score: str, tie: str, out: str = "second_score") -> DataFrame:
    w = W.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rn", F.row_number().over(w)).withColumn(out, F.lead(score).over(w))


def top_two(df: DataFrame, key: str, category: str, score: str) -> DataFrame:
    """``top1_*`` and ``top2_*`` per client with the gap between them in percent."""
    ranked = rank_in_client(df, key, [F.col(score).desc(), F.col(category)])
    return wide_top(ranked, key, "rn", 2, [category, score]).withColumn(
        "gap_pct", gap_percent(F.col(f"top1_{score}"), F.coalesce(F.col(f"top2_{score}"), F.lit(0.0)))
    )
