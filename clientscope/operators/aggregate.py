"""Aggregations. Each produces all its columns in one ``agg``, so there is one shuffle and a map-side combine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.functions.numbers import at_least_two, safe_ratio
from clientscope.functions.predicates import flag


def conditional_pivot(
    df: DataFrame, keys: Sequence[str], category: str, labels: Sequence[str], amount: str, extra: Sequence[Column] = ()
) -> DataFrame:
    """Count and amount columns per label (``<label>_cnt``, ``<label>_amt``) plus totals over all rows."""
    per_label = []
    for label in labels:
        hit = F.col(category) == label
        per_label.append(F.count(F.when(hit, 1)).alias(f"{label}_cnt"))
        per_label.append(F.coalesce(F.sum(F.when(hit, F.col(amount))), F.lit(0.0)).alias(f"{label}_amt"))
    return df.groupBy(*keys).agg(
        *per_label,
        F.count(F.lit(1)).alias("all_cnt"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("all_amt"),
        *extra,
    )


def active_month_flags(
    bucket: Column, amount: Column, prefix: str, months: int = 3, condition: Column | None = None
) -> list[Column]:
    """``<prefix>_m<k>``: was there a positive amount in month bucket k."""
    spent = amount > 0 if condition is None else (amount > 0) & condition
    return [F.max(flag(spent & (bucket == k))).alias(f"{prefix}_m{k}") for k in range(1, months + 1)]


def regular(prefix: str, months: int = 3) -> Column:
    return at_least_two([F.coalesce(F.col(f"{prefix}_m{k}"), F.lit(0)) for k in range(1, months + 1)])


def share_columns(labels: Sequence[str]) -> list[Column]:
    """Shares of the client's totals for every label of :func:`conditional_pivot`."""
    out = []
    for label in labels:
        out.append(safe_ratio(F.col(f"{label}_cnt"), F.col("all_cnt"), 0.0).alias(f"{label}_cnt_share"))
        out.append(safe_ratio(F.col(f"{label}_amt"), F.col("all_amt"), 0.0).alias(f"{label}_amt_share"))
    return out


def max_flags(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Collapse duplicates to one row per key with the largest value of every flag, null as zero."""
    return df.groupBy(key).agg(*[F.max(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in cols])


def masked_means(df: DataFrame, by: str, cols: Sequence[str], low: float = -1.0, high: float = 1e8) -> DataFrame:
    """Mean per class of each column over the values inside the open range."""
    return df.groupBy(by).agg(
        *[F.avg(F.when((F.col(c) > low) & (F.col(c) < high), F.col(c))).alias(c) for c in cols]
    )


def count_and_flag(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Conditional counts per key, one column per named condition."""
    return df.groupBy(*keys).agg(*[F.count(F.when(c, 1)).alias(name) for name, c in conditions.items()])
