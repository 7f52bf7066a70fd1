"""Join shapes that recur in the pipeline. Facts are aggregated to one row per client before they are joined."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def left_chain(base: DataFrame, parts: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Left-join per-client results one after the other; all share the key, so the base is shuffled once."""
    return reduce(lambda left, part: left.join(part, on, "left"), parts, base)


def assemble(target: DataFrame, blocks: Sequence[DataFrame], on: Sequence[str] = ("epk", "report_dt")) -> DataFrame:
    """Target with all feature blocks. Equal rows of a block count once; two different rows for one key are an error."""
    return left_chain(target, [one_row_per_key(b, on) for b in blocks], list(on))


def one_row_per_key(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows by key; the job fails if a key has rows that differ.

    A block that was grouped by the key already is partitioned by it, so this needs no further shuffle.
    """
    others = [c for c in df.columns if c not in on]
    if not others:
        return df.distinct()
    mark = F.md5(F.to_json(F.struct(*others), {"ignoreNullFields": "false"}))
    kept = df.withColumn("__mark", mark).groupBy(*on).agg(
        *[F.first(c).alias(c) for c in others], F.countDistinct("__mark").alias("__rows")
    )
    fault = F.concat(F.lit("different rows for one key: "), F.to_json(F.struct(*on)))
    checked = F.when(F.col("__rows") > 1, F.raise_error(fault).cast("int")).otherwise(1)
    return kept.where(checked == 1).select(*df.columns)


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``key NOT IN (select key from other)`` with SQL's null rule, as an anti join.

    One null in ``other`` empties the result, and a null key is never kept (unless ``other`` is empty).
    The null test is one scalar subquery, so no null-aware broadcast join is needed.
    """
    nulls = F.count(F.when(F.col(key).isNull(), 1))
    # 2: other is empty, everything stays; 1: keys that are not null may stay; 0: a null in other, nothing stays.
    rule = other.agg(F.when(F.count(F.lit(1)) == 0, 2).when(nulls == 0, 1).otherwise(0).alias("rule")).scalar()
    return df.where(rule >= F.when(F.col(key).isNotNull(), 1).otherwise(2)).join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def keys_seen_once(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs exactly once.

    One aggregation that carries the row along: a group of one row is that row. A heavy key is combined to one row
    per map task, and the input is read and shuffled once.
    """
    others = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in others])
    return grouped.where("__n = 1").select(*df.columns)


def join_recent(
    facts: DataFrame, target: DataFrame, months: int, key: str = "epk", fact_dt: str = "dt", target_dt: str = "report_dt"
) -> DataFrame:
    """Target rows with the facts of the last ``months`` months before each target date (unmatched targets stay)."""
    f = facts.withColumnRenamed(key, "__k")
    on: Column = (
        (F.col("__k") == target[key])
        & (F.col(fact_dt) <= target[target_dt])
        & (F.col(fact_dt) >= F.add_months(target[target_dt], -(months - 1)))
    )
    return target.join(f, on, "left").drop("__k")
