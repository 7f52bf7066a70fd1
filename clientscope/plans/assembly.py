"""Last step of the chain: one row per client, free before paid."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clientscope.operators.joins import not_in


def free_then_paid(df: DataFrame, key: str = "epk", status: str = "payment_status") -> DataFrame:
    """Distinct free rows, and distinct paid rows of clients that are not free."""
    free = df.where(df[status] == "FREE").distinct()
    paid = df.where(df[status] == "PAID").distinct()
    return free.unionByName(not_in(paid, free, key))
