"""Deterministic splits by key hash, and folds by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = (("train", 60), ("val", 20), ("test", 20))


def hash_bucket(key: str, seed: str = "0", buckets: int = 100) -> Column:
    """0..buckets-1 from the md5 of key and seed; the same value in any engine and on any run."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def assign_parts(df: DataFrame, key: str, seed: str = "0", parts=PARTS) -> DataFrame:
    """Adds ``part``; no shuffle, and a key never moves between parts."""
    bucket = hash_bucket(key, seed)
    upto, chain = 0, None
    for name, share in parts:
        upto += share
        chain = F.when(bucket < upto, name) if chain is None else chain.when(bucket < upto, name)
    return df.withColumn("part", chain)


def month_folds(dates: list) -> list[tuple[str, list, list]]:
    """(name, training months, validation months) over all month ends.

    Each month after the first is predicted from the first alone and, where there are more, from all before it.
    """
    months = sorted(set(dates))
    if len(months) < 2:
        raise ValueError("folds by month need two months or more")
    folds = []
    for k in range(1, len(months)):
        folds.append((f"m1_to_m{k + 1}", months[:1], [months[k]]))
        if k > 1:
            folds.append(("_".join(f"m{i + 1}" for i in range(k)) + f"_to_m{k + 1}", months[:k], [months[k]]))
    return folds
