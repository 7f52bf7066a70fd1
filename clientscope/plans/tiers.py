"""Client tiers: free by tag, paid by assets, spending and business balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.functions.dates import day, in_month_to_date
from clientscope.functions.numbers import null_safe_sum
from clientscope.functions.predicates import all_of, any_of, first_match, is_current
from clientscope.operators.joins import left_chain

# Tag codes per level, best level first.
LEVEL_TAGS = {
    6: ("41384",),
    5: ("41292", "41620"),
    4: ("41291", "41619"),
    3: ("39543", "41618"),
    2: ("39542", "41617"),
    1: ("39541", "41616"),
}
# Fixed values: (from, to) bands of assets x, spending y and business balance z per paid level.
PAID_BANDS = {
    3: {"x": (2_000_000, 3_000_000), "y": (150_000, 200_000), "z": (2_000_000, 3_000_000)},
    2: {"x": (1_000_000, 2_000_000), "y": (100_000, 150_000), "z": (1_000_000, 2_000_000)},
    1: {"x": (500_000, 1_000_000), "y": (40_000, 100_000), "z": (500_000, 1_000_000)},
}
AGES = (18, 69)


def active_base(
    snapshot: DataFrame,
    report_dt: str,
    age_range: tuple[int, int] = AGES,
    age: str = "age",
    dead: str = "dead",
    active: str = "active",
) -> DataFrame:
    """Living, active clients of the age range at one month end."""
    return snapshot.where(
        (F.col("report_dt") == day(report_dt))
        & F.col(age).between(*age_range)
        & (F.col(dead) == 0)
        & (F.col(active) == 1)
    )


def band_level(bands: Mapping[int, Mapping[str, tuple[float, float]]], gate: Column) -> Column:
    """Highest level with some total at or above its lower bound and some total at or below its upper bound."""
    rules = [
        (
            level,
            gate
            & any_of(F.col(c) >= float(lo) for c, (lo, _) in limits.items())
            & any_of(F.col(c) <= float(hi) for c, (_, hi) in limits.items()),
        )
        for level, limits in sorted(bands.items(), reverse=True)
    ]
    return first_match(rules, 0)


def free_tier(tags: DataFrame, level_tags: Mapping[int, Sequence[str]] = LEVEL_TAGS) -> DataFrame:
    """Level and criterion per client from open tags: epk, approval_level, payment_status, approval_criteria, ..."""
    known = [t for codes in level_tags.values() for t in codes]
    level = first_match([(lv, F.col("nsi_id").isin(list(codes))) for lv, codes in level_tags.items()], 0)
    return (
        tags.where(is_current() & F.col("nsi_id").isin(known))
        .groupBy("epk")
        .agg(F.max(level).alias("approval_level"), F.max("nsi_id").alias("approval_criteria"))
        .select(
            "epk",
            "approval_level",
            F.lit("FREE").alias("payment_status"),
            "approval_criteria",
            F.lit("").alias("primary_approval_criterion"),
        )
    )


def paid_tier(
    base: DataFrame,
    assets: DataFrame,
    balances: DataFrame,
    acquiring: DataFrame,
    scores: DataFrame,
    report_dt: str,
    bands: Mapping[int, Mapping[str, tuple[float, float]]] = PAID_BANDS,
) -> DataFrame:
    """Paid levels. ``base``: epk and the money columns below; the others: epk, amount, dt of the running month.

    assets x = deposits + investments + insurance + managed assets; spending y = debit + credit + acquiring;
    z = business balance. A level needs a score at or above the mean score of all clients.
    """
    money = ("dep", "inv", "insur", "pos_dc", "pos_cc")
    own = base.groupBy("epk").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in money])

    def month_total(df: DataFrame, name: str) -> DataFrame:
        return df.where(in_month_to_date(F.col("dt"), report_dt)).groupBy("epk").agg(F.sum("amount").alias(name))

    joined = left_chain(
        own,
        [month_total(assets, "aum"), month_total(balances, "z"), month_total(acquiring, "acq"), scores.select("epk", "score")],
        "epk",
    )
    totals = joined.select(
        "epk",
        "score",
        null_safe_sum(["dep", "inv", "insur", "aum"]).alias("x"),
        null_safe_sum(["pos_dc", "pos_cc", "acq"]).alias("y"),
        F.coalesce(F.col("z"), F.lit(0.0)).alias("z"),
    )
    mean = scores.agg(F.avg("score")).scalar()
    return (
        totals.withColumn("passes", F.col("score") >= mean)
        .select("epk", band_level(bands, F.col("passes")).alias("approval_level"))
        .where("approval_level >= 1")
        .select(
            "epk",
            "approval_level",
            F.lit("PAID").alias("payment_status"),
            F.lit("").alias("approval_criteria"),
            F.lit("").alias("primary_approval_criterion"),
        )
    )


def all_tiers(free: DataFrame, paid: DataFrame) -> DataFrame:
    """Paid clients that are not free, and all free clients."""
    return paid.join(free.select("epk"), "epk", "left_anti").unionByName(free)


def key_check(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(key).alias("n"), F.countDistinct(key).alias("n_distinct"))


__all__ = ["active_base", "all_of", "all_tiers", "band_level", "free_tier", "key_check", "paid_tier"]
