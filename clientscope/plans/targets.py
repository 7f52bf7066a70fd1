"""Training targets from contact channels and campaign responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.functions.dates import shift_month_end
from clientscope.functions.predicates import first_match, none_of_counts, some_of_counts, zero_or_null
from clientscope.operators.joins import keys_seen_once, left_chain
from clientscope.operators.ranking import sample_rows

# An activity counts as held from this length on; report dates lie this many months before the start.
HELD_SECONDS = 60
LAGS = (1, 3, 13)


def manager_activity(df: DataFrame, is_call: Column, is_meeting: Column, seconds: int = HELD_SECONDS) -> DataFrame:
    """Calls, held calls and held meetings per client and day. ``df``: epk, start, end and what the conditions use."""
    # Microseconds, because a fraction of a second may decide.
    micros = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    held = micros >= seconds * 1_000_000
    return df.groupBy("epk", F.col("start").cast("date").alias("activity_dt")).agg(
        F.count(F.when(is_call, 1)).alias("is_call"),
        F.count(F.when(is_call & held, 1)).alias(f"is_call_{seconds}"),
        F.count(F.when(is_meeting & held, 1)).alias(f"is_meet_{seconds}"),
    )


def remote_calls(df: DataFrame, success_seconds: float = 1) -> DataFrame:
    """Calls and successful calls per client and day. ``df``: epk, activity_dt, seconds, answered."""
    talked = F.col("seconds") > 0
    return df.groupBy("epk", "activity_dt").agg(
        F.count(F.when(talked, 1)).alias("is_call"),
        F.count(F.when((F.col("seconds") >= success_seconds) | (talked & F.col("answered")), 1)).alias("is_call_success"),
        F.lit(0).alias("is_meet"),
    )


def channel_counts(base: DataFrame, channels: dict[str, DataFrame], key: str = "epk") -> DataFrame:
    """Base clients with one count column per channel; null where a client has no row in the channel."""
    counted = [df.groupBy(key).agg(F.count(F.lit(1)).alias(name)) for name, df in channels.items()]
    return left_chain(base, counted, key)


def four_class(df: DataFrame, branch: str, online: str, contact: Sequence[str], strict: bool = True) -> DataFrame:
    """Classes 1-4 from one pass: branch visits or not, crossed with self-service or contact.

    ``strict=False`` treats a counter that is present but zero as contact.
    """
    none, some = none_of_counts(contact), some_of_counts(contact, strict)
    b, o = F.col(branch).isNotNull(), F.col(online).isNotNull()
    target = first_match(
        [("1", b & o & none), ("2", b & ~o & some), ("3", ~b & o & none), ("4", ~b & ~o & some)]
    )
    return df.withColumn("target", target).where("target is not null")


def five_class(
    df: DataFrame, branch: str, online: str, contact: Sequence[str], visits: int = 2, strict: bool = True
) -> DataFrame:
    """Classes 1-5: many or few branch sales crossed with self-service or contact; 5 is no activity at all.

    A null branch count is neither many nor few: such a client is class 5 or has no class.
    """
    none, some = none_of_counts(contact), some_of_counts(contact, strict)
    online_some = some_of_counts([online], strict)
    many, few = F.col(branch) >= visits, F.col(branch) < visits
    target = first_match(
        [
            ("1", many & online_some & none),
            ("2", many & zero_or_null(online) & some),
            ("3", few & online_some & none),
            ("4", few & zero_or_null(online) & some),
            ("5", zero_or_null(branch) & zero_or_null(online) & none),
        ]
    )
    return df.withColumn("target", target).where("target is not null")


def unique_over_periods(periods: Sequence[DataFrame], key: str = "epk") -> DataFrame:
    """Clients labelled in exactly one period."""
    out = periods[0]
    for p in periods[1:]:
        out = out.unionByName(p)
    return keys_seen_once(out, key)


def unique_sample(periods: Sequence[DataFrame], n: int, key: str = "epk", seed: str = "0") -> DataFrame:
    return sample_rows(unique_over_periods(periods, key), n, key, seed)


def channel_sales(
    sales: DataFrame, segment: DataFrame, classes: Sequence[str], channels: Sequence[str], start: Column, end: Column
) -> DataFrame:
    """Sales of listed product classes and channels by clients of the active segment."""
    return sales.where(
        F.col("product_class").isin(list(classes)) & F.col("channel").isin(list(channels)) & F.col("sale_dt").between(start, end)
    ).join(segment.select("epk").distinct(), "epk", "left_semi")


def campaign_contacts(
    df: DataFrame,
    excluded_splits: Sequence[str],
    excluded_types: Sequence[str],
    types: Sequence[str | None],
    campaigns: Sequence[str],
    max_days: int = 10,
) -> DataFrame:
    """Offers per client: no excluded split, a known campaign, offered and accepted within the cap.

    A ``None`` among the types means that rows without a type count, which an IN list cannot say.
    """
    named = [t for t in types if t is not None]
    typed = F.col("product_type").isin(named)
    if None in types:
        typed = typed | F.col("product_type").isNull()
    kept = df.where(
        ~F.col("split").isin(list(excluded_splits))
        & ~F.coalesce(F.col("product_type"), F.lit("")).isin(list(excluded_types))
        & F.col("campaign").isin(list(campaigns))
        & typed
    ).distinct()
    good = (F.col("days_to_sale") <= max_days) & (F.col("offered") == 1) & (F.col("accepted") == 1)
    return kept.where(good).groupBy("epk").agg(F.count(F.lit(1)).alias("offers"))


def binary_response(history: DataFrame, responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Campaign history with the response flag, 0 where no response is known."""
    one = responses.groupBy(*keys).agg(F.max("responded").alias("target"))
    return history.join(one, list(keys), "left").withColumn("target", F.coalesce("target", F.lit(0)))


def lagged_report_date(start: Column, months: int) -> Column:
    """Month end ``months`` before the start date: features must predate the campaign."""
    return shift_month_end(start, -months)
