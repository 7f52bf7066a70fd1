"""Top lifestyle category per client from card spending and tags, and perk flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.functions.dates import calendar_month_bucket, day, in_lookback, month_start
from clientscope.functions.predicates import first_match, flag
from clientscope.operators.aggregate import active_month_flags, conditional_pivot, regular
from clientscope.plans import catalog
from clientscope.plans import scoring as s


def category_spend(tx: DataFrame, anchor: str, category: Column, categories: Sequence[str]) -> DataFrame:
    """One row per client: count and amount per category, totals, and which of the last three months had spending.

    ``tx``: epk, amt, dt and what ``category`` reads. Rows without a category are left out of every total.
    """
    start = F.add_months(month_start(anchor), -2)
    rows = tx.where(F.col("dt").between(start, day(anchor))).withColumn("category", category).where("category is not null")
    bucket = F.coalesce(calendar_month_bucket(F.col("dt"), anchor), F.lit(0))
    return conditional_pivot(
        rows, ["epk"], "category", categories, "amt", active_month_flags(bucket, F.col("amt"), "spend")
    )


def base_scores(spend: DataFrame, categories: Sequence[str]) -> DataFrame:
    """epk and ``ranked``: all categories with their score, best first."""
    steady = regular("spend")
    return spend.select("epk", s.score_array({c: s.weighted_score(c, steady) for c in categories}).alias("ranked"))


def top_category(
    tx: DataFrame,
    tags: DataFrame,
    anchor: str,
    category: Column | None = None,
    categories: Sequence[str] = catalog.LIFESTYLE_CATEGORIES,
    tag_category: Column | None = None,
) -> DataFrame:
    """Best category per client. Tags decide only when the two best scores are close, or when there is no score.

    The bonus of a category is limited by its score; without one by the top score, and without that by one.
    """
    if category is None:
        category = first_match([(c, F.col("mcc_code").isin(list(codes))) for c, codes in catalog.LIFESTYLE_CODES])
    if tag_category is None:
        tag_category = s.tag_label(F.col("nsi_id"), catalog.LIFESTYLE_TAGS)
    scored = base_scores(category_spend(tx, anchor, category, categories), categories)
    counts = s.tag_counts(tags, tag_category, categories)
    top, second = F.col("ranked")[0]["score"], F.col("ranked")[1]["score"]
    use_tags = (top == 0) | s.is_close(top, second)

    def final(x: Column) -> Column:
        limit = F.when(x["score"] > 0, x["score"]).when(top > 0, top).otherwise(1.0)
        extra = F.when(use_tags, s.bonus(s.count_of(F.col("tag_counts"), x["category"]), limit)).otherwise(0.0)
        return F.struct(x["category"].alias("category"), (x["score"] + extra).alias("final"))

    return scored.join(counts, "epk", "left").select(
        "epk", s.winner(F.transform("ranked", final), "final").alias("top_category")
    )


def perk_flags(tx: DataFrame, anchor: str, perks: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """1 where a client paid at one of the perk's merchant codes within the last month."""
    perks = perks or {"lounge": catalog.LOUNGE_CODES, "taxi": catalog.TAXI_CODES}
    return (
        tx.where(in_lookback(F.col("dt"), anchor, 1) & F.col("mcc_code").isNotNull())
        .groupBy("epk")
        .agg(*[F.max(flag(F.col("mcc_code").isin(list(codes)))).alias(name) for name, codes in perks.items()])
    )
