"""Weighted category scores and close-race bonuses on one row per client.

A client's categories live in an array of structs, one element per category, so scoring, ranking and bonuses are
row-local: after the one aggregation per client nothing is shuffled or expanded again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.functions.numbers import gap_percent, safe_ratio
from clientscope.functions.predicates import first_match, is_current
from clientscope.plans.catalog import CLOSE_GAP, TAG_CEILING, TAG_STEP, WEIGHTS

# Scores closer than this many digits are ties: the order in which partial sums meet must not decide a winner.
DIGITS = 9


def tag_label(tag: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Label of the group that lists the tag; null for unlisted tags."""
    return first_match([(label, tag.isin(list(codes))) for label, codes in groups])


def tag_counts(tags: DataFrame, label: Column, labels: Sequence[str]) -> DataFrame:
    """Distinct current tags per client and label as a map column ``tag_counts``; clients without any are absent."""
    known = (
        tags.where(is_current()).select("epk", "nsi_id", label.alias("label")).where(F.col("label").isin(list(labels)))
        .groupBy("epk", "label", "nsi_id").agg(F.count(F.lit(1)).alias("n"))
    )
    counts = known.groupBy("epk").agg(*[F.count(F.when(F.col("label") == x, 1)).alias(x) for x in labels])
    return counts.select("epk", F.create_map(*[y for x in labels for y in (F.lit(x), F.col(x))]).alias("tag_counts"))


def count_of(counts: Column, label: Column) -> Column:
    """Number of tags of the label; zero without a map or without the label."""
    return F.coalesce(F.try_element_at(counts, label), F.lit(0)).cast("double")


def weighted_score(label: str, regular: Column, weights: Sequence[float] = WEIGHTS) -> Column:
    """Amount share, count share and regularity of one category of a conditional pivot, weighted."""
    amount, count, steady = weights
    return F.round(
        safe_ratio(F.col(f"{label}_amt"), F.col("all_amt"), 0.0) * amount
        + safe_ratio(F.col(f"{label}_cnt"), F.col("all_cnt"), 0.0) * count
        + regular.cast("double") * steady,
        DIGITS,
    )


def score_array(scores: Mapping[str, Column]) -> Column:
    """Categories best first; equal scores in name order."""
    items = F.array(*[F.struct((-s).alias("neg"), F.lit(c).alias("category")) for c, s in scores.items()])
    return F.transform(
        F.array_sort(items), lambda x: F.struct(x["category"].alias("category"), (-x["neg"]).alias("score"))
    )


def bonus(count: Column, score: Column, step: float = TAG_STEP, ceiling: float = TAG_CEILING) -> Column:
    """A step per matching tag, at most a share of the score."""
    return F.least(count * F.lit(step), score * F.lit(ceiling))


def winner(items: Column, score: str) -> Column:
    """Category with the largest ``score`` field; ties in name order."""
    ordered = F.transform(
        items, lambda x: F.struct((-F.round(x[score], DIGITS)).alias("neg"), x["category"].alias("category"))
    )
    return F.array_min(ordered)["category"]


def is_close(top: Column, second: Column, gap: float = CLOSE_GAP) -> Column:
    """The runner-up is within the gap; false when the top score is zero."""
    return F.coalesce(gap_percent(top, second) < gap, F.lit(False))
