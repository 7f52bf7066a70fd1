"""Life situation and sub-situation per client from two spending sources, tags and model scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.functions.dates import day, month_end_bucket, shift_month_end
from clientscope.functions.predicates import any_of, code_and_keyword
from clientscope.operators.aggregate import active_month_flags, conditional_pivot, regular
from clientscope.plans import catalog
from clientscope.plans import scoring as s

# Placeholders of the minimum activity, to be set by the caller: (count, amount) per gated sphere.
MINIMUM = {"sport": (3, 10_000.0), "health": (2, 5_000.0), "trips": (2, 20_000.0), "entertainmentAndHobbies": (3, 10_000.0)}


def both_sources(pos: DataFrame, acquiring: DataFrame, anchor: str, paid: str = "PAID") -> DataFrame:
    """Card transactions and paid acquiring transactions since the month end three months back, one schema."""
    cols = ["epk", "amt", "mcc_code", "merchant", "dt"]
    in_range = F.col("dt").between(shift_month_end(anchor, -3), day(anchor)) & F.col("mcc_code").isNotNull()
    return (
        pos.where(in_range).select(*cols, F.lit("pos").alias("src"))
        .unionByName(acquiring.where(in_range & (F.col("status") == paid)).select(*cols, F.lit("acquiring").alias("src")))
    )


def sphere_spend(tx: DataFrame, anchor: str, rules: Sequence[dict] = catalog.SPHERES) -> DataFrame:
    """One row per client: count, amount and monthly activity per sphere, and totals. Unclassified rows are dropped.

    The day on which the scan starts lies in no month bucket, so it counts in totals only.
    """
    labels = [r["label"] for r in rules]
    rows = tx.withColumn("sphere", code_and_keyword(F.col("mcc_code"), F.col("merchant"), rules)).where("sphere is not null")
    bucket = F.coalesce(month_end_bucket(F.col("dt"), anchor), F.lit(0))
    activity = [f for x in labels for f in active_month_flags(bucket, F.col("amt"), x, condition=F.col("sphere") == x)]
    return conditional_pivot(rows, ["epk"], "sphere", labels, "amt", activity)


def has_minimum(limits: Mapping[str, tuple[float, float]], both: Sequence[str] = ("health",)) -> Column:
    """Some gated sphere reaches its count or amount; spheres in ``both`` need the two together."""

    def reached(x: str) -> Column:
        n, amount = limits[x]
        count, total = F.coalesce(F.col(f"{x}_cnt"), F.lit(0)) >= n, F.coalesce(F.col(f"{x}_amt"), F.lit(0.0)) >= amount
        return (count & total) if x in both else (count | total)

    return any_of(reached(x) for x in limits)


def propensity(scores: DataFrame, base: DataFrame | None, start: Column, end: Column, floor: float = catalog.PROPENSITY_FLOOR,
               label: Column | None = None, labels: Sequence[str] = ()) -> DataFrame:
    """Largest model score per client of at least ``floor`` in the period; per label as a map when labels are given.

    ``scores``: epk, raw_score, scoring_dt (and what ``label`` reads). With ``base`` every base client is returned,
    zero where there is no score.
    """
    rows = scores.where(F.col("scoring_dt").between(start, end) & (F.col("raw_score") >= floor))
    if label is None:
        best = rows.groupBy("epk").agg(F.max("raw_score").alias("propensity"))
    else:
        marked = rows.withColumn("__l", label)
        best = marked.groupBy("epk").agg(
            F.max("raw_score").alias("propensity"),
            *[F.max(F.when(F.col("__l") == x, F.col("raw_score"))).alias(f"__p_{x}") for x in labels],
        )
        pairs = [y for x in labels for y in (F.lit(x), F.coalesce(F.col(f"__p_{x}"), F.lit(0.0)))]
        best = best.select("epk", "propensity", F.create_map(*pairs).alias("propensity_by"))
    if base is None:
        return best
    out = base.select("epk").distinct().join(best, "epk", "left")
    return out.withColumn("propensity", F.coalesce("propensity", F.lit(0.0)))


def situation(
    spend: DataFrame,
    tags: DataFrame,
    scores: DataFrame,
    labels: Sequence[str],
    tag_sphere: Column,
    minimum: Mapping[str, tuple[float, float]] = MINIMUM,
    gated: Sequence[str] = catalog.GATED_SPHERES,
    mode: str = "correct",
) -> DataFrame:
    """Winning sphere per client.

    Only the two best spheres compete. When they are close the tag bonus is added; when they still are, a tenth of
    the propensity: that of the sphere itself, or with ``mode='compat'`` one value per client for both, which cannot
    change the winner. ``scores`` is the output of :func:`propensity` with labels.
    """
    ranked = s.score_array({x: s.weighted_score(x, regular(x)) for x in labels})
    scored = spend.select("epk", F.slice(ranked, 1, 2).alias("two"), has_minimum(minimum).alias("eligible"))
    joined = scored.join(s.tag_counts(tags, tag_sphere, labels), "epk", "left").join(scores, "epk", "left")

    def with_tags(x: Column) -> Column:
        tag = s.bonus(s.count_of(F.col("tag_counts"), x["category"]), x["score"])
        own = F.col("propensity") if mode == "compat" else F.try_element_at(F.col("propensity_by"), x["category"])
        return F.struct(
            x["category"].alias("category"),
            x["score"].alias("score"),
            tag.alias("tag"),
            (F.coalesce(own, F.lit(0.0)) * catalog.PROPENSITY_WEIGHT).alias("prop"),
        )

    a, b = F.col("two")[0], F.col("two")[1]
    bonused = joined.withColumn("two", F.transform("two", with_tags))
    first, last = a["score"] + a["tag"], b["score"] + b["tag"]
    close = s.is_close(a["score"], b["score"])
    still = close & F.coalesce(F.try_divide(F.abs(first - last) * 100, first) < catalog.CLOSE_GAP, F.lit(False))
    final = F.transform(
        "two",
        lambda x: F.struct(
            x["category"].alias("category"),
            (
                x["score"]
                + F.when(F.col("close"), x["tag"]).otherwise(0.0)
                + F.when(F.col("still"), x["prop"]).otherwise(0.0)
            ).alias("final"),
        ),
    )
    won = bonused.withColumns({"close": close, "still": still}).select(
        "epk", "eligible", s.winner(final, "final").alias("sphere")
    )
    label = F.when(F.col("sphere").isin(list(gated)) & ~F.col("eligible"), "general").otherwise(F.col("sphere"))
    return won.select("epk", label.alias("lifestyle_situation"))


def attach_situation(base: DataFrame, found: DataFrame) -> DataFrame:
    """Every base client; ``general`` where nothing was found."""
    return base.join(found, "epk", "left").withColumn(
        "lifestyle_situation", F.coalesce("lifestyle_situation", F.lit("general"))
    )


def sub_situation(
    clients: DataFrame,
    tx: DataFrame,
    tags: DataFrame,
    scores: DataFrame,
    tag_sub: Column,
    rules: Sequence[dict] = catalog.SUB_SITUATIONS,
    codes: Sequence[str] | None = catalog.SUB_CODES,
    flat: Sequence[str] = catalog.FLAT_SITUATIONS,
) -> DataFrame:
    """Sub-situation per client within the situation already found.

    ``clients``: epk, lifestyle_situation. Shares are taken of all classified spending of the client; only
    sub-situations of the client's own situation compete, and of these the best two get bonuses when they are close.
    """
    labels = [r["label"] for r in rules]
    if codes is not None:
        tx = tx.where(F.col("mcc_code").isin(list(codes)))
    rows = tx.withColumn("sub", code_and_keyword(F.col("mcc_code"), F.col("merchant"), rules)).where("sub is not null")
    spend = conditional_pivot(rows, ["epk"], "sub", labels, "amt")
    own = F.col("lifestyle_situation")
    candidates = F.array_compact(
        F.array(
            *[
                F.when(
                    (own == r["sphere"]) & (F.col(f"{r['label']}_cnt") > 0),
                    F.struct((-s.weighted_score(r["label"], F.lit(0))).alias("neg"), F.lit(r["label"]).alias("category")),
                )
                for r in rules
            ]
        )
    )
    ranked = F.transform(
        F.slice(F.array_sort(candidates), 1, 2),
        lambda x: F.struct(x["category"].alias("category"), (-x["neg"]).alias("score")),
    )
    joined = (
        clients.select("epk", "lifestyle_situation")
        .join(spend, "epk", "left")
        .select("epk", "lifestyle_situation", ranked.alias("two"))
        .join(s.tag_counts(tags, tag_sub, labels), "epk", "left")
        .join(scores.select("epk", "propensity"), "epk", "left")
    )
    close = s.is_close(F.get("two", F.lit(0))["score"], F.coalesce(F.get("two", F.lit(1))["score"], F.lit(0.0)))
    final = F.transform(
        "two",
        lambda x: F.struct(
            x["category"].alias("category"),
            (
                x["score"]
                + F.when(F.col("close"), s.bonus(s.count_of(F.col("tag_counts"), x["category"]), x["score"])).otherwise(0.0)
                + F.when(F.col("close"), F.coalesce("propensity", F.lit(0.0)) * catalog.PROPENSITY_WEIGHT).otherwise(0.0)
            ).alias("final"),
        ),
    )
    return joined.withColumn("close", close).select(
        "epk",
        "lifestyle_situation",
        F.when(own.isin(list(flat)), "")
        .otherwise(F.coalesce(s.winner(final, "final"), F.lit("general")))
        .alias("lifestyle_sub_situation"),
    )
