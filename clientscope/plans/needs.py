"""From model needs to products: first match or all matches, one row per product and per situation, top n wide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientscope.functions.dates import in_last_weeks
from clientscope.operators.windows import best_row, rank_in_client, wide_top

TOP = 7


def best_per_product(df: DataFrame, key: str = "epk") -> DataFrame:
    """Best need per client and product."""
    return best_row(
        df, [key, "product"], [F.col("raw_score"), F.col("need_id")], ["need_id", "life_situation", "raw_score"]
    )


def best_per_situation(df: DataFrame, key: str = "epk") -> DataFrame:
    """Best product per client and situation."""
    return best_row(
        df, [key, "life_situation"], [F.col("raw_score"), F.col("product")], ["product", "need_id", "raw_score"]
    )


def product_table(
    spark: SparkSession, rules: Sequence[tuple[str, Sequence[str]]], first_match: bool = False
) -> DataFrame:
    """Rule table (need_id, product). With ``first_match`` a need belongs to the first product that lists it only."""
    rows: list[tuple[str, str]] = []
    seen: set[str] = set()
    for product, needs in rules:
        for need in dict.fromkeys(needs):
            if not (first_match and need in seen):
                rows.append((need, product))
            seen.add(need)
    return F.broadcast(spark.createDataFrame(rows, "need_id string, product string"))  # as long as the rules in code


def recent_needs(
    scores: DataFrame, dictionary: DataFrame, anchor: str, needs: Sequence[str], model_like: str, weeks: int = 2
) -> DataFrame:
    """Best recent score per client and need of the wanted model family: epk, need_id, life_situation, raw_score.

    ``scores``: epk, model_id, raw_score, scoring_dt; ``dictionary``: model_id, need_id, life_situation, model_name.
    """
    wanted = dictionary.where(F.col("model_name").like(model_like) & F.col("need_id").isin(list(needs)))
    recent = scores.where(in_last_weeks(F.col("scoring_dt"), anchor, weeks))
    best = recent.groupBy("epk", "model_id").agg(F.max("raw_score").alias("raw_score"))
    return (
        best.join(wanted.select("model_id", "need_id", "life_situation"), "model_id")
        .groupBy("epk", "need_id", "life_situation")
        .agg(F.max("raw_score").alias("raw_score"))
    )


def product_ranking(
    needs: DataFrame,
    levels: DataFrame,
    rules: DataFrame,
    limits: Mapping[str, tuple[int | None, int | None]],
    top: int = TOP,
) -> DataFrame:
    """Ranked products in long form: epk, approval_level, rank, product, need_id, life_situation, raw_score.

    One row per product, then one per situation, then the level limits, then the rank. ``levels`` has one row per client.
    """
    mapped = needs.join(rules, "need_id")
    best = best_per_situation(best_per_product(mapped)).join(levels.select("epk", "approval_level"), "epk")
    for product, (low, high) in limits.items():
        level = F.col("approval_level")
        allowed = (level >= low if low is not None else F.lit(True)) & (level <= high if high is not None else F.lit(True))
        best = best.where((F.col("product") != product) | allowed)
    ranked = rank_in_client(best, "epk", [F.col("raw_score").desc(), F.col("product")], "rank")
    return ranked.where(F.col("rank") <= top)


def wide_products(ranked: DataFrame, base: DataFrame | None = None, top: int = TOP, plug: str = "plug") -> DataFrame:
    """``top<i>_product``, ``_need_id``, ``_raw_score`` per client; missing ranks hold the plug and score zero."""
    wide = wide_top(ranked, "epk", "rank", top, ["product", "need_id", "raw_score"])
    if base is not None:
        wide = base.select("epk").distinct().join(wide, "epk", "left")
    filled = {f"top{i}_product": plug for i in range(1, top + 1)} | {f"top{i}_raw_score": 0.0 for i in range(1, top + 1)}
    return wide.na.fill(filled)


def situation_table(spark: SparkSession, rules: Sequence[tuple]) -> DataFrame:
    """Rule table with one row per (product, need_id) and its rules as an array in priority order."""
    rows = [
        (product, need, i, low, high, situation, sub)
        for i, (product, low, high, needs, situation, sub) in enumerate(rules)
        for need in needs
    ]
    flat = spark.createDataFrame(
        rows, "product string, need_id string, priority int, low int, high int, situation string, sub_situation string"
    )
    one = F.struct("priority", "low", "high", "situation", "sub_situation")
    return F.broadcast(flat.groupBy("product", "need_id").agg(F.array_sort(F.collect_list(one)).alias("rules")))


def with_situation(ranked: DataFrame, table: DataFrame) -> DataFrame:
    """Situation and sub-situation of every ranked product: the first rule whose level limits hold, else empty.

    The rule table is small and hinted where it is built; the rule is picked inside the row and nothing is shuffled.
    """
    level = F.col("approval_level")
    fits = F.filter(
        "rules", lambda r: F.coalesce(level >= r["low"], F.lit(True)) & F.coalesce(level <= r["high"], F.lit(True))
    )
    found = F.get(fits, F.lit(0))
    return (
        ranked.join(table, ["product", "need_id"], "left")
        .withColumn("situation", F.coalesce(found["situation"], F.lit("")))
        .withColumn("sub_situation", F.coalesce(found["sub_situation"], F.lit("")))
        .drop("rules")
    )


def with_benefit(
    ranked: DataFrame, benefits: DataFrame, rubles: Mapping[str, str], bonuses: Mapping[str, str], levels: int = 6
) -> DataFrame:
    """Benefit of every ranked product on every level: ``benefit_rubles_lvl<n>`` and ``benefit_bonuses_lvl<n>``.

    ``rubles`` and ``bonuses`` map a product to a column template with ``{level}``; the last level repeats the one
    before it. ``benefits`` has one wide row per client; the value is looked up in the row, without unpivoting it.
    """
    joined = ranked.join(benefits, "epk", "left")
    out = []
    for n in range(1, levels + 1):
        source = min(n, levels - 1)
        for kind, columns in (("rubles", rubles), ("bonuses", bonuses)):
            value = F.lit(0.0)
            for product, template in columns.items():
                amount = F.round(F.coalesce(F.col(template.format(level=source)), F.lit(0.0)))
                value = F.when(F.col("product") == product, amount).otherwise(value)
            out.append(value.alias(f"benefit_{kind}_lvl{n}"))
    return joined.select(*ranked.columns, *out)
