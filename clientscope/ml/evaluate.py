"""Exact evaluation of scores on the executors: AUC, reports, lift, thresholds. No score list reaches the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.operators.ranking import (
    add_range,
    cumulative_counts,
    global_row_number,
    present,
    ranges_for,
    running_totals,
    score_ranges,
)

# Top shares of the lift table.
SHARES = (0.01, 0.03, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
DIGITS = 9


def roc_auc(df: DataFrame, label: Column, score: str) -> DataFrame:
    """One row: auc, positives, negatives."""
    steps = cumulative_counts(df, score, label)
    return steps.agg(*_auc_parts()).select(_auc_value(), "positives", "negatives")


def _auc_parts() -> list[Column]:
    # A negative below a positive is a correct pair. With fp counting negatives at this score and above, those below
    # are (all negatives - fp); summed over positives this is N * P - sum(pos * fp), and ties give back one half.
    return [
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / 2)).alias("__lost"),
    ]


def _auc_value() -> Column:
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return F.round(1 - F.try_divide(F.col("__lost"), pairs), DIGITS).alias("auc")


def class_steps(df: DataFrame, y: str, scores: dict[object, str], pooled: bool = True) -> DataFrame:
    """Cumulative counts per class: cls, score, pos, neg, tp, fp. ``micro`` pools all (row, class) pairs.

    Scores are counted per (class, value) before anything is ordered.
    """
    shared = score_ranges(df, list(scores.values())).borders
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(str(k)).alias("cls"),
                        F.col(c).cast("double").alias("score"),
                        F.when(F.col(y) == k, 1).otherwise(0).alias("hit"),
                    )
                    for k, c in scores.items()
                ]
            )
        ).alias("r")
    ).select("r.*").where(present("score"))
    counts = long.groupBy("cls", "score").agg(
        F.sum("hit").cast("bigint").alias("pos"), F.sum(1 - F.col("hit")).cast("bigint").alias("neg")
    )
    if pooled:
        micro = counts.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        counts = counts.unionByName(micro.select(F.lit("micro").alias("cls"), "score", "pos", "neg"))
    ranged = add_range(counts, "score", "__range", shared)
    return running_totals(ranged, ["cls"], [F.col("score").desc()], "__range", ["pos", "neg"]).select(
        "cls", "score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp")
    )


def auc_one_vs_rest(df: DataFrame, y: str, scores: dict[object, str]) -> DataFrame:
    """AUC per class, and macro, weighted and micro averages: name, auc, support."""
    per = (
        class_steps(df, y, scores)
        .groupBy("cls")
        .agg(*_auc_parts())
        .select(F.col("cls").alias("name"), _auc_value(), F.col("positives").alias("support"))
    )
    classes = per.where("name <> 'micro'")
    averages = classes.agg(
        F.round(F.avg("auc"), DIGITS).alias("macro"),
        F.round(F.sum(F.col("auc") * F.col("support")) / F.sum("support"), DIGITS).alias("weighted"),
        F.sum("support").alias("support"),
    ).select(
        F.explode(
            F.array(
                F.struct(F.lit("macro").alias("name"), F.col("macro").alias("auc"), "support"),
                F.struct(F.lit("weighted").alias("name"), F.col("weighted").alias("auc"), "support"),
            )
        ).alias("r")
    ).select("r.*")
    return per.unionByName(averages)


def confusion(df: DataFrame, y: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class with macro and weighted averages, from a confusion matrix."""
    cells = matrix.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("y").cast("string").alias("name"),
                    F.when(F.col("y") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("guessed"),
                ),
                F.struct(
                    F.col("predicted").cast("string").alias("name"),
                    F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("guessed"),
                ),
            )
        ).alias("r")
    ).select("r.*")
    zero = F.lit(0.0)
    per = (
        cells.groupBy("name")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed"))
        .withColumn("precision", F.coalesce(F.try_divide("tp", "guessed"), zero))
        .withColumn("recall", F.coalesce(F.try_divide("tp", "support"), zero))
        .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
    )
    measures = ("precision", "recall", "f1")

    def rounded(*cols: Column) -> list[Column]:
        return [F.round(c, DIGITS).alias(n) for c, n in zip(cols, measures)]

    out = per.select("name", *rounded(*[F.col(m) for m in measures]), "support")
    macro = per.agg(*rounded(*[F.avg(m) for m in measures]), F.sum("support").alias("support"))
    weighted = per.agg(
        *rounded(*[F.sum(F.col(m) * F.col("support")) / F.sum("support") for m in measures]), F.sum("support").alias("support")
    )
    return (
        out.unionByName(macro.withColumn("name", F.lit("macro avg")))
        .unionByName(weighted.withColumn("name", F.lit("weighted avg")))
    )


def lift_table(df: DataFrame, label: Column, score: str, key: str, shares: Sequence[float] = SHARES, at_least_one: bool = False) -> DataFrame:
    """Per top share: size, precision, recall, F1, smallest score and lift. Equal scores are ordered by key.

    The rows are ranked once; all shares are conditional aggregates over the ranks.
    """
    scored = df.where(present(score)).select(F.col(key), F.col(score).cast("double").alias(score), F.when(label, 1).otherwise(0).alias("__y"))
    rows = scored.count()
    ranked = global_row_number(scored, score, key, ranges=ranges_for(rows))
    return _lift(ranked, [], score, F.lit(rows), shares, at_least_one)


def _lift(ranked: DataFrame, by: Sequence[str], score: str, n: Column, shares: Sequence[float], at_least_one: bool) -> DataFrame:
    """``n`` is the number of ranked rows of the row's group."""

    def size(p: float) -> Column:
        rows = F.floor(n * F.lit(float(p)))
        return F.greatest(rows, F.lit(1)) if at_least_one else rows

    aggs = [F.sum("__y").alias("__p"), F.count(F.lit(1)).alias("__n")]
    for i, p in enumerate(shares):
        inside = F.col("rank") <= size(p)
        aggs += [
            F.count(F.when(inside, 1)).alias(f"__k{i}"),
            F.coalesce(F.sum(F.when(inside, F.col("__y"))), F.lit(0)).alias(f"__tp{i}"),
            F.min(F.when(inside, F.col(score))).alias(f"__m{i}"),
        ]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(p)).alias("share"), F.col(f"__k{i}").alias("size"), F.col(f"__tp{i}").alias("tp"), F.col(f"__m{i}").alias("min_score")
                )
                for i, p in enumerate(shares)
            ]
        )
    ).alias("r")
    precision, recall = F.try_divide("tp", "size"), F.try_divide("tp", "__p")
    return (
        ranked.groupBy(*by)
        .agg(*aggs)
        .select(*by, "__p", "__n", rows)
        .select(*by, "__p", "__n", "r.*")
        .select(
            *by,
            "share",
            "size",
            F.round(precision, DIGITS).alias("precision"),
            F.round(recall, DIGITS).alias("recall"),
            F.round(F.try_divide(2 * F.col("tp"), F.col("size") + F.col("__p")), DIGITS).alias("f1"),
            "min_score",
            F.round(F.try_divide(precision, F.col("__p") / F.col("__n")), DIGITS).alias("lift"),
        )
    )


def class_lift_table(df: DataFrame, y: str, scores: dict[object, str], key: str, shares: Sequence[float] = SHARES) -> DataFrame:
    """The lift table of every class against the rest; a class has at least one row in every share.

    A row without a class's score is left out of that class alone, and its sizes count the rows that have one.
    """
    sizes = df.agg(*[F.count(F.when(present(c), 1)).alias(f"n{i}") for i, c in enumerate(scores.values())]).first()
    ranges = ranges_for(max(sizes))
    found = score_ranges(df, list(scores.values()), ranges)
    long = df.select(
        key,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(str(k)).alias("cls"), F.col(c).cast("double").alias("score"), F.when(F.col(y) == k, 1).otherwise(0).alias("__y"))
                    for k, c in scores.items()
                ]
            )
        ).alias("r"),
    ).select(key, "r.*").where(present("score"))
    ranked = global_row_number(long, "score", key, by=["cls"], found=found, ranges=ranges)
    n = F.lit(0)
    for k, rows in zip(scores, sizes):
        n = F.when(F.col("cls") == str(k), F.lit(rows)).otherwise(n)
    return _lift(ranked, ["cls"], "score", n, shares, at_least_one=True)


def best_fbeta(df: DataFrame, label: Column, score: str, beta: float = 1.0) -> DataFrame:
    """Threshold with the largest F-beta; all rows with one score fall on the same side. Ties go to the higher score."""
    steps = cumulative_counts(df, score, label)
    total = F.lit(df.where(label & present(score)).count())
    b2 = float(beta) ** 2
    precision = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp"), total), F.lit(0.0))
    fbeta = F.coalesce(F.try_divide((1 + b2) * precision * recall, b2 * precision + recall), F.lit(0.0))
    scored = steps.select(
        "score", F.round(precision, DIGITS).alias("precision"), F.round(recall, DIGITS).alias("recall"), F.round(fbeta, DIGITS).alias("fbeta")
    )
    return scored.agg(F.max_by(F.struct("score", "precision", "recall", "fbeta"), F.struct("fbeta", "score")).alias("b")).select(
        F.col("b.score").alias("threshold"), "b.precision", "b.recall", "b.fbeta", F.lit(float(beta)).alias("beta")
    )


def class_histogram(df: DataFrame, by: str, cols: Sequence[str], low: float, high: float, bins: int) -> DataFrame:
    """Share of each class per bin of every column: feature, class, bin (0 below, bins + 1 above), share."""
    long = df.unpivot(by, list(cols), "feature", "value").where("value is not null")
    binned = long.groupBy("feature", by, F.expr(f"width_bucket(value, {low}D, {high}D, {bins})").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = long.groupBy("feature", by).agg(F.count(F.lit(1)).alias("total"))
    return binned.join(totals, ["feature", by]).select(
        "feature", by, "bin", "n", F.round(F.col("n") / F.col("total"), DIGITS).alias("share")
    )


def class_density(df: DataFrame, by: str, cols: Sequence[str], low: float, high: float, points: int = 101, bandwidth: float | None = None) -> DataFrame:
    """Density of each class along every column: feature, class, point, x, density; a Gaussian kernel over a fixed grid.

    Each value gives its weight to the two grid points beside it in proportion (linear binning), so the rows end in one
    aggregation; the kernel then runs over the grid, whose size does not follow the rows. ``bandwidth`` is that of the
    normal reference rule, deviation times n^(-1/5), for each column and class unless given; it is null where a column
    has one value only, and so is the density. Null and NaN are left out; values beyond the grid count in n alone.
    """
    step = (high - low) / (points - 1)
    long = df.unpivot(by, list(cols), "feature", "value").where(present("value"))
    spread = long.groupBy("feature", by).agg(F.count(F.lit(1)).alias("n"), F.stddev("value").alias("s"))
    width = F.lit(float(bandwidth)) if bandwidth else F.when(F.col("s") > 0, F.col("s") * F.pow("n", F.lit(-0.2)))
    spread = spread.select("feature", by, "n", width.alias("h"))
    inside = long.where(F.col("value").between(low, high)).withColumn("at", (F.col("value") - low) / step)
    left = F.least(F.floor("at").cast("int"), F.lit(points - 2))
    sides = F.explode(F.array(*[F.struct((F.col("left") + k).alias("j"), w.alias("w")) for k, w in ((0, 1 - F.col("at") + F.col("left")), (1, F.col("at") - F.col("left")))]))
    binned = inside.withColumn("left", left).select("feature", by, sides.alias("p")).groupBy("feature", by, F.col("p.j").alias("j")).agg(F.sum("p.w").alias("w"))
    grid = binned.groupBy("feature", by).agg(F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("weights"))
    point = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    # A grid holds ``points`` numbers at most, whatever the rows.
    rows = spread.join(grid, ["feature", by], "left").select("feature", by, "n", "h", F.map_entries("weights").alias("weights"), point)

    def kernel(e: Column) -> Column:
        z = (F.col("point") - e["key"]) * F.lit(step) / F.col("h")
        return e["value"] * F.exp(-z * z / 2)

    total = F.coalesce(F.aggregate("weights", F.lit(0.0), lambda a, e: a + kernel(e)), F.when(F.col("h").isNotNull(), 0.0))
    density = total / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return rows.select("feature", by, "point", F.round(F.lit(low) + F.col("point") * step, DIGITS).alias("x"), F.round(density, 6).alias("density"))


def describe_scores(df: DataFrame, score: str) -> DataFrame:
    """count, mean, std, min, quartiles and max. Quartiles are exact: scores are counted per value, then cumulated.

    Quartiles interpolate between neighbours. Only the rows around the three positions are looked at, so no task
    holds all scores.
    """
    base = df.where(present(score)).select(F.col(score).cast("double").alias("score"))
    facts = base.agg(
        F.count(F.lit(1)).alias("count"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
        F.min("score").alias("min"), F.max("score").alias("max"),
    )
    steps = cumulative_counts(df, score, F.lit(True))
    n = base.count()
    first = F.lit(n) - F.col("tp")  # rows below this score

    def at(position: int) -> Column:
        """Value at a zero-based ascending position."""
        return F.max(F.when((first <= position) & (F.lit(position) < first + F.col("pos")), F.col("score")))

    quartiles = []
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        position = (n - 1) * q
        low, high = at(math.floor(position)), at(math.ceil(position))
        quartiles.append(F.round(low + (high - low) * (position - math.floor(position)), 6).alias(name))
    found = steps.agg(*quartiles).select(F.struct("q25", "q50", "q75").alias("s")).scalar()
    return facts.select(
        "count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", found.alias("q")
    ).select("count", "mean", "std", "min", "q.q25", "q.q50", "q.q75", "max")
