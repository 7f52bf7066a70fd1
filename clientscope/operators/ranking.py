"""Global order without a global window.

A window without ``partitionBy`` would move every row to one task. Here the order is cut into ranges whose
borders come from ``approxQuantile`` (one scan, a bounded list of numbers on the driver). Totals per range are
few, so their running sum is cheap; the running sum inside a range is an ordinary partitioned window. The
borders are literals in the plan, so a recomputed partition falls into the same ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_RANGES = 64
ROWS_PER_RANGE = 1_000_000


def present(col: str) -> Column:
    """Neither null nor NaN: a score that is missing in either way has no place in an order."""
    value = F.col(col).cast("double")
    return value.isNotNull() & ~F.isnan(value)


def ranges_for(rows: int) -> int:
    """Ranges of about ROWS_PER_RANGE rows, so that what one task orders does not grow with the data."""
    return max(LEAST_RANGES, -(-rows // ROWS_PER_RANGE))


@dataclass(frozen=True)
class Ranges:
    """Increasing borders, and the values that hold about a range of rows or more on their own."""

    borders: tuple[float, ...]
    heavy: tuple[float, ...]


def score_ranges(df: DataFrame, cols: Sequence[str], ranges: int | None = None) -> Ranges:
    """About equal-sized ranges of the values of one column, or of several columns that are ranked side by side.

    A value that is found at two neighbouring quantiles is heavy; it gets a range of its own. Several columns share
    the borders; they are thinned to about twice the usual number. The number of ranges follows the number of rows.
    Driver data: one number per range and column. Null and NaN are left out.
    """
    ranges = ranges or ranges_for(df.count())
    probabilities = [i / ranges for i in range(1, ranges)]
    found = df.select(*[F.when(present(c), F.col(c).cast("double")).alias(c) for c in cols]).approxQuantile(
        list(cols), probabilities, 1 / (4 * ranges)
    )
    heavy = {a for q in found for a, b in zip(q, q[1:]) if a == b}
    merged = sorted({x for q in found for x in q})
    kept = merged[:: max(1, len(merged) // (2 * ranges))]
    own = {y for v in heavy for y in (v, math.nextafter(v, math.inf))}
    borders = sorted({*kept, *own})
    return Ranges((-math.inf, *borders, math.inf), tuple(sorted(heavy)))


def add_range(df: DataFrame, col: str, out: str, borders: Sequence[float]) -> DataFrame:
    """Adds the range number of ``col`` as an int; higher values get higher numbers."""
    if len(borders) < 3:
        borders = (-math.inf, 0.0, math.inf)
    helper = f"__{out}_value"
    marked = Bucketizer(splits=list(borders), inputCol=helper, outputCol=out).transform(
        df.withColumn(helper, F.col(col).cast("double"))
    )
    return marked.withColumn(out, F.col(out).cast("int")).drop(helper)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    range_col: str,
    sums: Sequence[str],
    descending: bool = True,
) -> DataFrame:
    """Adds ``cum_<s>`` for every column in ``sums``: total of this row and all before it in the order.

    ``df`` holds one row per distinct order value and key. ``range_col`` must be monotone in the order.
    """
    range_order = F.col(range_col).desc() if descending else F.col(range_col).asc()
    per_range = df.groupBy(*keys, range_col).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    # One row per range and key: about a millionth of the rows of df.
    before = W.partitionBy(*keys).orderBy(range_order).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys, range_col, *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums]
    )
    inside = W.partitionBy(*keys, range_col).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        df.select("*", *[F.sum(s).over(inside).alias(f"__i_{s}") for s in sums])
        .join(offsets, [*keys, range_col])
        .select(
            *df.columns, *[(F.col(f"__i_{s}") + F.col(f"__o_{s}")).cast("bigint").alias(f"cum_{s}") for s in sums]
        )
    )


def cumulative_counts(df: DataFrame, score: str, label: Column, ranges: int | None = None) -> DataFrame:
    """One row per distinct score with ``pos``, ``neg`` and their totals at this score and above (``tp``, ``fp``).

    Rows are counted per score before anything is ordered, so a score shared by many rows is one row here.
    """
    borders = score_ranges(df, [score], ranges).borders
    counts = (
        df.where(present(score))
        .groupBy(F.col(score).alias("score"))
        .agg(
            F.sum(F.when(label, 1).otherwise(0)).cast("bigint").alias("pos"),
            F.sum(F.when(label, 0).otherwise(1)).cast("bigint").alias("neg"),
        )
    )
    ranged = add_range(counts, "score", "__range", borders)
    return running_totals(ranged, [], [F.col("score").desc()], "__range", ["pos", "neg"]).select(
        "score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp")
    )


def global_row_number(
    df: DataFrame,
    score: str,
    key: str,
    out: str = "rank",
    by: Sequence[str] = (),
    found: Ranges | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Adds the exact position by ``score`` descending, then unique numeric ``key`` ascending, within ``by``.

    Rows fall into ranges of the score; the rows of a heavy score are split further by ranges of the key. Counts per
    cell are few and give the position at which each cell starts, so the rows are shuffled once, into their cells.
    ``df`` is read three times: pass a table, or a checkpoint of something dear to compute.
    """
    ranges = ranges or ranges_for(df.count())
    found = found or score_ranges(df, [score], ranges)
    marked = add_range(df, score, "__sr", found.borders)
    if found.heavy:
        is_heavy = F.col(score).isin(list(found.heavy))
        keys = score_ranges(df.where(is_heavy), [key], ranges).borders
        marked = add_range(marked, key, "__kr", keys).withColumn("__kr", F.when(is_heavy, F.col("__kr")).otherwise(0))
    else:
        marked = marked.withColumn("__kr", F.lit(0))
    cells = marked.groupBy(*by, "__sr", "__kr").agg(F.count(F.lit(1)).alias("__n"))
    # One row per cell and group: at most the number of ranges, and for each heavy score as many again.
    before = W.partitionBy(*by).orderBy(F.col("__sr").desc(), "__kr").rowsBetween(W.unboundedPreceding, -1)
    start = cells.select(*by, "__sr", "__kr", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    in_cell = W.partitionBy(*by, "__sr", "__kr").orderBy(F.col(score).desc(), key)
    return (
        marked.withColumn("__rn", F.row_number().over(in_cell))
        .join(start, [*by, "__sr", "__kr"])
        .withColumn(out, (F.col("__rn") + F.col("__before")).cast("bigint"))
        .select(*df.columns, out)
    )


def top_share(df: DataFrame, score: str, key: str, share: float) -> DataFrame:
    """The best ``floor(n * share)`` rows by score, ties by key."""
    scored = df.where(present(score))
    rows = scored.count()
    size = int(rows * share)
    return global_row_number(scored, score, key, ranges=ranges_for(rows)).where(F.col("rank") <= size)


def sample_rows(df: DataFrame, n: int, key: str | Column, seed: str = "0") -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by the hash of a unique key: the same rows on every run.

    A sort of the whole table with a limit would bring ``n`` rows to one task. Instead the hash space is cut
    into 65536 equal cells; counts per cell show in which cell the n-th row lies, and only that one is ordered.
    """
    keyed = df.withColumn("__h", F.md5(F.concat_ws("|", key if isinstance(key, Column) else F.col(key), F.lit(seed))))
    celled = keyed.withColumn("__c", F.substring("__h", 1, 4))
    per_cell = celled.groupBy("__c").agg(F.count(F.lit(1)).alias("__n"))
    # At most 65536 rows, one per cell.
    upto = W.orderBy("__c").rowsBetween(W.unboundedPreceding, 0)
    cells = (
        per_cell.select("__c", "__n", F.sum("__n").over(upto).alias("__cum"))
        .where(F.col("__cum") - F.col("__n") < n)
        .select("__c", (F.lit(n) - (F.col("__cum") - F.col("__n"))).alias("__room"), "__n")
    )
    kept = celled.join(F.broadcast(cells), "__c")
    whole = kept.where(F.col("__n") <= F.col("__room"))
    last = (
        kept.where(F.col("__n") > F.col("__room"))
        .withColumn("__rn", F.row_number().over(W.partitionBy("__c").orderBy("__h")))
        .where(F.col("__rn") <= F.col("__room"))
    )
    return whole.select(*df.columns).unionByName(last.select(*df.columns))
