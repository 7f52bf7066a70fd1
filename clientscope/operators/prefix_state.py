"""Rolling windows as differences of running totals: a state by month, from which any window is two rows.

The state has a row per client and month end from the client's first month on: totals and numbers of rows up to and
including that month. A window of w months that ends at t is the state at t less the state w months before. A new month
is the month before plus the new rows, so it reads one month of state and one of facts; nothing older is touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientscope.functions.dates import shift_month_end
from clientscope.functions.numbers import safe_ratio


def totals(history: DataFrame, cols: Sequence[str], key: str, dt: str) -> DataFrame:
    sums = [F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in cols]
    return history.groupBy(key, F.last_day(F.col(dt)).alias(dt)).agg(F.count(F.lit(1)).alias("rows"), *sums)


def build_state(history: DataFrame, cols: Sequence[str], last: str | Column | None = None, key: str = "epk", dt: str = "report_dt") -> DataFrame:
    """The state of a whole history up to the month end ``last`` (its own last month by default). Once per table; then ``next_month``."""
    months = totals(history, cols, key, dt)
    end = months.agg(F.max(dt)).scalar() if last is None else F.lit(last).cast("date") if isinstance(last, str) else last
    run = W.partitionBy(key).orderBy(dt).rowsBetween(W.unboundedPreceding, 0)
    following = F.lead(dt).over(W.partitionBy(key).orderBy(dt))
    grown = months.where(F.col(dt) <= end).select(key, dt, *[F.sum(c).over(run).alias(c) for c in ("rows", *cols)], following.alias("__next"))
    # A row stands for every month until the client's next one.
    upto = F.coalesce(shift_month_end(F.col("__next"), -1), end)
    every = F.transform(F.sequence(F.trunc(dt, "MM"), F.trunc(upto, "MM"), F.expr("interval 1 month")), lambda m: F.last_day(m))
    return grown.select(key, F.explode(every).alias(dt), "rows", *cols)


def next_month(before: DataFrame, facts: DataFrame, cols: Sequence[str], month: str, key: str = "epk", dt: str = "report_dt") -> DataFrame:
    """The state of ``month`` from that of the month before and the facts of the month alone."""
    new = totals(facts, cols, key, dt).where(F.col(dt) == F.lit(month).cast("date")).drop(dt)
    names = ("rows", *cols)
    both = before.drop(dt).withColumnsRenamed({c: f"__{c}" for c in names}).join(new, key, "full")
    added = [(F.coalesce(f"__{c}", F.lit(0)) + F.coalesce(c, F.lit(0))).alias(c) for c in names]
    return both.select(key, F.lit(month).cast("date").alias(dt), *added)


def with_late_rows(state: DataFrame, late: DataFrame, cols: Sequence[str], key: str = "epk", dt: str = "report_dt") -> DataFrame:
    """The months of the state that late rows reach, with these rows added: write them over the old ones.

    Months before the first late row are neither read nor returned.
    """
    names = ("rows", *cols)
    reach = totals(late, cols, key, dt)
    first = reach.agg(F.min(dt)).scalar()
    months = state.where(F.col(dt) >= first)
    # A late row counts in its own month and in all later ones that the state has.
    known = months.select(dt).distinct()
    spread = reach.withColumnRenamed(dt, "__from").join(F.broadcast(known), F.col("__from") <= F.col(dt))
    spread = spread.groupBy(key, dt).agg(*[F.sum(c).alias(f"__{c}") for c in names])
    both = months.join(spread, [key, dt], "full")
    return both.select(key, dt, *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in names])


def windows(
    target: DataFrame, state: DataFrame, cols: Sequence[str], months: Sequence[int] = (3, 6, 9, 12), aggs: Sequence[str] = ("sum", "avg"),
    ratios: bool = True, key: str = "epk", dt: str = "report_dt",
) -> DataFrame:
    """The features of ``rolling_windows`` from a state: each target row meets its own month and one month per window.

    One equi-join on client and month, whatever the number of windows; only these months of the state are read. Values
    without any row in their window are null. The state must reach the last target month; sums may differ from direct
    ones in the last digits.
    """
    ws = sorted(months)
    t = target.select(key, dt).distinct()
    asked = t.select(key, dt, F.explode(F.array(*[F.struct(F.lit(w).alias("back"), shift_month_end(F.col(dt), -w).alias("at")) for w in (0, *ws)])).alias("__a"))
    asked = asked.select(key, dt, F.col("__a.back").alias("__back"), F.col("__a.at").alias("__at"))
    held = state.withColumnsRenamed({dt: "__at", **{c: f"__v_{c}" for c in ("rows", *cols)}})
    joined = asked.join(held, [key, "__at"], "left")

    def at(c: str, back: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("__back") == back, F.col(f"__v_{c}"))), F.lit(0))

    taken = joined.groupBy(key, dt).agg(*[(at(c, 0) - at(c, w)).alias(f"__{c}_{w}") for c in ("rows", *cols) for w in ws])

    def value(c: str, agg: str, w: int) -> Column:
        n = F.col(f"__rows_{w}")
        total = F.when(n > 0, F.col(f"__{c}_{w}").cast("double"))
        return total if agg == "sum" else safe_ratio(total, n)

    out = []
    for c in cols:
        for agg in aggs:
            out += [value(c, agg, w).alias(f"{c}_{agg}_{w}m") for w in ws]
            if ratios:
                out += [safe_ratio(value(c, agg, a), value(c, agg, b)).alias(f"{c}_{agg}_{a}_{b}") for i, a in enumerate(ws) for b in ws[i + 1 :]]
    return taken.select(key, dt, *out)
