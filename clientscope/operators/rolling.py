"""Rolling month windows over a snapshot history, all windows from one join.

For a target row (client, report month) and a history of snapshots, window ``w`` covers the month ends from
``report_dt - (w - 1)`` months to ``report_dt``. The windows are nested, so one equi join on the client with the
widest range as residual feeds all of them: each window is a conditional aggregate. The join and the grouping
share the client key, so the joined rows are not shuffled again.

Two modes:

``correct``
    true sums and averages; ratios are sum over sum (or average over average); targets without history stay, null.
``compat``
    what joining the history once per window yields: every aggregate sees the product of the row counts of all
    windows. Averages are unaffected; the sum of window w is multiplied by the row counts of the other windows,
    and sum ratios equal average ratios. Targets without a row in the smallest window are absent.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.functions.dates import day, window_start
from clientscope.functions.numbers import safe_ratio

WINDOWS = (3, 6, 9, 12)


def monthly(history: DataFrame, cols: Sequence[str], key: str = "epk", dt: str = "report_dt") -> DataFrame:
    """Sum and row count per client and date. Bounds the history of a client by its number of dates."""
    return history.groupBy(key, dt).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("double").alias(c) for c in cols]
    )


def rolling_windows(
    target: DataFrame,
    history: DataFrame,
    cols: Sequence[str],
    windows: Sequence[int] = WINDOWS,
    aggs: Sequence[str] = ("sum", "avg"),
    ratios: bool = True,
    mode: str = "correct",
    key: str = "epk",
    dt: str = "report_dt",
    unique_history: bool = True,
    ratio_aggs: Sequence[str] | None = None,
    keep_values: bool = True,
    null_as_zero: bool = True,
    prune: bool | tuple[str, str] = True,
) -> DataFrame:
    """Rolling features per target row, named ``<col>_<agg>_<w>m`` and ``<col>_<agg>_<w1>_<w2>``.

    Pass only the columns needed: the history scan is pruned to them. Set ``unique_history=False`` when the
    history may hold several rows per client and date; it is then reduced to one before the join.
    With ``null_as_zero=False`` missing values are left out of averages, as SQL's ``avg`` does.

    With ``prune`` the history is cut to the dates that any target row can reach. The borders are scalar subqueries,
    so nothing is collected, and on a history partitioned by date only those partitions are read. When the first and
    last target date are known pass them instead; ``False`` is for a history that has been cut already.
    """
    if isinstance(prune, tuple):
        history = history.where(F.col(dt).between(window_start(prune[0], max(windows)), day(prune[1])))
    elif prune:
        reach = target.agg(F.min(dt).alias("lo"), F.max(dt).alias("hi"))
        lo = reach.select(window_start(F.col("lo"), max(windows))).scalar()
        history = history.where(F.col(dt).between(lo, reach.select("hi").scalar()))
    if unique_history:
        values = [(F.coalesce(F.col(c), F.lit(0)) if null_as_zero else F.col(c)).cast("double").alias(c) for c in cols]
        hist = history.select(F.col(key), F.col(dt).alias("__dt"), F.lit(1).cast("bigint").alias("__n"), *values)
    else:
        hist = monthly(history, cols, key, dt).withColumnRenamed(dt, "__dt")
    ws = sorted(windows)
    widest = ws[-1]
    t = target.select(key, dt).distinct()
    hist = hist.withColumnRenamed(key, "__k")
    how = "left" if mode == "correct" else "inner"
    joined = t.join(
        hist,
        (F.col(key) == F.col("__k")) & F.col("__dt").between(window_start(F.col(dt), widest), F.col(dt)),
        how,
    )

    def inside(w: int, value: Column) -> Column:
        return value if w == widest else F.when(F.col("__dt") >= window_start(F.col(dt), w), value)

    totals = [F.sum(inside(w, F.col("__n"))).alias(f"__n_{w}") for w in ws]
    totals += [F.sum(inside(w, F.col(c))).alias(f"__s_{c}_{w}") for c in cols for w in ws]
    if not null_as_zero:
        totals += [F.count(inside(w, F.col(c))).alias(f"__c_{c}_{w}") for c in cols for w in ws]
    grouped = joined.groupBy(key, dt).agg(*totals)
    if mode == "compat":
        grouped = grouped.where(F.col(f"__n_{ws[0]}") > 0)

    def n(c: str, w: int) -> Column:
        return F.col(f"__n_{w}") if null_as_zero else F.col(f"__c_{c}_{w}")

    def value(c: str, agg: str, w: int) -> Column:
        s = F.col(f"__s_{c}_{w}")
        if agg == "avg":
            return safe_ratio(s, n(c, w))
        if mode == "compat":
            others = [F.col(f"__n_{v}").cast("double") for v in ws if v != w]
            return s * reduce(mul, others) if others else s
        return s

    out = []
    for c in cols:
        for agg in aggs:
            if keep_values:
                out += [value(c, agg, w).alias(f"{c}_{agg}_{w}m") for w in ws]
            if ratios and (ratio_aggs is None or agg in ratio_aggs):
                # In compat mode the inflation cancels and the ratio of sums is the ratio of averages.
                part = "avg" if mode == "compat" else agg
                out += [
                    safe_ratio(value(c, part, a), value(c, part, b)).alias(f"{c}_{agg}_{a}_{b}")
                    for i, a in enumerate(ws)
                    for b in ws[i + 1 :]
                ]
    return grouped.select(key, dt, *out)
