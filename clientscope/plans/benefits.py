"""Potential benefit per client and level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.functions.dates import day
from clientscope.functions.numbers import null_safe_sum

LEVELS = 6


def rollup_columns(kinds: Mapping[str, Sequence[str]], levels: int = LEVELS, first_level: Mapping[str, int] | None = None) -> list[Column]:
    """``sum_benefit_<kind>_lvl<n>`` from column templates with ``{level}``; the last level repeats the one before.

    ``first_level`` names templates that exist only from a level on.
    """
    first_level = first_level or {}
    out = []
    for n in range(1, levels + 1):
        source = min(n, levels - 1)
        for kind, templates in kinds.items():
            cols = [t.format(level=source) for t in templates if source >= first_level.get(t, 1)]
            out.append(F.round(F.sum(null_safe_sum(cols))).alias(f"sum_benefit_{kind}_lvl{n}"))
    return out


def benefit_rollup(
    clients: DataFrame,
    benefits: DataFrame,
    report_dt: str,
    kinds: Mapping[str, Sequence[str]],
    levels: int = LEVELS,
    first_level: Mapping[str, int] | None = None,
) -> DataFrame:
    """All clients with their rounded benefit sums; null where a living client has no row at the report date.

    Benefits are summed per client first; the clients are joined to one row each.
    """
    sums = (
        benefits.where((F.col("report_dt") == day(report_dt)) & (F.col("death_flag") == 0))
        .groupBy("epk")
        .agg(*rollup_columns(kinds, levels, first_level))
    )
    return clients.join(sums, "epk", "left")
