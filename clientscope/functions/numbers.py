"""Null-safe row arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_safe_sum(cols: Sequence[str | Column]) -> Column:
    zero = F.lit(0.0)
    return reduce(add, [F.coalesce(F.col(c) if isinstance(c, str) else c, zero) for c in cols])


def safe_ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b with null (or ``default``) for a zero or null denominator."""
    ratio = F.try_divide(a.cast("double"), b.cast("double"))
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def gap_percent(top: Column, runner_up: Column) -> Column:
    """Distance of the runner-up from the top in percent of the top; null when the top is zero."""
    return F.try_divide((top - runner_up) * F.lit(100.0), top)


def clip_to_null(col: Column, low: float = -1.0, high: float = 1e8) -> Column:
    """Values outside the open range become null; used to mask sentinel fills before averaging."""
    return F.when((col > low) & (col < high), col)


def at_least_two(flags: Sequence[Column]) -> Column:
    """1 when two or more of the 0/1 flags are set."""
    return (reduce(add, flags) >= 2).cast("int")
