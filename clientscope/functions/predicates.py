"""Predicates and rule lists. Rules are data; one ``when`` chain is built from them and evaluated once per row."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def like_any(col: Column, words: Sequence[str]) -> Column:
    """True where the lower-cased text contains any word; ``_`` in a word stands for one character, as in LIKE."""
    pattern = "|".join(re.escape(w.lower()).replace("_", ".") for w in words)
    return F.lower(col).rlike(pattern)


def first_match(rules: Sequence[tuple[object, Column]], default: object = None) -> Column:
    """``rules`` are (label, condition) in priority order; the first true condition gives the label."""
    (label, condition), *rest = rules
    chain = F.when(condition, F.lit(label))
    for label, condition in rest:
        chain = chain.when(condition, F.lit(label))
    return chain if default is None else chain.otherwise(F.lit(default))


def code_in_ranges(col: Column, codes: Sequence[str], ranges: Sequence[tuple[str, str]] = ()) -> Column:
    """String code in a list, or in a lexicographic range."""
    return any_of([col.isin(list(codes)), *(col.between(lo, hi) for lo, hi in ranges)])


def code_and_keyword(code: Column, text: Column, rules: Sequence[dict]) -> Column:
    """First rule whose code list and keyword list both hit; null where none does.

    A rule is ``{"label", "codes", "ranges"?, "words"?}``.
    """
    chain = []
    for r in rules:
        hit = code_in_ranges(code, r["codes"], r.get("ranges", ()))
        if r.get("words"):
            hit = hit & like_any(text, r["words"])
        chain.append((r["label"], hit))
    return first_match(chain)


def is_current(valid_to: str | Column = "row_actual_to_dt", deleted: str | Column = "is_deleted") -> Column:
    """Open, undeleted rows of a slowly changing table."""
    to = F.col(valid_to) if isinstance(valid_to, str) else valid_to
    dead = F.col(deleted) if isinstance(deleted, str) else deleted
    return (to == F.lit(OPEN_END)) & (dead == 0)


def zero_or_null(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0)) == 0


def none_of_counts(cols: Sequence[str]) -> Column:
    """Every counter is zero or null."""
    return all_of(zero_or_null(c) for c in cols)


def some_of_counts(cols: Sequence[str], strict: bool = True) -> Column:
    """Some counter is above zero; ``strict=False`` accepts any counter that is merely present."""
    return any_of((F.coalesce(F.col(c), F.lit(0)) > 0) if strict else F.col(c).isNotNull() for c in cols)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)
