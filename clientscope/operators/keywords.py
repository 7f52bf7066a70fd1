"""Many keyword lists in one pass: an automaton over all words, run once over the distinct texts, labels as bits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.functions.predicates import code_in_ranges, first_match

try:
    from ahocorasick import Automaton
except ImportError:  # an optional package; its absence matters to this module only
    Automaton = None


def word_masks(lists: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """Every lower-cased word with a bit for each list that has it; lists are numbered in order."""
    if len(lists) > 63:
        raise ValueError("a long holds the labels of 63 lists at most")
    out: dict[str, int] = {}
    for k, words in enumerate(lists.values()):
        for w in words:
            if "_" in w or "%" in w or not w:
                raise ValueError(f"wildcards and empty words are for LIKE, not for an automaton: {w!r}")
            out[w.lower()] = out.get(w.lower(), 0) | 1 << k
    return out


def label_bits(df: DataFrame, text: str, lists: Mapping[str, Sequence[str]], out: str = "labels") -> DataFrame:
    """Adds a long with bit k set where the lower-cased text contains a word of list k; 0 for null.

    Distinct texts are found first, with a map-side combine, so a merchant that a third of all rows name is looked at
    once. One automaton of all words reads each text from end to end a single time, however many lists and words there
    are; its bits go back to the rows by an equi-join, which the planner broadcasts where the texts are few.
    """
    if Automaton is None:
        raise ImportError("label_bits needs the package pyahocorasick")
    masks, all_bits = word_masks(lists), (1 << len(lists)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Automaton()
        for w, mask in masks.items():
            found.add_word(w, mask)
        found.make_automaton()
        for batch in batches:
            bits = []
            for t in batch.column("lower").to_pylist():
                mask = 0
                for _, m in found.iter(t) if masks else ():
                    mask |= m
                    if mask == all_bits:
                        break
                bits.append(mask)
            yield pa.RecordBatch.from_arrays([batch.column("__text"), pa.array(bits, pa.int64())], names=["__text", out])

    texts = df.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    labelled = texts.select("__text", F.lower("__text").alias("lower")).mapInArrow(run, f"__text string, `{out}` long")
    joined = df.join(labelled, F.col(text) == F.col("__text"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(out, F.lit(0)).alias(out))


def has_label(bits: str | Column, k: int) -> Column:
    """Whether bit k is set."""
    column = F.col(bits) if isinstance(bits, str) else bits
    return F.shiftright(column, k).bitwiseAND(F.lit(1)) == 1


def code_and_label(code: Column, bits: str | Column, rules: Sequence[dict]) -> Column:
    """``code_and_keyword`` over label bits: the first rule whose codes and list (the one of its place) both hit."""
    return first_match([(r["label"], code_in_ranges(code, r["codes"], r.get("ranges", ())) & (has_label(bits, k) if r.get("words") else F.lit(True))) for k, r in enumerate(rules)])
