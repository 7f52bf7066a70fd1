"""Periodic runs of words: k-gram seeds on diagonals, extended once each, and texts collapsed to one period of every run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.llm.common import WORD, map_texts, pick

I = np.int64
Run = tuple[int, int, int]
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def paired(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Numbers of the grams (left at i, right at i + shift), by position; 0 where a gram occurs once only.

    ``left`` and ``right`` number grams in the same way. A gram that recurs has recurring parts, so only positions
    that are left in both are looked at, and few of them stay from level to level in ordinary prose.
    """
    out = np.zeros(len(left), I)
    at = np.flatnonzero(left[: len(left) - shift]) if shift < len(left) else np.zeros(0, I)
    at = at[right[at + shift] != 0]
    if len(at):
        _, number, count = np.unique(left[at] << I(32) | right[at + shift], return_inverse=True, return_counts=True)
        again = count[number] > 1
        out[at[again]] = number[again] + 1
    return out


def levels(words: np.ndarray, most: int, min_length: int, powers: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(least lag, first lag beyond, gram numbers) for lags of 1, 2 to 3, 4 to 7 and so on, up to ``most``.

    Two places of a run with lag q agree over max(min_length - q, (powers - 1) * q) words at least; the least of these
    over a level's lags, cut to 3 times its least lag beyond the first levels, is the length of its grams. It exceeds
    every lag of the level, so inside a run of smallest period q the next place of a gram is exactly q words on.
    """
    grams = {1: words}

    def gram(k: int) -> np.ndarray:
        if k not in grams:
            half = 1 << ((k - 1).bit_length() - 1)
            grams[k] = paired(gram(half), gram(k - half), half)
        return grams[k]

    low = 1
    while low <= most:
        sure = min(max(min_length - q, (powers - 1) * q) for q in range(low, 2 * low))
        yield low, 2 * low, gram(min(sure, max(3 * low, 5)))
        low *= 2
        for k in [k for k in grams if k > 1 and 2 * k < low]:
            del grams[k]


def seeds(numbers: np.ndarray, low: int, beyond: int) -> np.ndarray:
    """(lag, place) of gram places whose next place is a lag of the level further on, sorted, without those that follow on another."""
    at = np.flatnonzero(numbers)
    at = at[np.argsort(numbers[at], kind="stable")]
    lag = at[1:] - at[:-1]
    ok = (numbers[at[1:]] == numbers[at[:-1]]) & (lag >= low) & (lag < beyond)
    found = np.stack([lag[ok], at[:-1][ok]], axis=1)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    follows = np.zeros(len(found), bool)
    follows[1:] = (found[1:, 0] == found[:-1, 0]) & (found[1:, 1] == found[:-1, 1] + 1)
    return found[~follows]


def extent(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch [first, end) around ``at`` in which words ``lag`` apart are equal."""
    end, step = at, 64
    while True:
        upto = min(end + step, len(words) - lag)
        differ = np.flatnonzero(words[end:upto] != words[end + lag : upto + lag])
        if len(differ) or upto >= len(words) - lag:
            end = end + int(differ[0]) if len(differ) else max(end, upto)
            break
        end, step = upto, step * 2
    first, step = at, 64
    while True:
        down = max(0, first - step)
        differ = np.flatnonzero(words[down:first] != words[down + lag : first + lag])
        if len(differ) or down == 0:
            return (down + int(differ[-1]) + 1 if len(differ) else 0), end
        first, step = down, step * 2


def runs_of(words: np.ndarray, most: int, min_length: int = 6, powers: int = 4) -> list[Run]:
    """(start, length, period) of all runs in an array of word numbers; ``most`` is the largest period to look for.

    The array may hold several texts if no number occurs in two of them. Every level's seeds are extended along their
    diagonal; ``covered`` has the furthest place that an extension of each lag reached, so no stretch is walked twice.
    """
    out: list[Run] = []
    covered: dict[int, int] = {}
    for low, beyond, numbers in levels(words, most, min_length, powers):
        for lag, at in seeds(numbers, low, beyond).tolist():
            if at < covered.get(lag, 0):
                continue
            first, end = extent(words, at, lag)
            covered[lag] = end
            if end - first + lag >= max(min_length, powers * lag):
                out.append((first, end - first + lag, lag))
    return sorted(out, key=lambda r: (r[0], r[2]))


def slice_runs(texts: list[list[bytes]], min_length: int, powers: int) -> list[list[Run]]:
    """The runs of each text; all texts of a slice go through the levels together, with words numbered text by text."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), I, sum(map(len, texts)))
    sizes = np.array([len(t) for t in texts], I)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts), dtype=I), sizes)
    out: list[list[Run]] = [[] for _ in texts]
    if len(ids):
        _, words = np.unique(owner << I(32) | ids, return_inverse=True)
        for start, length, period in runs_of(words + 1, int(sizes.max()) // powers, min_length, powers):
            out[owner[start]].append((start - int(starts[owner[start]]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that repeat a run's first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(
    docs: DataFrame, *, min_length: int = 6, powers: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length and period, by start, then period) and collapsed_text.

    Words are runs of characters other than ASCII white space, numbered from 0. A run is a stretch of at least
    ``min_length`` words and ``powers`` (3 or more) times its smallest period that no neighbouring word extends. The
    collapsed text has the words that are in no run after its first period, joined by one space.

    A task works on slices of texts bounded in rows and bytes; a longer text is a slice of its own, and takes memory in
    proportion to its length. Time grows with the number of words times the logarithm of the longest period, whatever
    repeats. Null and empty texts have no words, no runs and an empty collapsed text; ids may be null or repeated, and
    further columns are ignored.
    """
    if powers < 3:
        raise ValueError("runs must repeat at least three times")

    def fn(texts: list[bytes | None]) -> dict[str, list]:
        words = [(t or b"").split() for t in texts]
        found = slice_runs(words, min_length, powers)
        return {
            "n_words": [len(w) for w in words],
            "runs": [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found],
            "collapsed_text": [collapsed(w, runs).decode() if runs else b" ".join(w).decode() for w, runs in zip(words, found, strict=True)],
        }

    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, fn, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed_text string")


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exact length / period (ties: least start, then period) and digests of a report of find_runs."""
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.try_element_at("runs", F.lit(1)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.withColumn("best", best)

    def sha(text: Column) -> Column:
        return F.sha2(F.encode(text, "UTF-8"), 256)

    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed_text")).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts with a period planted: with h the crc32 of the decimal id, g = h div 10 and
    h mod 10 = 0, each word i >= a becomes word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8).

    A null id plants nothing.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10).cast("bigint")

    def again(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        # Bound once, since a lambda evaluates what it refers to for every word.
        bound = F.transform(F.array(F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p"))), lambda b: F.transform(
            b["w"], lambda w, i: F.when(i < b["a"], w).otherwise(F.element_at(b["w"], b["a"] + (i - b["a"]) % b["p"] + 1))))
        return F.array_join(bound[0], " ")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    some = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, again(ws)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, some).otherwise(F.col("text")).alias("text"))
