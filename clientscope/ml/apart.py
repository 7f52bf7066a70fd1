"""Fits grown apart: where a task can hold all rows, each task grows fits of its own, many rounds and their AUCs in one job.

Trees, losses and AUCs are those of the jobs by level in ``boosting``: the same whole numbers are added up, in other orders.
Scores and gradients of a fit stay in its task, so a round starts from those of the round before, and only the smaller half
of each leaf is added up. Two classes share one addition of a complex number, each with its gradient and curvature in the 53
bits of a half; where a leaf has many rows, two columns are added up as one and each column's sums are margins of the joint ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Row

from clientscope.ml.binned import Matrix
from clientscope.ml.boosting import (
    NO_VALUES,
    UNIT,
    Fit,
    Level,
    Sent,
    Tree,
    among,
    aucs,
    best_border,
    grow,
    judged,
    level_counts,
    mean_area,
    narrow,
    next_level,
    other_halves,
    raw_scores,
    sent,
    softmax,
)

#: Bytes of rows, scores and gradients that a task may hold, and of sums that it keeps for the next level.
HELD_BYTES, KEPT_BYTES = 256 << 20, 128 << 20
#: Bits of a curvature's and of a gradient's sum in one half of a complex number.
LOW, HIGH = 26, 27
#: Class weights from which a row's own numbers might not fit.
MOST_WEIGHT = 64
#: Rows whose scores are worked on at once.
SLAB_ROWS = 4096
#: Rows that are added up for all columns before the next ones, and bytes of sums that they are added to.
BLOCK_ROWS, GROUP_BYTES = 32768, 48 << 20
#: Rows per cell of two columns from which they are added up as one, and rows per bin that are added up before others get cells of their own.
PAIR_ROWS, PIECE_ROWS = 5, 32
#: Tasks per slot at least, if there are as many fits: they differ in their cost, so that short tasks fill the gaps.
TASKS = 4


def row_bytes(matrix: Matrix) -> int:
    """Bytes that a task holds of a row: its bins, scores, gradients and places."""
    return len(matrix.features) + 16 * (len(matrix.classes) + 1) + 16


@dataclass(frozen=True)
class Rows:
    """Class of each row and bins by (feature, row) of some parts."""

    y: np.ndarray
    bins: np.ndarray

    def slabs(self) -> Iterator[slice]:
        for at in range(0, len(self.y), SLAB_ROWS):
            yield slice(at, min(at + SLAB_ROWS, len(self.y)))


def rows_of(blocks: Sequence[Row], parts: Sequence[int], features: int) -> Rows:
    y, bins = [np.zeros(0, np.uint8)], [np.zeros((features, 0), np.uint8)]
    for b in blocks:
        inside = among(np.frombuffer(bytes(b["p"]), np.uint8), parts)
        y.append(np.frombuffer(bytes(b["y"]), np.uint8)[inside])
        bins.append(np.frombuffer(bytes(b["bins"]), np.uint8).reshape(features, -1)[:, inside])
    return Rows(np.concatenate(y), np.concatenate(bins, axis=1))


def all_scores(fit: Fit, rows: Rows) -> np.ndarray:
    return np.concatenate([np.zeros((len(fit.start), 0)), *[raw_scores(fit, rows.bins[:, s]) for s in rows.slabs()]], axis=1)


def add_tree(raw: np.ndarray, tree: Tree, rows: Rows) -> None:
    values = np.ascontiguousarray(tree.values.T)
    for s in rows.slabs():
        raw[:, s] += np.take(values, tree.leaves(rows.bins[:, s]), axis=1)


class Gradients:
    """Gradients and curvatures of rows as whole numbers, ``most`` at the largest: packed, those of two classes in one complex
    number; if weights are too large for that, those of one."""

    def __init__(self, words: np.ndarray, most: tuple[float, float], k: int, packed: bool = True):
        self.words, self.most, self.k, self.packed = words, most, k, packed
        self.loose: np.ndarray | None = None if packed else words

    def take(self, rows: np.ndarray | slice) -> Gradients:
        return Gradients(self.words[:, rows] if isinstance(rows, slice) else np.take(self.words, rows, axis=1), self.most, self.k, self.packed)

    def fit(self, rows: int) -> bool:
        """Whether sums of so many rows keep to their bits."""
        return self.packed and self.most[0] * rows < 1 << HIGH and self.most[1] * rows < 1 << LOW

    def apart(self) -> np.ndarray:
        """Gradient and curvature of each class as the halves of one complex number: for sums of any size."""
        if self.loose is None:
            g, h = unpacked(self.words, self.k)
            self.loose = np.empty(g.shape, complex)
            self.loose.real, self.loose.imag = g >> LOW, h
        return self.loose

    def sums(self, cells: np.ndarray, n: int) -> np.ndarray:
        """By cell: gradients, curvatures (classes each) and rows."""
        count = np.bincount(cells, minlength=n)
        out = np.empty((2 * self.k + 1, n), np.int64)
        if self.fit(int(count.max(initial=0))):
            g, h = unpacked(scattered(self.words, cells, n), self.k)
            np.right_shift(g, LOW, out=out[: self.k])
            out[self.k : -1] = h
        else:
            made = scattered(self.apart(), cells, n)
            out[: self.k], out[self.k : -1] = made.real, made.imag
        out[-1] = count
        return out


def scattered(words: np.ndarray, cells: np.ndarray, n: int, out: np.ndarray | None = None) -> np.ndarray:
    """Complex numbers (words x rows) added up by cell."""
    out = np.zeros((len(words), n), complex) if out is None else out
    for sums, x in zip(out, words, strict=True):
        np.add.at(sums, cells, x)
    return out


def unpacked(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (times 2^LOW) and curvatures by class."""
    g = np.empty((2 * len(words), words.shape[1]), np.int64)
    g[::2], g[1::2] = words.real, words.imag
    g = g[:k]
    h = g & ((1 << LOW) - 1)
    g -= h
    return g, h


class PairSums:
    """Sums over the bins of two columns at once; the margins are taken when bits run out, and at the end."""

    def __init__(self, k: int, width: int):
        self.k, self.width = k, width
        self.acc = np.zeros(((k + 1) // 2, width * width), complex)
        self.count = np.zeros(width * width, np.int64)
        self.made = np.zeros((2, 2 * k + 1, width), np.int64)

    def add(self, grads: Gradients, cells: np.ndarray) -> None:
        count = np.bincount(cells, minlength=len(self.count))
        both = self.count + count
        if grads.fit(int(both.max())):
            self.count = both
        else:
            self.flush()
            if not grads.fit(int(count.max())):
                made = scattered(grads.apart(), cells, len(count))
                self.margins(made.real.astype(np.int64), made.imag.astype(np.int64), count, 0)
                return
            self.count = count
        scattered(grads.words, cells, len(count), self.acc)

    def margins(self, g: np.ndarray, h: np.ndarray, count: np.ndarray, bits: int) -> None:
        for made, axis in zip(self.made, (2, 1), strict=True):
            g1, h1, n1 = (x.reshape(-1, self.width, self.width).sum(axis=axis) for x in (g, h, count))
            made[: self.k] += g1 >> bits
            made[self.k : -1] += h1
            made[-1] += n1[0]

    def flush(self) -> None:
        if self.count.any():
            self.margins(*unpacked(self.acc, self.k), self.count, LOW)
            self.acc[:], self.count = 0, np.zeros_like(self.count)


def started(fit: Fit, rows: Rows, raw: np.ndarray) -> tuple[Gradients, tuple[int, int]]:
    """Gradients of the next tree at all training rows, and the sums of their losses and weights."""
    k, packed = len(fit.start), float(fit.weights.max()) < MOST_WEIGHT
    words = np.zeros(((k + 1) // 2 if packed else k, len(rows.y)), complex)
    most, lost = (0.0, 0.0), (0, 0)
    for s in rows.slabs():
        q, y = softmax(raw[:, s]), rows.y[s]
        w = fit.weights[y]
        g, h = (np.rint(x * w * UNIT) for x in (q - (np.arange(k)[:, None] == y), q * (1 - q)))
        most = (max(most[0], float(np.abs(g).max())), max(most[1], float(h.max())))
        both = g * (1 << LOW) + h
        halves = (both[::2], both[1::2]) if packed else (g, h)
        for side, x in zip((words.real, words.imag), halves, strict=True):
            side[: len(x), s] = x
        lost = tuple(a + b for a, b in zip(lost, losses(q, y, w), strict=True))
    return Gradients(words, most, k, packed), lost


def losses(q: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[int, int]:
    return int(np.rint(-np.log(np.maximum(q[y, np.arange(len(y))], 1e-15)) * w * UNIT).sum()), int(np.rint(w * UNIT).sum())


def column_sums(grads: Gradients, bins: np.ndarray, leaf: np.ndarray, leaves: np.ndarray, columns: Sequence[int], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(column, sums by (leaf, bin)) for these leaves, from blocks of rows that meet all columns while they are in the cache.

    Rows are put in order of their leaves. Those of a large leaf are added up for two columns at once; other leaves are cut
    into pieces that each have cells of their own, so that a cell gets few rows and sums keep to their bits.
    """
    k = grads.k
    place = np.full(1 + int(max(leaf.max(initial=0), leaves.max(initial=0))), -1)
    place[leaves] = np.arange(len(leaves))
    at = place[leaf]
    rows = np.flatnonzero(at >= 0)
    n = np.bincount(at[rows], minlength=len(leaves))
    if len(leaves) > 1:
        rows = rows[np.argsort(at[rows].astype(np.uint16 if len(leaves) < 1 << 16 else np.int64), kind="stable")]
    ends = np.cumsum(n)
    large = np.flatnonzero(n >= PAIR_ROWS * width * width).tolist() if len(columns) > 1 else []
    whole = len(leaves) == 1 and len(rows) == len(leaf)
    blocks = small_blocks(np.delete(np.arange(len(leaves)), large), ends - n, ends, PIECE_ROWS * width)
    size = max(len(leaves) * width * (2 * k + 1) * 8, width * width * 8 * k if large else 0)
    at_once = 2 * max(1, GROUP_BYTES // size // 2)
    for first in range(0, len(columns), at_once):
        group = columns[first : first + at_once]
        out = np.zeros((len(group), 2 * k + 1, len(leaves), width), np.int64)
        for i in large:
            pairs = [(a, (*group[a : a + 2], columns[0])[:2], PairSums(k, width)) for a in range(0, len(group), 2)]
            for start in range(int(ends[i] - n[i]), int(ends[i]), BLOCK_ROWS):
                here = slice(start, min(start + BLOCK_ROWS, int(ends[i])))
                here = here if whole else rows[here]
                own = grads.take(here)
                for _, (one, other), sums in pairs:
                    cells = bins_of(bins, one, here).astype(np.int64)
                    cells *= width
                    cells += bins_of(bins, other, here)
                    sums.add(own, cells)
            for a, _, sums in pairs:
                sums.flush()
                out[a : a + 2, :, i] = sums.made[: len(group) - a]
        for start, end, pieces, cuts in blocks:
            here = slice(start, end) if whole else rows[start:end]
            own = grads.take(here)
            base = np.repeat(np.arange(len(cuts)) * width, np.diff([*cuts, end]))
            heads = np.flatnonzero(np.diff(pieces, prepend=-1))
            for o, c in zip(out, group, strict=True):
                sums = own.sums(base + bins_of(bins, c, here), len(cuts) * width).reshape(-1, len(cuts), width)
                o[:, pieces[heads]] += sums if len(heads) == len(cuts) else np.add.reduceat(sums, heads, axis=1)
        for o, c in zip(out, group, strict=True):
            yield c, o.reshape(len(o), -1)


def bins_of(bins: np.ndarray, column: int, rows: np.ndarray | slice) -> np.ndarray:
    return bins[column, rows] if isinstance(rows, slice) else np.take(bins[column], rows)


def small_blocks(leaves: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: int) -> list[tuple[int, int, np.ndarray, list[int]]]:
    """(start, end, leaf of each piece, start of each piece): pieces of so many rows at most, neighbours in blocks."""
    blocks: list[tuple[int, int, list[int], list[int]]] = []
    for i in leaves.tolist():
        for start in range(int(starts[i]), int(ends[i]), rows):
            end = min(start + rows, int(ends[i]))
            if not blocks or blocks[-1][1] != start or end - blocks[-1][0] > BLOCK_ROWS:
                blocks.append((start, end, [i], [start]))
            else:
                first, _, pieces, cuts = blocks[-1]
                blocks[-1] = (first, end, [*pieces, i], [*cuts, start])
    return [(start, end, np.array(pieces), cuts) for start, end, pieces, cuts in blocks]


def grown_tree(fit: Fit, rows: Rows, grads: Gradients, width: int) -> Tree | None:
    """The next tree of a fit, or None if nothing can be split; its gains are noted."""
    k, params, n = len(fit.start), fit.params, len(rows.y)
    level, leaf = Level((), tuple(fit.usable()), np.zeros(1, int)), np.zeros(n, np.int32)
    parent: Level | None = None
    above: dict[int, np.ndarray] | None = None
    sums, partial = None, False
    while level is not None:
        halved = parent is not None and above is not None
        kept: dict[int, np.ndarray] | None = {} if len(level.splits) + 1 < params.depth else None
        size, borders = 0, {}
        for c, s in column_sums(grads, rows.bins, leaf, level.smaller if halved else level.leaves, level.columns, width):
            if halved:
                s = other_halves(s, above[c].astype(np.int64), level, parent, width)
            borders[c] = best_border(s, k, width, params)
            if kept is not None:
                kept[c] = narrow(s)
                size += kept[c].nbytes
                kept = kept if size <= KEPT_BYTES else None
        best = max(borders, key=lambda c: (round(borders[c][0], 9), -c), default=None)
        if best is None or round(borders[best][0], 9) <= 0:
            break
        gain, last, (left, every) = borders[best]
        partial = partial or every[-1].sum() < n
        fit.gains.append((best, gain))
        parent, above = level, kept
        sums, level, further = next_level(level, best, last, left, every, params, width)
        leaf <<= 1
        leaf |= rows.bins[best] > last
        splits = level.splits
        level = level if further else None
    if sums is None:
        return None
    if partial:
        sums = np.zeros_like(sums)
        for s in (slice(at, at + BLOCK_ROWS) for at in range(0, n, BLOCK_ROWS)):
            sums += grads.take(s).sums(leaf[s], sums.shape[1])
    g, h = sums[:k] / UNIT, sums[k : 2 * k] / UNIT
    return Tree(splits, (-params.rate * g / (h + params.l2)).T)


def grow_here(fit: Fit, rounds: int, train: Rows, val: Rows, width: int) -> tuple[float, float]:
    """Up to so many more rounds of one fit; its AUCs of the training and the validation rows after them."""
    raw = [all_scores(fit, train), all_scores(fit, val)]
    for _ in range(rounds if fit.params.depth else 0):
        if fit.done:
            break
        grads, lost = started(fit, train, raw[0])
        found = [lost, (0, 0)]
        for s in val.slabs():
            y = val.y[s]
            found[1] = tuple(a + b for a, b in zip(found[1], losses(softmax(raw[1][:, s]), y, fit.weights[y]), strict=True))
        fit.note_loss(*[float(a) / max(1.0, float(w)) for a, w in found])
        tree = None if fit.done else grown_tree(fit, train, grads, width)
        if tree is None:
            fit.done = True
            break
        fit.trees.append(tree)
        for scores, rows in zip(raw, (train, val), strict=True):
            add_tree(scores, tree, rows)
    k = len(fit.start)
    areas = []
    for scores, rows in zip(raw, (train, val), strict=True):
        counts = sum((level_counts(softmax(scores[:, s]), rows.y[s]) for s in rows.slabs()), np.zeros(1, np.int64))
        areas.append(mean_area([counts[c] for c in judged(k)]) if counts.ndim > 1 else math.nan)
    return areas[0], areas[1]


def reach(matrix: Matrix, fits: Mapping[int, Fit], rounds: int) -> dict[int, tuple[float, float]]:
    """Up to so many more rounds for all fits that are not done, then (train, validation) AUC of each.

    One job, if a task can hold all rows: it reads them from the blocks and takes a share of the fits, one after the other.
    Otherwise the fits grow level by level over groups of rows.
    """
    if sum(matrix.counts.values()) * row_bytes(matrix) > HELD_BYTES:
        grow(matrix, fits, rounds)
        return aucs(matrix, fits)
    sc = matrix.table.sparkSession.sparkContext
    width, features = matrix.bins, len(matrix.features)
    told = {i: (sent(sc, f), f.columns, tuple(f.losses), f.best, f.done) for i, f in fits.items()}
    cost = {i: len(f.usable()) * (f.params.depth + 1) + (1 << f.params.depth) / 8 for i, f in fits.items()}
    order = sorted(fits, key=lambda i: (-cost[i], i))
    shares = math.ceil(len(order) / max(1, len(order) // (TASKS * max(1, sc.defaultParallelism)))) or 1

    def run(at: int, part: Iterator[Row]) -> Iterator[tuple]:
        mine = [told[i] for i in order[at::shares]]
        blocks: list[Row] | None = list(part)
        sides = {parts: rows_of(blocks, parts, features) for fit, *_ in mine for parts in (fit.train, fit.val)}
        blocks = None
        for i in order[at::shares]:
            fit, columns, lost, best, done = told[i]
            here = Fit(fit.params, fit.train, fit.val, columns, fit.start, fit.weights, fit.since(0), losses=list(lost), best=best, done=done)
            found = grow_here(here, rounds, sides[fit.train], sides[fit.val], width)
            yield i, here.trees[fit.size :], here.gains, here.losses[len(lost) :], here.best, here.done, found

    rows = matrix.table.select("y", "p", "bins").coalesce(1).rdd
    out = {}
    for i, trees, gains, lost, best, done, found in (rows if shares == 1 else sc.union([rows] * shares)).mapPartitionsWithIndex(run).collect():
        f = fits[i]
        f.trees += trees
        f.gains += gains
        f.losses += lost
        f.best, f.done = best, done
        out[i] = found
    return {i: out[i] for i in fits}
