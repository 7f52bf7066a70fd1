"""Softmax boosting on a binned matrix: one joint loss over all classes, one tree of vector leaves a round.

Trees are symmetric: all leaves of a level are split by one feature and border. Each level is one Spark job. A task takes a
group of rows and a share of the fits, and sums gradients by (leaf, bin, class) for each feature; the sums of the groups meet
by (fit, feature), where the best border is found; the driver gets one candidate per fit and feature. Gradients are whole
numbers of 2^-20, so sums are exact in any order and reruns grow the same trees. Many fits (trials, folds) can be grown at
once, by the same jobs. Fits of the same rows, columns and parameters grow one tree between them. Where sums are sent, only
the smaller half of each leaf is added up and sent; the other half is what the sums of the level above leave.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.ml.binned import Matrix, Slab, bin_numbers, to_floats

UNIT = float(1 << 20)
#: Probability levels of the validation metric, and bytes of scores that a worker keeps between jobs.
LEVELS, CACHE_BYTES = 4096, 128 << 20
#: Bytes of sums that a task holds on average; more fits than that take turns.
SUM_BYTES = 64 << 20
#: Bytes of bins in a group of rows at most; additions that make a further group (its sums are sent) or a further task worth it,
#: and rows per cell of the sums below which sending costs more than adding.
GROUP_BYTES, GROUP_WORK, TASK_WORK, ROWS_PER_CELL = 64 << 20, 128_000_000, 16_000_000, 50
#: Tasks that share the columns of few fits if the rows are one group: they run where its rows are kept.
PIECES = 4
#: Trees that are broadcast together; keys of the sums that belong to no column.
LOT, LOSSES, TOTALS = 16, -1, -2
#: Bits of a curvature's and of a gradient's sum in the number that both share.
LOW, HIGH = 31, 32
NO_VALUES = np.zeros(0)


@dataclass(frozen=True)
class Params:
    """Depth, learning rate, L2 of leaf values, share of the features a tree may use, least rows on both sides of a
    leaf's split, class weights (None, balanced or sqrt), largest number of rounds, and rounds without gain to stop at."""

    depth: int = 5
    rate: float = 0.1
    l2: float = 3.0
    columns: float = 1.0
    min_rows: int = 1
    weights: str | None = None
    rounds: int = 1000
    patience: int = 30
    seed: int = 0


@dataclass(frozen=True)
class Tree:
    """(feature, last bin on the left) of each level, and a value per leaf and class; a leaf's number has one bit a level."""

    levels: tuple[tuple[int, int], ...]
    values: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(bins.shape[1], np.int32)
        for feature, last in self.levels:
            out <<= 1
            out |= bins[feature] > last
        return out


@dataclass
class Fit:
    """One model while it grows: the parts that train and validate, columns it may use, trees so far and losses by round."""

    params: Params
    train: tuple[int, ...]
    val: tuple[int, ...]
    columns: tuple[int, ...]
    start: np.ndarray
    weights: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    gains: list[tuple[int, float]] = field(default_factory=list)
    losses: list[tuple[float, float]] = field(default_factory=list)
    best: int = 0
    done: bool = False
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)
    lots: list[Broadcast] = field(default_factory=list, repr=False)

    @property
    def size(self) -> int:
        return len(self.trees)

    def since(self, done: int) -> list[Tree]:
        return self.trees[done:]

    def usable(self) -> list[int]:
        """The columns of the next tree, drawn by hash, the same on every run."""
        n = max(1, round(self.params.columns * len(self.columns)))
        if n >= len(self.columns):
            return list(self.columns)
        rng = np.random.default_rng((self.params.seed, len(self.trees)))
        return sorted(int(c) for c in rng.choice(self.columns, n, replace=False))

    def note_loss(self, train: float, val: float) -> None:
        """Losses of the trees so far; without validation rows the training loss decides."""
        self.losses.append((train, val))
        loss = [v if self.val else t for t, v in self.losses]
        self.best = min(range(len(loss)), key=lambda i: (loss[i], i))
        self.done = self.done or len(self.trees) >= self.params.rounds or len(loss) - 1 - self.best >= self.params.patience


@dataclass(frozen=True)
class Sent:
    """What tasks are told of a fit: its rows and columns, and its trees, the older ones in broadcast lots."""

    uid: str
    params: Params
    train: tuple[int, ...]
    val: tuple[int, ...]
    start: np.ndarray
    weights: np.ndarray
    lots: tuple[Broadcast, ...]
    last: tuple[Tree, ...]

    @property
    def size(self) -> int:
        return len(self.lots) * LOT + len(self.last)

    def since(self, done: int) -> list[Tree]:
        """The trees after the first ``done``; lots that are not wanted are not opened."""
        lots = [t for lot in self.lots[done // LOT :] for t in lot.value]
        return [*lots, *self.last][done - min(done // LOT, len(self.lots)) * LOT :]


def sent(sc: SparkContext, fit: Fit) -> Sent:
    while len(fit.lots) < len(fit.trees) // LOT:
        at = len(fit.lots) * LOT
        fit.lots.append(sc.broadcast(fit.trees[at : at + LOT]))
    return Sent(fit.uid, fit.params, fit.train, fit.val, fit.start, fit.weights, tuple(fit.lots), tuple(fit.trees[len(fit.lots) * LOT :]))


class Scores(OrderedDict):
    """Scores that a worker keeps by (fit, slab), with the number of trees in them; the longest unused go first."""

    held = 0

    def keep(self, key: tuple, done: int, out: np.ndarray) -> None:
        self[key] = (done, out)
        self.held += out.nbytes
        while self.held > CACHE_BYTES and len(self) > 1:
            self.held -= self.popitem(last=False)[1][1].nbytes

    def take(self, key: tuple) -> tuple[int, np.ndarray | None]:
        found = self.pop(key, (0, None))
        self.held -= 0 if found[1] is None else found[1].nbytes
        return found


_scores = Scores()


def raw_scores(fit: Fit | Sent, bins: np.ndarray, key: tuple | None = None) -> np.ndarray:
    """Scores (classes x rows) before the softmax. A worker that has seen the rows adds only the trees since; any other
    one starts anew, so nothing depends on where a task runs."""
    done, out = _scores.take(key) if key else (0, None)
    if out is None or done > fit.size:
        done, out = 0, np.repeat(fit.start[:, None], bins.shape[1], axis=1)
    trees = fit.since(done)
    if trees:
        out = out.copy()
        for tree in trees:
            out += np.take(np.ascontiguousarray(tree.values.T), tree.leaves(bins), axis=1)
    if key:
        _scores.keep(key, fit.size, out)
    return out


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=0))
    return e / e.sum(axis=0)


def among(p: np.ndarray, parts: Sequence[int]) -> np.ndarray:
    """Which rows are of one of the parts."""
    inside = np.zeros(256, bool)
    inside[list(parts)] = True
    return inside[p]


@dataclass(frozen=True)
class Level:
    """What a fit's next job adds up: the splits so far, the columns that may split next, the leaves worth a split, the
    validation parts whose losses are wanted, and of each leaf above the half with fewer rows."""

    splits: tuple[tuple[int, int], ...]
    columns: tuple[int, ...]
    leaves: np.ndarray
    vals: tuple[tuple[int, ...], ...] = ()
    smaller: np.ndarray | None = None


def cell_sums(g: np.ndarray, h: np.ndarray, y: np.ndarray, own: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """Adds gradients, curvatures (classes x rows, whole numbers) and rows up by cell.

    A gradient without its own class's share is at least zero, as a curvature is; so both are added up in one number unless
    a cell has too many rows for that, and the shares are taken off by the rows of each class.
    """
    k = len(own)
    g = g + np.where(np.arange(k)[:, None] == y, own[:, None], 0)
    words, most = (g << LOW) + h, [int(x.max(initial=0)) for x in (g, h)]

    def scattered(values: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
        sums = np.zeros((k, n), np.int64)
        for out, x in zip(sums, values, strict=True):
            np.add.at(out, cells, x)
        return sums

    def added(cells: np.ndarray, n: int) -> np.ndarray:
        rows = np.bincount(cells * k + y, minlength=n * k).reshape(n, k).T
        count = rows.sum(axis=0)
        out = np.empty((2 * k + 1, n), np.int64)
        if most[0] * int(count.max()) < 1 << HIGH and most[1] * int(count.max()) < 1 << LOW:
            sums = scattered(words, cells, n)
            out[:k], out[k : 2 * k] = sums >> LOW, sums & ((1 << LOW) - 1)
        else:
            out[:k], out[k : 2 * k] = scattered(g, cells, n), scattered(h, cells, n)
        out[:k] -= rows * own[:, None]
        out[2 * k] = count
        return out

    return added


def narrow(sums: np.ndarray) -> np.ndarray:
    """The sums in half the bytes, if they fit."""
    return sums.astype(np.int32) if max(-int(sums.min(initial=0)), int(sums.max(initial=0))) < 1 << 31 else sums


def slab_sums(fit: Sent, level: Level, slab: Slab, k: int, width: int) -> dict[int, np.ndarray]:
    """Of one slab: by column, sums over (leaf, bin) of gradient and curvature of each class and of rows, for the leaves of
    the level; at TOTALS those over all leaves, if no column is asked for; at LOSSES the losses of the training rows and of
    each validation, if they are wanted."""
    raw = raw_scores(fit, slab.bins, (fit.uid, slab.key))
    every = 1 << len(level.splits)
    leaf = Tree(level.splits, NO_VALUES).leaves(slab.bins)
    chosen = level.leaves if level.columns else np.arange(every)
    place = np.full(every, -1)
    place[chosen] = np.arange(len(chosen))
    rows = np.flatnonzero(among(slab.p, fit.train) & (place[leaf] >= 0))
    y, at = slab.y[rows], place[leaf[rows]]
    q, w = softmax(np.take(raw, rows, axis=1)), fit.weights[y]
    hot = np.arange(k)[:, None] == y
    g, h = (np.rint(x * w * UNIT).astype(np.int64) for x in (q - hot, q * (1 - q)))
    added = cell_sums(g, h, y, np.rint(fit.weights * UNIT).astype(np.int64))
    if not level.columns:
        return {TOTALS: added(at, every)}
    at = at * width
    out = {c: added(at + np.take(slab.bins[c], rows), len(chosen) * width) for c in level.columns}
    if level.vals:
        sides = [(q, y)]
        for parts in level.vals:
            val = np.flatnonzero(among(slab.p, parts))
            sides.append((softmax(np.take(raw, val, axis=1)), slab.y[val]))
        both = []
        for proba, label in sides:
            own = fit.weights[label]
            both += [np.rint(-np.log(np.maximum(proba[label, np.arange(len(label))], 1e-15)) * own * UNIT).sum(), np.rint(own * UNIT).sum()]
        out[LOSSES] = np.array([both]).astype(np.int64)
    return out


def other_halves(small: np.ndarray, above: np.ndarray, level: Level, parent: Level, width: int) -> np.ndarray:
    """One feature's sums for all leaves of a level, from those of the smaller halves and those of the level above."""
    half, whole = (s.reshape(len(s), -1, width) for s in (small, above))
    half = half[:, np.searchsorted(level.smaller >> 1, level.leaves >> 1)]
    rest = whole[:, np.searchsorted(parent.leaves, level.leaves >> 1)] - half
    return np.where(np.isin(level.leaves, level.smaller)[:, None], half, rest).reshape(len(small), -1)


def best_border(sums: np.ndarray, k: int, width: int, params: Params) -> tuple[float, int, np.ndarray]:
    """Gain and last bin on the left of one feature's best border, and the sums of the left halves and of all by leaf."""
    total = sums.reshape(2 * k + 1, -1, width)
    every, left = total.sum(axis=2), np.cumsum(total, axis=2)[:, :, :-1]

    def score(part: np.ndarray) -> np.ndarray:
        g, h = part[:k] / UNIT, part[k : 2 * k] / UNIT
        return (g * g / (h + params.l2)).sum(axis=0)

    enough = np.minimum(left[-1], every[-1][:, None] - left[-1]) >= params.min_rows
    gain = np.where(enough, score(left) + score(every[:, :, None] - left) - score(every)[:, None], 0.0).sum(axis=0)
    at = int(np.argmax(np.round(gain, 9)))
    return float(gain[at]), at, np.stack([left[:, :, at], every])


def row_work(matrix: Matrix) -> int:
    """Additions that a row costs in a level of one fit, about; scores and gradients count as forty."""
    return len(matrix.features) * (2 * len(matrix.classes) + 1) + 40


def row_groups(matrix: Matrix, fits: Mapping[int, Fit], slots: int) -> int:
    """Groups of rows, each of which meets every fit in a task of its own.

    A group has GROUP_BYTES at most. Where there are fewer fits than tasks that can run at once, rows are dealt out further,
    as long as a group is worth a task and adding it up costs more than sending its sums.
    """
    rows = sum(matrix.counts.values())
    trained = max(sum(n for (p, _), n in matrix.counts.items() if p in f.train) for f in fits.values())
    cells = max(matrix.bins * min(1 << max(0, f.params.depth - 1), max(1, trained // max(2, 2 * f.params.min_rows))) for f in fits.values())
    least = math.ceil(rows * max(1, len(matrix.features)) / GROUP_BYTES)
    return max(1, least, min(math.ceil(slots / len(fits)), rows * row_work(matrix) // GROUP_WORK, rows // (ROWS_PER_CELL * cells)))


def tiles(
    matrix: Matrix, fits: Mapping[int, Fit], units: Sequence[tuple[int, object]], groups: int,
    add_up: Callable[[Sent, tuple[int, object], list[Slab]], Iterator[tuple[tuple[int, int], np.ndarray]]],
) -> RDD:
    """((fit, key), sums) of every group of rows: a task takes one group and a share of the units, one after the other. A unit
    is a fit and what to add up for it."""
    sc = matrix.table.sparkSession.sparkContext
    slots = max(1, sc.defaultParallelism)
    work = sum(matrix.counts.values()) * row_work(matrix) * len(fits)
    shares = min(len(units), math.ceil(2 * slots / groups), math.ceil(work / groups / TASK_WORK)) or 1
    told = {i: sent(sc, f) for i, f in fits.items()}
    order = sorted(units, key=lambda unit: (fits[unit[0]].params.depth, unit[0]))
    slabs = matrix.slabs(groups)
    spread = slabs if shares == 1 else sc.union([slabs] * shares)

    def run(at: int, part: Iterator[Slab]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        held = list(part)
        for unit in order[at // groups :: shares]:
            yield from add_up(told[unit[0]], unit, held)

    return spread.mapPartitionsWithIndex(run)


@dataclass(frozen=True)
class Above:
    """Sums that were sent for the levels of a tree so far, as they lie in the shuffle: (levels by fit, sums of each group)."""

    sent: tuple[tuple[dict[int, Level], RDD], ...] = ()


def pieces(matrix: Matrix, fits: Mapping[int, Fit], levels: Mapping[int, Level], groups: int, slots: int) -> list[tuple[int, Level]]:
    """The levels, each in parts of its columns if that gives idle tasks work; fits of more rows have more parts, and the
    first part has the losses."""
    most = 1 if groups > 1 else max(1, sum(matrix.counts.values()) * row_work(matrix) // TASK_WORK)
    rows = {i: sum(n for (p, _), n in matrix.counts.items() if p in fits[i].train) for i in levels}
    out = []
    for i, level in levels.items():
        n = max(1, min(most, round(min(PIECES, slots) * rows[i] / max(1, sum(rows.values())))))
        size = math.ceil(len(level.columns) / n) or 1
        cut = [level.columns[at : at + size] for at in range(0, len(level.columns), size)] or [()]
        out += [(i, replace(level, columns=columns, vals=() if at else level.vals)) for at, columns in enumerate(cut)]
    return out


def step(matrix: Matrix, fits: Mapping[int, Fit], levels: Mapping[int, Level], above: Above | None = None) -> tuple[dict[int, dict[int, tuple[float, int, np.ndarray]]], Above | None]:
    """One job for all fits: by fit and column the best border, its gain and sums; totals and losses as they are added up.

    If several groups of rows send sums, those of the levels above are read again from the shuffle, and only the smaller
    half of each leaf is added up. ``above`` is what was sent so far, empty for a first level, and None to add all leaves.
    """
    sc = matrix.table.sparkSession.sparkContext
    k, width, slots = len(matrix.classes), matrix.bins, max(1, sc.defaultParallelism)
    params = {i: f.params for i, f in fits.items()}
    groups = row_groups(matrix, fits, slots)
    known = above.sent if above and groups > 1 else ()
    halved = bool(known) and all(level.smaller is not None and i in known[-1][0] for i, level in levels.items())
    chain = [sums for sums, _ in known] if halved else []
    direct = {i: replace(level, leaves=level.smaller) if halved else level for i, level in levels.items()}

    def add_up(fit: Sent, unit: tuple[int, Level], slabs: list[Slab]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        i, level = unit
        total: dict[int, np.ndarray] = {}
        for slab in slabs:
            for c, s in slab_sums(fit, level, slab, k, width).items():
                if c in total:
                    total[c] += s
                else:
                    total[c] = s
        for c in list(total):
            yield (i, c), total.pop(c)

    def border(key: tuple[int, int], sums: np.ndarray) -> tuple[int, int, float, int, np.ndarray]:
        i, c = key
        return (i, c, *((0.0, 0, sums) if c < 0 else best_border(sums, k, width, params[i])))

    def meet(part: Iterator[tuple[tuple[int, int], tuple[int, np.ndarray]]]) -> Iterator[tuple[int, int, float, int, np.ndarray]]:
        held: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for key, (depth, s) in part:
            if key[0] in direct and (key[1] >= 0 or depth == len(chain)):
                one = held.setdefault(key, {})
                if depth in one:
                    one[depth] += s
                else:
                    one[depth] = s.astype(np.int64)
        for key in list(held):
            one = held.pop(key)
            whole = one[0]
            for depth in range(1, len(chain) + 1):
                level = chain[depth][key[0]] if depth < len(chain) else levels[key[0]]
                whole = other_halves(one[depth], whole, level, chain[depth - 1][key[0]], width)
            yield border(key, whole)

    made = tiles(matrix, fits, pieces(matrix, fits, direct, groups, slots), groups, add_up)
    if groups == 1:
        found, below = made.map(lambda item: border(*item)).collect(), None
    else:
        at = len(chain)
        ends = min(slots, 2 * groups)
        dealt = made.mapValues(lambda s: (at, narrow(s))).partitionBy(ends)
        met = dealt
        for _, earlier in known if halved else ():
            met = met.union(earlier)
        found = met.partitionBy(ends).mapPartitions(meet).collect()
        below = Above((*(known if halved else ()), (dict(levels), dealt))) if above else None
    out: dict[int, dict] = {i: {} for i in fits}
    for i, c, *best in found:
        out[i][c] = tuple(best)
    return out, below


def turns(matrix: Matrix, levels: Mapping[int, Level], slots: int) -> Iterator[dict[int, Level]]:
    """The levels' columns in groups whose sums fit into the tasks that add them up."""
    group: dict[int, Level] = {}
    held = 0
    for i, level in levels.items():
        size = max(1, len(level.leaves)) * matrix.bins * (2 * len(matrix.classes) + 1) * 8
        at_once = max(1, SUM_BYTES * slots // size)
        for start in range(0, len(level.columns), at_once):
            columns = level.columns[start : start + at_once]
            if group and (i in group or held + size * len(columns) > SUM_BYTES * slots):
                yield group
                group, held = {}, 0
            group[i] = replace(level, columns=columns)
            held += size * len(columns)
    if group:
        yield group


def next_level(level: Level, best: int, last: int, left: np.ndarray, every: np.ndarray, params: Params, width: int) -> tuple[np.ndarray, Level, bool]:
    """After a split: the sums of the new leaves, what to add up next, and whether the tree goes on."""
    halves = np.zeros((len(every), 2 << len(level.splits)), np.int64)
    halves[:, 2 * level.leaves], halves[:, 2 * level.leaves + 1] = left, every - left
    leaves = np.flatnonzero(halves[-1] >= (2 * params.min_rows if 2 * params.min_rows > width else 1))
    left = np.unique(leaves >> 1) << 1
    level = Level((*level.splits, (best, last)), level.columns, leaves, smaller=left + (halves[-1, left] > halves[-1, left + 1]))
    return halves, level, len(level.splits) < params.depth and halves[-1].max() >= max(2, 2 * params.min_rows)


def grow_round(matrix: Matrix, fits: Mapping[int, Fit]) -> None:
    """One more tree for every fit, level by level; fits that their losses end get none.

    Leaves of too few rows to be split are left out of the sums by bin; their values come from a job at the end. Where that
    would save little, since so few rows take fewer cells than there are bins, they stay in. Fits that have grown the same
    trees (folds that differ in their validation rows alone) get theirs from one of them, and each notes its own losses.
    """
    k, slots = len(matrix.classes), max(1, matrix.table.sparkSession.sparkContext.defaultParallelism)
    rows = {i: sum(n for (p, _), n in matrix.counts.items() if p in f.train) for i, f in fits.items()}
    same: dict[tuple[str, int], list[Fit]] = {}
    teams = {i: same.setdefault((f.uid, f.size), []) for i, f in fits.items()}
    for i, f in fits.items():
        teams[i].append(f)
    teams = {i: team for i, team in teams.items() if team[0] is fits[i]}
    levels = {i: Level((), tuple(team[0].usable()), np.zeros(1, int), tuple(f.val for f in team)) for i, team in teams.items() if team[0].params.depth}
    sums: dict[int, np.ndarray] = {}
    partial: set[int] = set()
    going = dict(levels)
    above: Above | None = Above()
    while going:
        found: dict[int, dict] = {i: {} for i in going}
        at_once = list(turns(matrix, going, slots))
        for turn in at_once:
            candidates_of, above = step(matrix, {i: fits[i] for i in turn}, turn, above if len(at_once) == 1 else None)
            for i, candidates in candidates_of.items():
                found[i].update(candidates)
        above = above or Above()
        for i, candidates in found.items():
            team, level = teams[i], going.pop(i)
            if not level.splits:
                losses = [float(s) / max(1.0, float(w)) for s, w in candidates[LOSSES][2][0].reshape(-1, 2)]
                for fit, val in zip(team, losses[1:], strict=True):
                    fit.note_loss(losses[0], val)
                team[:] = [fit for fit in team if not fit.done]
            borders = {c: x for c, x in candidates.items() if c >= 0}
            best = max(borders, key=lambda c: (round(borders[c][0], 9), -c), default=None)
            if not team or best is None or round(borders[best][0], 9) <= 0:
                for fit in team:
                    fit.done = not level.splits
                continue
            gain, last, (left, every) = borders[best]
            if every[-1].sum() < rows[i]:
                partial.add(i)
            sums[i], levels[i], further = next_level(level, best, last, left, every, team[0].params, matrix.bins)
            for fit in team:
                fit.gains.append((best, gain))
            if further:
                going[i] = levels[i]
    if partial:
        totals, _ = step(matrix, {i: fits[i] for i in partial}, {i: replace(levels[i], columns=()) for i in partial})
        sums |= {i: found[TOTALS][2] for i, found in totals.items()}
    for i, s in sums.items():
        g, h = s[:k] / UNIT, s[k : 2 * k] / UNIT
        tree = Tree(levels[i].splits, (-fits[i].params.rate * g / (h + fits[i].params.l2)).T)
        for fit in teams[i]:
            fit.trees.append(tree)


def start_fit(matrix: Matrix, params: Params, train: Sequence[str] = ("train",), val: Sequence[str] = ("val",), columns: Sequence[str] | None = None) -> Fit:
    """A fit without trees: scores start at the logarithm of the weighted class shares of its training rows. Its name tells
    what decides its trees; which rows validate it decides only when it ends."""
    parts = [tuple(matrix.parts.index(x) for x in side if x in matrix.parts) for side in (train, val)]
    n = np.array([sum(matrix.counts.get((p, y), 0) for p in parts[0]) for y in range(len(matrix.classes))], float)
    power = {None: 0.0, "balanced": 1.0, "sqrt": 0.5}[params.weights]
    weights = np.where(n > 0, (n.max(initial=0) / np.maximum(n, 1)) ** power, 1.0)
    share = np.maximum(n * weights, 1e-3)
    kept = range(len(matrix.features)) if columns is None else [matrix.features.index(c) for c in columns]
    columns_used = tuple(sorted(kept))
    return Fit(params, *parts, columns_used, np.log(share / share.sum()), weights, uid=f"{matrix.uid} {params} {sorted(parts[0])} {columns_used}")


def grow(matrix: Matrix, fits: Mapping[int, Fit], rounds: int | None = None) -> None:
    """Up to so many more rounds for all fits that are not done, in the same jobs."""
    left = rounds
    while left is None or left > 0:
        going = {i: f for i, f in fits.items() if not f.done}
        if not going:
            return
        grow_round(matrix, going)
        left = None if left is None else left - 1


@dataclass(frozen=True)
class Model:
    """A grown model: classes, features, borders, start scores, trees up to the best round, and losses (train, validation) by round."""

    classes: tuple
    features: tuple[str, ...]
    borders: tuple[tuple[float, ...], ...]
    fit: Fit
    losses: tuple[tuple[float, float], ...]

    @property
    def rounds(self) -> int:
        return len(self.fit.trees)

    def importances(self) -> list[tuple[str, float]]:
        """(feature, share of the gain), largest first, of the columns the fit may use."""
        total = dict.fromkeys(self.fit.columns, 0.0)
        for c, gain in self.fit.gains:
            total[c] += gain
        every = sum(total.values()) or 1.0
        return sorted(((self.features[c], g / every) for c, g in total.items()), key=lambda x: (-x[1], x[0]))


def finished(matrix: Matrix, fit: Fit) -> Model:
    """The model of a fit, cut back to its best round."""
    upto = sum(len(t.levels) for t in fit.trees[: fit.best])
    kept = replace(fit, trees=fit.trees[: fit.best], gains=fit.gains[:upto], done=True, uid=uuid.uuid4().hex, lots=[])
    return Model(matrix.classes, matrix.features, matrix.borders, kept, tuple(fit.losses))


def fit_softmax(matrix: Matrix, params: Params = Params(), train: Sequence[str] = ("train",), val: Sequence[str] = ("val",), columns: Sequence[str] | None = None) -> Model:
    """Boosted trees for two or more classes with one joint loss. Rounds end when the validation loss has not improved for
    ``patience`` rounds, and the trees after the best round are left out."""
    fit = start_fit(matrix, params, train, val, columns)
    grow(matrix, {0: fit})
    return finished(matrix, fit)


def predict(model: Model, df: DataFrame, *keep: str) -> DataFrame:
    """keep... and ``proba``, one probability per class in the order of ``model.classes``; missing features are allowed."""
    flat = df.select(*keep, *[F.col(f).cast("double").alias(f"__v{i}") for i, f in enumerate(model.features)])
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.stack([bin_numbers(to_floats(batch.column(f"__v{i}")), b) for i, b in enumerate(model.borders)])
            proba = softmax(raw_scores(model.fit, bins)).T
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(list(proba), pa.list_(pa.float64()))], names=[*keep, "proba"])

    return flat.mapInArrow(run, ", ".join([*kinds, "proba array<double>"]))


def predicted_class(model: Model, proba: str | Column = "proba") -> Column:
    """The class of the greatest probability, the first of equal ones."""
    column = F.col(proba) if isinstance(proba, str) else proba
    return F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position(column, F.array_max(column)).cast("int"))


# --- metrics of many fits at once ----------------------------------------------------------------------------


def level_auc(pos: np.ndarray, neg: np.ndarray) -> float:
    """AUC from counts by score level; equal levels count one half."""
    above = neg.sum() - np.cumsum(neg)
    pairs = float(pos.sum()) * float(neg.sum())
    return 1 - float((pos * (above + neg / 2)).sum()) / pairs if pairs else math.nan


def judged(k: int) -> list[int]:
    """Classes whose AUC counts: the last of two, else each against the rest."""
    return [1] if k == 2 else list(range(k))


def level_counts(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(classes, other or own, level): rows by the level of their probability."""
    out = np.zeros((len(q), 2, LEVELS), np.int64)
    level = np.minimum((q * LEVELS).astype(np.int64), LEVELS - 1)
    for c in judged(len(q)):
        out[c] = np.bincount(np.where(y == c, LEVELS, 0) + level[c], minlength=2 * LEVELS).reshape(2, LEVELS)
    return out


def mean_area(counts: Sequence[np.ndarray]) -> float:
    """Mean AUC of the classes that have rows on both sides."""
    areas = [x for x in (level_auc(own, other) for other, own in counts) if not math.isnan(x)]
    return math.fsum(sorted(areas)) / len(areas) if areas else math.nan


def aucs(matrix: Matrix, fits: Mapping[int, Fit]) -> dict[int, tuple[float, float]]:
    """(train, validation) AUC of each fit in one job: of the last class if there are two, else the mean of one class against
    the rest over the classes that have rows on both sides. Probabilities count in 4096 levels."""
    k = len(matrix.classes)
    groups = row_groups(matrix, fits, max(1, matrix.table.sparkSession.sparkContext.defaultParallelism))

    def add_up(fit: Sent, unit: tuple[int, None], slabs: list[Slab]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        total = np.zeros((k, 2, 2, LEVELS), np.int64)
        for slab in slabs:
            q = softmax(raw_scores(fit, slab.bins, (fit.uid, slab.key)))
            for side, parts in enumerate((fit.train, fit.val)):
                inside = among(slab.p, parts)
                total[:, side] += level_counts(q[:, inside], slab.y[inside])
        for c in judged(k):
            yield (unit[0], c), total[c]

    def area(item: tuple[tuple[int, int], np.ndarray]) -> tuple[int, int, list[float]]:
        (i, c), n = item
        return i, c, [level_auc(side[1], side[0]) for side in n]

    made = tiles(matrix, fits, [(i, None) for i in fits], groups, add_up)
    found = (made if groups == 1 else made.reduceByKey(np.add)).map(area).collect()
    out = {}
    for i in fits:
        sides = [[x[side] for j, _, x in found if j == i and not math.isnan(x[side])] for side in (0, 1)]
        out[i] = tuple(math.fsum(sorted(x)) / len(x) if x else math.nan for x in sides)
    return out
