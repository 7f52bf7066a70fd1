"""Elimination, parameter search and folds on one binned matrix: features are binned once, whatever the number of fits."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientscope.ml.apart import reach
from clientscope.ml.binned import Matrix, build_matrix
from clientscope.ml.boosting import Fit, Params, aucs, finished, grow, start_fit
from clientscope.ml.split import month_folds

# Trials, and the ranges they are drawn from (the ends of a range; a tuple of more is a choice).
TRIALS = 150
SPACE: dict[str, tuple] = {
    "rate": (0.01, 0.2), "depth": (3, 10), "l2": (0.01, 10.0), "columns": (0.01, 1.0), "min_rows": (100, 1000),
    "weights": (None, "balanced", "sqrt"),
}
#: Parameters drawn on a logarithmic scale.
LOGARITHMIC = ("l2",)
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)


def quasi_random(i: int, base: int) -> float:
    """The i-th number of a sequence that fills (0, 1) evenly: the digits of i in a prime base, mirrored."""
    out, share = 0.0, 1.0
    while i:
        share /= base
        out += share * (i % base)
        i //= base
    return out


def drawn(i: int, space: Mapping[str, tuple] = SPACE) -> dict[str, object]:
    """Parameters of trial i; the same on every run."""
    out = {}
    for (name, ends), base in zip(space.items(), PRIMES, strict=False):
        u = quasi_random(i + 1, base)
        if len(ends) != 2 or not all(isinstance(e, (int, float)) for e in ends):
            out[name] = ends[min(int(u * len(ends)), len(ends) - 1)]
        elif name in LOGARITHMIC:
            out[name] = round(math.exp(math.log(ends[0]) + u * (math.log(ends[1]) - math.log(ends[0]))), 6)
        elif all(isinstance(e, int) for e in ends):
            out[name] = ends[0] + min(int(u * (ends[1] - ends[0] + 1)), ends[1] - ends[0])
        else:
            out[name] = round(ends[0] + u * (ends[1] - ends[0]), 6)
    return out


@dataclass(frozen=True)
class Trial:
    """A trial's number, parameters, rounds grown, AUCs, objective, and the rung at which it ended."""

    number: int
    params: dict[str, object]
    rounds: int
    train_auc: float
    val_auc: float
    objective: float
    rung: int


def halving(
    matrix: Matrix,
    trials: int = TRIALS,
    rungs: Sequence[int] = (5, 15, 45, 135),
    keep: float = 1 / 3,
    gap: float = 0.01,
    space: Mapping[str, tuple] = SPACE,
    base: Params = Params(),
    train: Sequence[str] = ("train",),
    val: Sequence[str] = ("val",),
) -> list[Trial]:
    """Successive halving: all trials grow to the first rung's rounds, the best share of them to the next, and so on.

    A trial's objective is its validation AUC, or 0 once its training AUC is more than ``gap`` above; such a trial ends
    there, since more rounds only widen the gap. All trials of a rung grow in the same job over the same matrix.
    Equal objectives go by trial number. Every trial is reported with what it reached.
    """
    fits = {i: start_fit(matrix, replace(base, **drawn(i, space), rounds=max(rungs), patience=max(rungs)), train, val) for i in range(trials)}
    out: dict[int, Trial] = {}
    going = dict(fits)
    for rung, rounds in enumerate(rungs):
        for i, (a, b) in reach(matrix, going, rounds - (rungs[rung - 1] if rung else 0)).items():
            fair = not math.isnan(b) and (math.isnan(a) or a - b <= gap)
            out[i] = Trial(i, drawn(i, space), len(fits[i].trees), a, b, b if fair else 0.0, rung)
        fair = sorted((i for i in going if out[i].objective > 0), key=lambda i: (-out[i].objective, i))
        going = {i: fits[i] for i in sorted(fair[: max(1, math.ceil(keep * len(going)))])}
        if not going:
            break
    return [out[i] for i in range(trials)]


def eliminate(
    matrix: Matrix, params: Params = Params(), cut: float = 0.0, least: int = 1, steps: int | None = None,
    train: Sequence[str] = ("train",), val: Sequence[str] = ("val",),
) -> list[tuple[int, str, float, int]]:
    """Importance cut, then backward elimination: (features, dropped since the step before, validation AUC, rounds) per fit.

    Columns without gain above ``cut`` go after a first fit on all; then the weakest goes, fit after fit, until ``least``
    are left. With ``steps`` so many columns go at a time that it takes about that number of fits. If the cut leaves all
    columns, the first fit is that of the first step.
    """

    def fitted(columns: Sequence[str]):
        fit = start_fit(matrix, params, train, val, columns)
        grow(matrix, {0: fit})
        return finished(matrix, fit)

    first = fitted(matrix.features)
    ranked = first.importances()
    columns = [f for f, gain in ranked if gain > cut] or [ranked[0][0]]
    at_once = 1 if steps is None else max(1, math.ceil((len(columns) - least) / steps))
    out, dropped = [], [f for f in matrix.features if f not in columns]
    while True:
        model = first if len(columns) == len(matrix.features) else fitted(columns)
        ((_, auc),) = aucs(matrix, {0: model.fit}).values()
        out.append((len(columns), ",".join(dropped), auc, model.rounds))
        if len(columns) <= least:
            return out
        order = [f for f, _ in model.importances()]
        dropped = order[max(least, len(order) - at_once) :]
        columns = [f for f in columns if f not in dropped]


def fold_fits(
    df: DataFrame, dates: Sequence, features: Sequence[str], label: str, params: Params = Params(), dt: str = "report_dt", bins: int = 64,
    wrap: Callable[[Matrix], Matrix] = lambda m: m,
) -> list[tuple[str, int, int, float, float, int]]:
    """Month folds grown side by side on one matrix: (fold, training rows, validation rows, AUCs, rounds)."""
    dated = df.where(F.col(dt).isin(list(dates))).withColumn("__part", F.col(dt).cast("string"))
    matrix = wrap(build_matrix(dated, features, label, "__part", None, bins))
    folds = month_folds(list(dates))
    fits: dict[int, Fit] = {i: start_fit(matrix, params, *[[str(d) for d in side] for side in (a, b)]) for i, (_, a, b) in enumerate(folds)}
    grow(matrix, fits)
    models = {i: finished(matrix, f).fit for i, f in fits.items()}
    found = aucs(matrix, models)
    rows = lambda side: sum(matrix.rows(str(d)) for d in side)
    return [(name, rows(a), rows(b), *found[i], len(models[i].trees)) for i, (name, a, b) in enumerate(folds)]
