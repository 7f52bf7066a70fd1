"""Softmax boosting on the binned matrix against a plain learner, early stopping, search, elimination and folds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientscope.ml import apart
from clientscope.ml import boosting as b
from clientscope.ml import search as s
from clientscope.ml.binned import bin_numbers, borders, build_matrix
from clientscope.ml.split import assign_parts

NAMES = ["a", "b", "c"]


def frame(spark, n=240, classes=3, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(4))]
        y = int(x[0] > 0) + int(x[0] + x[1] > 0.6 and classes > 2)
        y = rng.randrange(classes) if rng.random() < 0.1 else y
        x = [None if rng.random() < 0.05 else v for v in x]
        rows.append((i, *x, y))
    return assign_parts(spark.createDataFrame(rows, "epk long, a double, b double, c double, target int"), "epk")


def plain_learner(matrix, rows, params, rounds):
    """The same boosting over Python lists: every split of every column by direct sums."""
    k = len(matrix.classes)
    train = [r for r in rows if r["part"] == "train"]
    share = np.array([max(1e-3, sum(r["y"] == c for r in train)) for c in range(k)], float)
    raw = {r["epk"]: np.log(share / share.sum()) for r in rows}
    trees, losses = [], []

    def proba(r):
        e = np.exp(raw[r["epk"]] - raw[r["epk"]].max())
        return e / e.sum()

    for _ in range(rounds):
        losses.append([np.mean([-math.log(proba(r)[r["y"]]) for r in rows if r["part"] == p]) for p in ("train", "val")])
        grads = {r["epk"]: (proba(r) - (np.arange(k) == r["y"]), proba(r) * (1 - proba(r))) for r in train}
        levels = []

        def leaf(r, levels):
            out = 0
            for c, last in levels:
                out = out * 2 + (r["bins"][c] > last)
            return out

        def score(group):
            g, h = (sum((grads[r["epk"]][j] for r in group), np.zeros(k)) for j in (0, 1))
            return float((g * g / (h + params.l2)).sum())

        for _ in range(params.depth):
            leaves = {}
            for r in train:
                leaves.setdefault(leaf(r, levels), []).append(r)
            best = (1e-9, None)
            for c in range(len(matrix.features)):
                for last in range(matrix.bins - 1):
                    gain = 0.0
                    for group in leaves.values():
                        lo, hi = ([r for r in group if (r["bins"][c] > last) == side] for side in (False, True))
                        if min(len(lo), len(hi)) >= params.min_rows:
                            gain += score(lo) + score(hi) - score(group)
                    if gain > best[0] + 1e-7:
                        best = (gain, (c, last))
            if best[1] is None:
                break
            levels.append(best[1])
        values = {}
        for r in train:
            values.setdefault(leaf(r, levels), []).append(r)
        values = {x: -params.rate * sum(grads[r["epk"]][0] for r in g) / (sum(grads[r["epk"]][1] for r in g) + params.l2) for x, g in values.items()}
        for r in rows:
            raw[r["epk"]] = raw[r["epk"]] + values.get(leaf(r, levels), np.zeros(k))
        trees.append(tuple(levels))
    return trees, losses, {r["epk"]: proba(r) for r in rows}


@pytest.mark.parametrize(("classes", "min_rows"), [(2, 1), (3, 1), (3, 12)])
def test_matches_a_plain_learner(spark, classes, min_rows):
    df = frame(spark, 150, classes)
    matrix = build_matrix(df, NAMES, "target", bins=8)
    params = b.Params(depth=2, rate=0.3, rounds=4, patience=99, min_rows=min_rows)
    fit = b.start_fit(matrix, params)
    b.grow(matrix, {0: fit})
    rows = [r.asDict() for r in df.collect()]
    for r in rows:
        r["y"] = matrix.classes.index(r["target"])
        r["bins"] = [int(bin_numbers(np.array([r[f] if r[f] is not None else np.nan]), c)[0]) for f, c in zip(NAMES, matrix.borders, strict=True)]
    trees, losses, proba = plain_learner(matrix, rows, params, 4)
    assert [t.levels for t in fit.trees] == trees and len(trees) == 4
    assert np.allclose(fit.losses[:4], losses, atol=1e-5)
    fit.best = 4
    made = {r.epk: r.proba for r in b.predict(b.finished(matrix, fit), df, "epk").collect()}
    assert all(np.allclose(made[i], p, atol=1e-5) for i, p in proba.items())
    (train, val), = b.aucs(matrix, {0: fit}).values()
    for part, auc in (("train", train), ("val", val)):
        want = []
        for c in [1] if classes == 2 else range(classes):
            pos, neg = ([proba[r["epk"]][c] for r in rows if r["part"] == part and (r["y"] == c) == side] for side in (True, False))
            want.append(sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / (len(pos) * len(neg)))
        assert auc == pytest.approx(np.mean(want), abs=5e-3)


def test_reruns_and_layouts_agree(spark):
    df = frame(spark, 400)
    grown = []
    for parts in (1, 7):
        matrix = build_matrix(df.repartition(parts), NAMES, "target", bins=16)
        model = b.fit_softmax(matrix, b.Params(depth=3, rounds=5, columns=0.7, weights="balanced"))
        grown.append(([t.levels for t in model.fit.trees], [t.values.tolist() for t in model.fit.trees], model.losses))
    assert grown[0] == grown[1] and len(grown[0][0]) > 0


def test_early_stopping_cuts_back(spark):
    rng = random.Random(3)
    noise = spark.createDataFrame([(i, *[rng.random() for _ in NAMES], rng.randrange(3)) for i in range(200)], "epk long, a double, b double, c double, target int")
    matrix = build_matrix(assign_parts(noise, "epk"), NAMES, "target", bins=16)
    model = b.fit_softmax(matrix, b.Params(depth=3, rate=0.5, rounds=200, patience=5))
    losses = [v for _, v in model.losses]
    assert model.rounds == losses.index(min(losses)) and len(losses) == model.rounds + 6 < 60


def test_learns_and_ranks_columns(spark):
    df = frame(spark, 600)
    matrix = build_matrix(df, NAMES, "target")
    model = b.fit_softmax(matrix, b.Params(depth=3, rounds=15))
    assert [f for f, _ in model.importances()][:2] == ["a", "b"] and sum(g for _, g in model.importances()) == pytest.approx(1)
    hit = b.predict(model, df.where("part = 'test'"), "target").withColumn("c", b.predicted_class(model))
    assert hit.agg(F.avg((F.col("c") == F.col("target")).cast("int"))).first()[0] > 0.75


def test_borders_and_bins(spark):
    df = spark.createDataFrame([(float(i), None if i else 1.0, 5.0) for i in range(100)] + [(float("nan"), None, 5.0)], "x double, y double, z double")
    x, y, z = borders(df, ["x", "y", "z"], 5)
    assert len(x) == 3 and len(y) <= 1 and z == [5.0]
    assert bin_numbers(np.array([np.nan, -1.0, x[0], x[0] + 0.1, 1e9]), x).tolist() == [0, 1, 1, 2, 4]
    with pytest.raises(ValueError):
        build_matrix(spark.createDataFrame([(1.0, None, "train")], "x double, target int, part string"), ["x"], "target")


def test_search_by_halving(spark):
    matrix = build_matrix(frame(spark, 400, 2), NAMES, "target", bins=16)
    space = s.SPACE | {"depth": (1, 3), "min_rows": (1, 20), "columns": (0.4, 1.0)}
    made = s.halving(matrix, trials=12, rungs=(2, 4, 8), gap=0.2, space=space)
    assert [t.number for t in made] == list(range(12)) and made == s.halving(matrix, trials=12, rungs=(2, 4, 8), gap=0.2, space=space)
    assert sum(t.rung == 2 for t in made) == 2 and max(made, key=lambda t: t.objective).rung >= 1
    assert all(t.objective in (0.0, t.val_auc) and t.rounds <= 8 for t in made)
    assert all(t.objective == 0.0 for t in s.halving(matrix, trials=4, rungs=(1, 2), gap=-1.0, space=space))
    assert len({tuple(sorted((k, str(v)) for k, v in s.drawn(i).items())) for i in range(150)}) == 150
    every = [s.drawn(i) for i in range(150)]
    assert {d["depth"] for d in every} == set(range(3, 11)) and {d["weights"] for d in every} == {None, "balanced", "sqrt"}


def test_elimination_and_folds(spark):
    df = frame(spark, 400)
    matrix = build_matrix(df, NAMES, "target", bins=16)
    steps = s.eliminate(matrix, b.Params(depth=2, rounds=6))
    assert [n for n, *_ in steps] == list(range(steps[0][0], 0, -1)) and steps[-1][1] != "a"
    month = F.element_at(F.array(*[F.lit(f"2026-0{m}-28").cast("date") for m in (1, 2, 3)]), (F.col("epk") % 3 + 1).cast("int"))
    folds = s.fold_fits(df.withColumn("report_dt", month), ["2026-01-28", "2026-02-28", "2026-03-28"], NAMES, "target", b.Params(depth=2, rounds=4))
    assert [(f[0], f[1], f[2]) for f in folds] == [("m1_to_m2", 134, 133), ("m1_to_m3", 134, 133), ("m1_m2_to_m3", 267, 133)]
    assert all(f[4] > 0.7 for f in folds)


def test_a_level_is_one_job_of_one_stage_on_rows_in_memory(spark):
    matrix = build_matrix(frame(spark, 300), NAMES, "target", bins=16)
    fits = {i: b.start_fit(matrix, b.Params(depth=2, patience=99, seed=i)) for i in range(3)}
    b.grow(matrix, fits, 1)
    spark.sparkContext.setJobGroup("levels", "")
    b.grow(matrix, fits, 2)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("levels")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 4 and all(len(f.trees) == 3 for f in fits.values())


def test_row_groups_and_lots_grow_the_same_trees(spark, monkeypatch):
    df = frame(spark, 400).repartition(5)
    grown = []
    for group, lot in ((b.GROUP_BYTES, b.LOT), (300, 2)):
        monkeypatch.setattr(b, "GROUP_BYTES", group)
        monkeypatch.setattr(b, "LOT", lot)
        matrix = build_matrix(df, NAMES, "target", bins=8)
        fits = {i: b.start_fit(matrix, b.Params(depth=4, patience=99, min_rows=m)) for i, m in enumerate((1, 12, 30))}
        assert (b.row_groups(matrix, fits, 4) > 1) == (group == 300)
        b.grow(matrix, fits, 5)
        grown.append(([[(t.levels, t.values.tolist()) for t in f.trees] for f in fits.values()], [f.losses for f in fits.values()], b.aucs(matrix, fits)))
    assert grown[0] == grown[1]


def test_elimination_without_a_cut_fits_each_step_once(spark, monkeypatch):
    matrix = build_matrix(frame(spark, 400), NAMES, "target", bins=16)
    fits = []
    monkeypatch.setattr(s, "grow", lambda m, f, *a: (fits.append(f), b.grow(m, f, *a)))
    steps = s.eliminate(matrix, b.Params(depth=2, rounds=4), cut=-1.0)
    assert [n for n, *_ in steps] == [3, 2, 1] and len(fits) == 3


def test_texts_are_counted_once(spark):
    from clientscope.queries.models import split_documents

    assert not [f for f in split_documents(spark, "/root/testdata/sf0.001").inputFiles() if "/root/testdata" in f]


def test_fits_that_differ_in_validation_alone_share_their_trees(spark, monkeypatch):
    matrix = build_matrix(frame(spark, 300), NAMES, "target", bins=16)
    params = b.Params(depth=3, rate=0.5, rounds=40, patience=3)
    sides = {0: ("val",), 1: ("test",), 2: ("val", "test")}
    alone = {i: b.start_fit(matrix, params, ("train",), val) for i, val in sides.items()}
    for i, fit in alone.items():
        b.grow(matrix, {i: fit})
    jobs, step = [], b.step
    monkeypatch.setattr(b, "step", lambda m, fits, levels, *a: (jobs.append(len(fits)), step(m, fits, levels, *a))[1])
    fits = {i: b.start_fit(matrix, params, ("train",), val) for i, val in sides.items()}
    b.grow(matrix, fits)
    assert set(jobs) == {1}
    assert len({f.size for f in fits.values()}) > 1  # they end at their own rounds
    for i, fit in fits.items():
        assert fit.losses == alone[i].losses and fit.best == alone[i].best and fit.gains == alone[i].gains
        assert [(t.levels, t.values.tolist()) for t in fit.trees] == [(t.levels, t.values.tolist()) for t in alone[i].trees]


def test_only_smaller_halves_are_sent(spark, monkeypatch):
    matrix = build_matrix(frame(spark, 400).repartition(5), NAMES, "target", bins=8)
    monkeypatch.setattr(b, "GROUP_BYTES", 300)
    asked, tiles = [], b.tiles
    monkeypatch.setattr(b, "tiles", lambda m, fits, units, *a: (asked.extend(u[1] for u in units), tiles(m, fits, units, *a))[1])
    b.grow(matrix, {0: b.start_fit(matrix, b.Params(depth=4, patience=99))}, 3)
    deep = [x for x in asked if x.splits and x.columns]
    assert deep and all(len(x.leaves) <= 1 << (len(x.splits) - 1) and len(set(x.leaves >> 1)) == len(x.leaves) for x in deep)


@pytest.mark.parametrize(("n", "weight"), [(300, 1.0), (9000, 1.0), (300, 5000.0)])
def test_sums_by_cell_are_exact_in_cells_of_any_size(n, weight):
    rng = np.random.default_rng(n)
    k, cells, y = 4, rng.integers(0, 3, n) ** 3, rng.integers(0, 4, n).astype(np.uint8)
    weights = np.array([weight, 1.0, 0.3, 2.0])
    q = b.softmax(rng.normal(0, 3, (k, n)))
    g, h = (np.rint(x * weights[y] * b.UNIT).astype(np.int64) for x in (q - (np.arange(k)[:, None] == y), q * (1 - q)))
    made = b.cell_sums(g, h, y, np.rint(weights * b.UNIT).astype(np.int64))(cells, 9)
    want = [[int(x[cells == c].sum()) for c in range(9)] for x in (*g, *h, np.ones(n, np.int64))]
    assert made.tolist() == want
    assert b.narrow(made).astype(np.int64).tolist() == want


def test_columns_dealt_out_grow_the_same_trees(spark, monkeypatch):
    matrix = build_matrix(frame(spark, 300), NAMES, "target", bins=16)
    grown, asked, tiles = [], [], b.tiles
    monkeypatch.setattr(b, "tiles", lambda m, fits, units, *a: (asked.append([u[1].columns for u in units]), tiles(m, fits, units, *a))[1])
    for work in (b.TASK_WORK, 1):
        monkeypatch.setattr(b, "TASK_WORK", work)
        fits = {0: b.start_fit(matrix, b.Params(depth=3, patience=99)), 1: b.start_fit(matrix, b.Params(depth=3, patience=99), ("val",))}
        asked.clear()
        b.grow(matrix, fits, 3)
        grown.append([([(t.levels, t.values.tolist()) for t in f.trees], f.losses, f.gains) for f in fits.values()])
        assert (max(map(len, asked)) > 2) == (work == 1)
        assert all(sorted(c for part in job for c in part) == [0, 0, 1, 1, 2, 2] for job in asked if len(job) > 1 and job[0])
    assert grown[0] == grown[1]


def test_a_rung_of_the_search_is_one_job(spark):
    matrix = build_matrix(frame(spark, 400), NAMES, "target", bins=16)
    space = s.SPACE | {"depth": (2, 4), "min_rows": (1, 20), "columns": (0.4, 1.0)}
    spark.sparkContext.setJobGroup("rungs", "")
    made = s.halving(matrix, trials=8, rungs=(2, 4, 6), gap=1.0, space=space)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rungs")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 3 and max(t.rounds for t in made) == 6


@pytest.mark.parametrize("held", [apart.HELD_BYTES, 0])
def test_fits_grown_apart_are_those_of_the_jobs_by_level(spark, monkeypatch, held):
    matrix = build_matrix(frame(spark, 400).repartition(5), NAMES, "target", bins=16)
    params = [b.Params(depth=d, rate=0.5, min_rows=m, weights=w, columns=c, rounds=7, patience=3, seed=d) for d, m, w, c in ((1, 1, None, 1.0), (4, 12, "sqrt", 0.7), (6, 30, "balanced", 1.0))]
    grown = []
    for way in ("levels", "apart"):
        monkeypatch.setattr(apart, "HELD_BYTES", held)
        fits = {i: b.start_fit(matrix, p) for i, p in enumerate(params)}
        found = []
        for rounds in (2, 30, 1):
            if way == "levels":
                b.grow(matrix, fits, rounds)
                found.append(b.aucs(matrix, fits))
            else:
                found.append(apart.reach(matrix, fits, rounds))
        grown.append((found, [(f.losses, f.gains, f.best, f.done, f.size) for f in fits.values()], [(t.levels, t.values.tolist()) for f in fits.values() for t in f.trees]))
    assert grown[0] == grown[1] and any(f[3] for f in grown[0][1])


LIMITS = [{}, {"PAIR_ROWS": 0}, {"PAIR_ROWS": 0, "BLOCK_ROWS": 16}, {"PIECE_ROWS": 1, "BLOCK_ROWS": 40, "SLAB_ROWS": 7}, {"GROUP_BYTES": 1, "KEPT_BYTES": 0}, {"LOW": 19, "HIGH": 20, "PAIR_ROWS": 0}, {"MOST_WEIGHT": 0}]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize(("classes", "weight"), [(2, 1.0), (3, 1.0), (3, 700.0)])
def test_blocks_pairs_and_pieces_grow_the_same_trees(spark, monkeypatch, limits, classes, weight):
    matrix = build_matrix(frame(spark, 400, classes), NAMES, "target", bins=8)
    for name, value in limits.items():
        monkeypatch.setattr(apart, name, value)
    grown = []
    for way in ("levels", "apart"):
        fit = b.start_fit(matrix, b.Params(depth=4, min_rows=6, patience=99))
        fit.weights[:] = weight
        if way == "levels":
            b.grow(matrix, {0: fit}, 3)
            ((_, found),) = b.aucs(matrix, {0: fit}).items()
        else:
            blocks = matrix.table.select("y", "p", "bins").collect()
            found = apart.grow_here(fit, 3, *[apart.rows_of(blocks, parts, 3) for parts in (fit.train, fit.val)], matrix.bins)
        grown.append((found, fit.losses, fit.gains, [(t.levels, t.values.tolist()) for t in fit.trees]))
    assert grown[0] == grown[1] and len(grown[0][3]) == 3
