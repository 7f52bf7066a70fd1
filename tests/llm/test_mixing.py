"""Targets against the stated resharing, done step by step, and what the mix takes."""

import random
from collections import defaultdict

from clientscope.llm import mixing


def brute_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = {s: 0.0 for s in order}, set(order), share * sum(sizes.values())
    while free and rest > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.remove(s)
    return target


def test_targets(spark):
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 500, rng.randrange(10**6)]) for i in range(n)} | ({None: 77} if n > 2 else {})
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        made = {r.source: r for r in mixing.targets(frame).collect()}
        want = brute_targets(sizes)
        assert set(made) == set(want)
        for s, t in want.items():
            assert abs(made[s].target - t) <= 1e-6 * max(1.0, t) and made[s].rate <= 2


def test_mix_comes_near_the_targets_and_agrees_with_its_report(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = mixing.mix_report(frame).collect()
    taken, target, size = defaultdict(int), {}, {r[0]: r[2] for r in rows}
    for r in report:
        taken[size[r.doc_id]] += r.taken
        target[size[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    for s in target:
        assert abs(taken[s] - target[s]) < 0.05 * target[s]
    copies = defaultdict(int)
    for r in mixing.mix(frame).collect():
        copies[r.doc_id] += 1
    assert {r.doc_id: r.copies for r in report if r.copies} == dict(copies)
    assert sorted(mixing.mix_report(frame.repartition(7)).collect()) == sorted(report)
