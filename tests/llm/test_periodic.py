"""Periodic runs against a search over all periods, and planted periods against their definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from clientscope.llm.periodic import find_runs, planted, run_digests, slice_runs


def brute(w, min_length=6, powers=4):
    out = []
    for q in range(1, len(w) // powers + 1):
        at = 0
        while at + q < len(w):
            if w[at] != w[at + q]:
                at += 1
                continue
            first = at
            while at + q < len(w) and w[at] == w[at + q]:
                at += 1
            part = w[first : at + q]
            smaller = any(part[d:] == part[:-d] for d in range(1, q))
            if len(part) >= max(min_length, powers * q) and not smaller:
                out.append((first, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng, letters="abcd"):
    w = []
    while rng.random() < 0.8:
        if rng.random() < 0.5:
            w += [rng.choice(letters) for _ in range(rng.randrange(10))]
        else:
            period = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
            w += [period[i % len(period)] for i in range(rng.randrange(3 * len(period), 8 * len(period)))]
    return w


@pytest.mark.parametrize(("min_length", "powers"), [(6, 4), (3, 3), (1, 5), (20, 3)])
def test_runs_match_brute_force(min_length, powers):
    rng = random.Random(powers)
    for _ in range(400):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 5))]
        made = slice_runs([[x.encode() for x in t] for t in texts], min_length, powers)
        assert made == [brute(t, min_length, powers) for t in texts]


def test_hot_grams_take_linear_work():
    """One word all over, and long periods whose grams recur at many places."""
    assert slice_runs([[b"x"] * 200_000], 6, 4) == [[(0, 200_000, 1)]]
    rng = random.Random(9)
    period = [b"%d" % rng.randrange(40) for _ in range(5_000)]
    assert slice_runs([(period * 5)[:-100], [b"y"] * 5], 6, 4) == [[(0, 24_900, 5_000)], []]


def test_query_parts_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(some_words(rng, "abcdefgh") + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(60))])) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (None, "a a a a a a a"), (None, None), (7, "b b b b b b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "best", "n_words", "collapsed_text", "start")})
    made = sorted(map(tuple, run_digests(find_runs(planted(frame))).collect()), key=repr)
    want = []
    for i, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute(w)
        keep = [x for k, x in enumerate(w) if not any(s + p <= k < s + n for s, n, p in runs)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(keep))]
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha))
    assert made == sorted(want, key=repr)


def test_few_powers_are_refused(spark):
    with pytest.raises(ValueError):
        find_runs(spark.createDataFrame([], "doc_id long, text string"), powers=2)
