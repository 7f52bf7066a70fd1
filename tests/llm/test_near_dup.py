"""Sketches, groups and components against brute force."""

import random

import numpy as np
import pytest

from clientscope.llm import near_dup
from clientscope.llm.components import components
from clientscope.llm.near_dup import Near, shingle_set, similarity_sketch


def brute_groups(texts: dict[int, str], words: int, percent: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    least = {i: i for i in texts}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                least[max(x, y)] = min(x, y)
    return {i: top(i) for i in texts}


def edited(words: list[str], n: int, rng: random.Random) -> list[str]:
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize(("chunk", "pivots"), [(512, 4), (7, 4), (3, 1)])
def test_groups_match_brute_force(spark, chunk, pivots):
    rng = random.Random(5)
    texts: dict[int, str] = {}
    for g in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 140))]
        for _ in range(rng.randrange(2, 45)):
            texts[len(texts)] = " ".join(edited(base, rng.randrange(0, 6), rng))
    texts |= {len(texts): "", len(texts) + 1: "one two", len(texts) + 2: "One  Two", len(texts) + 3: "one two three"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = {r.doc_id: r.component_id for r in near_dup.near_groups(frame, Near(words=4, chunk=chunk, pivots=pivots)).collect()}
    assert made == brute_groups(texts, 4, 80)


@pytest.mark.parametrize("percent", [40, 60, 95, 100])
def test_bands_follow_the_percent(spark, percent):
    rng, texts = random.Random(percent), {}
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(8):
            texts[len(texts)] = " ".join(edited(base, rng.randrange(0, 12), rng))
    near = Near(words=2, percent=percent, chunk=20)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = {r.doc_id: r.component_id for r in near_dup.near_groups(frame, near).collect()}
    assert made == brute_groups(texts, 2, percent) and len(set(made.values())) > 12
    assert (1 - min(percent / 100, 0.95) ** near.rows) ** near.bands <= near_dup.MISS


def test_default_shape():
    assert (Near().bands, Near().rows) == (40, 5) and (Near(bands=9, rows=2).bands, Near(bands=9, rows=2).rows) == (9, 2)
    with pytest.raises(ValueError):
        Near(percent=0)


def test_ids_of_any_value_and_type(spark):
    """A copy keeps its least id, whatever its value; lone documents keep theirs and stay."""
    copy, lone = "one two three four five six seven", [f"text number {k} that is like nothing {k} else {k}" for k in range(6)]
    ids = [2**63 - 1, 2**62, 5 * 10**18, -(2**63), -1, 0]
    rows = [*zip(ids, lone, strict=True), (2**63 - 2, copy), (-5, copy), (2**62 + 1, copy + " eight"), (None, copy)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    made = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_groups(frame, Near(words=1)).collect()}
    group = {(2**63 - 2, -5, False), (-5, -5, True), (2**62 + 1, -5, False), (None, -5, False)}
    assert made == {(i, i, True) for i in ids} | group
    assert {r.doc_id for r in near_dup.drop_near_copies(frame, Near(words=1)).collect()} == {*ids, -5}
    named = [(None if i is None else f"id {i}", t) for i, t in rows]
    frame = spark.createDataFrame(named, "doc_id string, text string")
    made = {r.doc_id: r.component_id for r in near_dup.near_groups(frame, Near(words=1)).collect()}
    least = min(f"id {i}" for i in (2**63 - 2, -5, 2**62 + 1))
    assert made == {f"id {i}": f"id {i}" for i in ids} | {f"id {i}": least for i in (2**63 - 2, -5, 2**62 + 1)} | {None: least}
    assert near_dup.drop_near_copies(frame, Near(words=1)).dtypes == frame.dtypes


def test_thousands_of_variants_are_linked_by_pivots(spark):
    """Edits of one text share large buckets; the pairs that are compared are a small part of all of them."""
    base, n = [f"w{i}" for i in range(60)], 3000
    texts = {i: " ".join([*base[: i % 60], f"new{i}", *base[i % 60 + 1 :]]) for i in range(n)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    made = near_dup.near_groups(frame, Near(words=4)).groupBy("component_id").count().collect()
    assert [(r.component_id, r["count"]) for r in made] == [(0, n)]


def test_repeated_rows_are_one_member(spark, monkeypatch):
    """Repeated rows of an id and copies without an id enter a bucket once, and their near copies are still found."""
    words = [f"w{i}" for i in range(60)]
    text, close, third = " ".join(words), " ".join([*words, "end"]), " ".join(f"v{i}" for i in range(40))
    rows = [(None, text)] * 40 + [(None, close)] * 40 + [(7, third)] * 40 + [(9, third + " end")] * 40
    seen, likely = [], near_dup.likely
    monkeypatch.setattr(near_dup, "likely", lambda dealt, near: seen.append(dealt) or likely(dealt, near))
    made = near_dup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "component_id", "kept").count()
    assert sorted(map(tuple, made.collect()), key=str) == [(7, 7, True, 40), (9, 7, False, 40), (None, None, True, 80)]
    cells = seen[0].groupBy("key", "band", "i", "j", "node").count()
    assert cells.where("count > 1").count() == 0 and cells.count() > 0


def test_sketches_fill_and_estimate():
    known: dict = {}
    rng = random.Random(1)
    for n in (1, 2, 5, 40, 3000):
        items = shingle_set(" ".join(f"t{rng.random()}" for _ in range(n)).encode(), 1, known)
        sketch = similarity_sketch(items, 200)
        assert len(items) == n and (sketch < np.iinfo(np.uint64).max).all()
    errors = []
    for trial in range(40):
        a = [f"{trial}-{i}" for i in range(500)]
        b = a[:400] + [f"{trial}-x{i}" for i in range(100)]
        x, y = (similarity_sketch(shingle_set(" ".join(t).encode(), 1, known), 200) for t in (a, b))
        errors.append((x == y).mean() - 400 / 600)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


@pytest.mark.parametrize("at_once", [500_000, 10])
def test_components_of_random_links(spark, monkeypatch, at_once):
    """In one task, and by star steps where a task holds ten links only."""
    from clientscope.llm import components as module

    monkeypatch.setattr(module, "AT_ONCE", at_once)
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    least = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    made = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert made == {x: m for x, m in least.items() if x in made} and {x for p in links if p[0] != p[1] for x in p} == set(made)


def test_filter_passes_what_is_wanted(spark):
    rows = spark.range(20_000).selectExpr("id", "md5(cast(id as string)) as text_key")
    wanted = rows.where("id % 7 = 0").select("text_key")
    made = near_dup.passing(rows, wanted)
    assert made.join(wanted, "text_key").count() == wanted.count() and made.count() < 1.05 * wanted.count() and made.columns == rows.columns
