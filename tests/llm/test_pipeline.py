"""Every stage of the pipeline against brute force over its own input."""

import hashlib
import re

import pytest

import corpus_pipeline
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_dup import brute_groups

SF = "/root/testdata/sf0.001"
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return ASCII_WORD.findall(text or "")


def quality(docs):
    out = {}
    for i, t in docs.items():
        w = words(t)
        grams = list(zip(w, w[1:], w[2:]))  # noqa: B905
        hit = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in (k, k + 1, k + 2)}
        if len(w) < 50 or 100 * len(hit) > 50 * len(w):
            continue
        kept, lost = [], 0
        for line in (t or "").split("\n"):
            n, bare = len(words(line)), line.strip(" \t\n\r\x0b\x0c")
            unended = n < 10 and not bare.endswith(tuple(".!?…:;\"'”»)。！？"))
            noisy = 100 * len(re.findall(r"[!?#*$%&<>]{2,}", bare)) > 20 * n
            menu = len(re.findall(r"[|»›•]", bare)) >= 3
            stock = n <= 30 and re.search(
                "cookie|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|click here|read more|sign in"
                "|sign up|log in|subscribe|share this|back to top", bare.translate(UPPER),
            )
            if n and (unended or noisy or menu or stock):
                lost += sum(map(len, words(line)))
            else:
                kept.append(line)
        if 100 * lost <= 30 * sum(map(len, w)):
            out[i] = "\n".join(kept)
    return out


def line_repeats(docs):
    holders = {}
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(UPPER)
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    keep = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return {i: "\n".join(x for x in (t or "").split("\n") if keep.get(key(x), i) == i) for i, t in docs.items()}


def near(docs):
    groups = brute_groups(docs, 5, 80)
    return {i: t for i, t in docs.items() if groups[i] == i}


def contamination(docs, items):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    windows = set()
    for t in items:
        w = tokens(t)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    bad = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    return {i: t for i, t in docs.items() if not bad(tokens(t))}


def mixture(docs, source):
    sizes = {}
    for i, t in docs.items():
        sizes[source[i]] = sizes.get(source[i], 0) + len(words(t))
    target, out = brute_targets(sizes), {}
    for i in docs:
        rate = min(2.0, target[source[i]] / sizes[source[i]]) if sizes[source[i]] else 0.0
        draw = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
        out[i] = int(rate) + (draw < rate - int(rate))
    return {i: n for i, n in out.items() if n}


@pytest.mark.parametrize("sf", [SF])
def test_stages(spark, sf, tmp_path):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    df = spark.read.parquet(f"{sf}/documents.parquet")
    source = {r.doc_id: r.source for r in df.collect()}
    brute = [quality, line_repeats, near, lambda d: contamination(d, items), lambda d: mixture(d, source)]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    for k, ((name, stage), check) in enumerate(zip(corpus_pipeline.STAGES, brute, strict=True)):
        before = {r.doc_id: r.text for r in df.collect()}
        made = stage(spark, df, sf)
        assert made.dtypes == df.dtypes
        made.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        rows = df.collect()
        want = check(before)
        if name == "mixing":
            assert sorted(r.doc_id for r in rows) == sorted(i for i, n in want.items() for _ in range(n))
        else:
            assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want) > 0
        assert all(r.n_chars == len(r.text) for r in rows)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in rows)
