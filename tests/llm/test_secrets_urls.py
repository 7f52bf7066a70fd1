"""Secret spans against re.finditer, trigram queries against texts that match, and filters that are far too small."""

import random
import re

from clientscope.llm import secrets, urls

SAMPLES = [
    "password=abcdef", "PassWd : 'x9_/+=-'", "api_key=\"short\"", "apikey: longer123", "token=secret=abcdefgh", "secret=tok:abcdefg", "AKIA" + "Z" * 16,
    "AKIA" + "Z" * 15, "AKIAAKIA" + "Q" * 20, "a" * 23, "0123456789abcdef" * 3, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20,
    "xoxb-" + "1" * 12, "AIza" + "x" * 35, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "é" * 3, "пароль", "", " ", "\n", "ſecret=abcdef", "toKen=abcdef",
]


def test_spans_match_finditer(spark):
    rng = random.Random(2)
    texts = {i: rng.choice([" ", "\n", ""]).join(rng.choices(SAMPLES, k=rng.randrange(0, 9))) for i in range(300)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = {r.doc_id: [(s.first, s.kind, s.end) for s in r.found] for r in secrets.scan(frame).collect()}
    order = [r.kind for r in secrets.RULES]
    for i, t in texts.items():
        want = []
        for rule in secrets.RULES:
            for m in re.finditer(rule.pattern, t, re.ASCII):
                if len(m.group(rule.group)) >= rule.least and m.group(0).isascii():
                    want.append((m.start(), rule.kind, m.end()))
        assert made[i] == sorted(want, key=lambda s: (s[0], order.index(s[1]))), t


def test_queries_never_exclude_a_match():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        assert bool(query) == (rule.kind != "hex")
        for s in SAMPLES:
            if re.search(rule.pattern, s, re.ASCII) and s.isascii():
                held = secrets.trigrams(s.lower())
                assert all(any(option <= held for option in clause) for clause in query)


def test_small_bloom_filter_is_exact(spark):
    rows = [(i, f"http://www.h{i % 7}.org/p{i}/?b=2&utm_source=x&a={i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([(f"https://H{i % 7}.org/p{i}?a={i}&b=2#top",) for i in range(0, 400, 3)], "url string")
    for blocks in (1, 64):
        made = {r.page_id: r.verdict for r in urls.judge_urls(pages, listed, blocks=blocks).collect()}
        assert made == {i: "block" if i % 3 == 0 else "allow" for i in range(400)}
    kept = urls.judge_urls(pages, listed, blocks=4096)
    assert "Bloom" not in kept.columns and kept.columns == ["page_id", "host", "path", "rule", "canonical", "verdict"]


def test_longest_rule_wins(spark):
    rows = [(1, "http://a.example.com/en/x"), (2, "http://www.example.com/en/"), (3, "http://x.net/fr/?q"), (4, "http://com"), (5, "http://net.de/fr/"), (6, "x.com/")]
    made = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "url string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in made.collect()}
    assert got[1][2:] == ("example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("net/fr/", "block")
    assert got[4] == ("com", "", None, "allow") and got[5][2:] == (None, "allow") and got[6] == ("", "", None, "allow")
