"""Secret scan: a trigram inverted index finds the candidates of each rule, and the rule's pattern verifies them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.llm.common import pick, text_key, written

MOST = 64  # alternatives of a literal run that are told apart


@dataclass(frozen=True)
class Rule:
    """A pattern that means the same to Java and Python; with ``group``, a match counts from ``least`` characters in it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# Patterns of well-known token formats.
RULES = (
    Rule(
        "assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2, least=6, base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

#: An AND of ORs of ANDs of trigrams: every clause needs one alternative, an alternative needs all its trigrams.
Query = list[list[frozenset[str]]]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def literals(parts, runs: list[set[str]], now: set[str]) -> set[str]:
    """Walk a parsed pattern; ``now`` holds the strings the current literal run may end in, closed runs go to ``runs``."""

    def close() -> set[str]:
        runs.append(now)
        return {""}

    for code, value in parts:
        if code is op.LITERAL:
            choice = {chr(value)}
        elif code is op.IN and all(c is op.LITERAL for c, _ in value):
            choice = {chr(v) for _, v in value}
        elif code is op.SUBPATTERN:
            now = literals(value[3], runs, now)
            continue
        elif code is op.BRANCH and (exact := [exactly(b) for b in value[1]]) and None not in exact:
            choice = set().union(*exact)
        elif code is op.MAX_REPEAT and value[:2] == (0, 1) and (inner := exactly(value[2])) is not None:
            choice = inner | {""}
        else:  # anything else may be any text
            now = close()
            continue
        if len(now) * len(choice) > MOST:
            now = close()
        now = {a + b for a, b in product(now, choice)}
    return now


def exactly(parts) -> set[str] | None:
    """All strings a parsed pattern can match, if it is made of few literals."""
    runs: list[set[str]] = []
    last = literals(parts, runs, {""})
    return None if runs else last


def trigram_query(pattern: str) -> Query:
    """What a text must hold to match, in folded trigrams; empty if the pattern has no mandatory trigram."""
    runs: list[set[str]] = []
    runs.append(literals(_parser.parse(pattern), runs, {""}))
    clauses = []
    for run in runs:
        alternatives = {trigrams(s.lower()) for s in run}
        if frozenset() not in alternatives:
            clauses.append(sorted(alternatives, key=sorted))
    return clauses


def build_index(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """Postings (trigram, doc_id, text_key) of the trigrams that rules ask for, over whole folded texts.

    lower() maps A-Z whatever else it changes, so a text that a rule matches is in all its postings.
    """
    folded = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.lower("text").alias("folded"))
    held = F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.col("folded").contains(g))
    return folded.select(F.explode(held).alias("trigram"), "doc_id", "text_key")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, text_key, rules): intersect the postings per document, so that no trigram's list meets in one task."""
    per_doc = index.groupBy("doc_id", "text_key").agg(F.collect_set("trigram").alias("grams"))

    def holds(query: Query) -> Column:
        out = F.lit(True)
        for clause in query:
            options = [F.size(F.array_except(F.array(*map(F.lit, sorted(g))), F.col("grams"))) == 0 for g in clause]
            out = out & F.greatest(*options, F.lit(False))
        return out

    names = F.filter(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]), lambda k: k.isNotNull())
    return per_doc.select("doc_id", "text_key", names.alias("rules")).where(F.size("rules") > 0)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct(first, order, end)> of the rule's matches in code points, end exclusive.

    The text between the matches gives their places: each match starts behind all earlier pieces and matches.
    """
    pattern = F.lit(rule.pattern)
    size = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    before = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    kept = size if not rule.group else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m))
    steps = F.arrays_zip(before.alias("gap"), size.alias("size"), kept.alias("kept"))
    none = F.array().cast("array<struct<first:int,order:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def move(now: Column, step: Column) -> Column:
        first = now["at"] + step["gap"]
        end = first + F.coalesce(step["size"], F.lit(0))
        one = F.array(F.struct(first.alias("first"), F.lit(order).alias("order"), end.alias("end")))
        counts = step["size"].isNotNull() & (step["kept"] >= rule.least)
        return F.struct(end.alias("at"), F.when(counts, F.concat(now["out"], one)).otherwise(now["out"]).alias("out"))

    return F.aggregate(steps, start, move, lambda now: now["out"])


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and found, the array of (first, order, end, kind, base) by place, then rule order.

    For each rule a Boolean query over trigrams is derived from its pattern. The postings of these trigrams are built,
    intersected per document, and only documents that satisfy the query are searched with the pattern. Rules without a
    mandatory trigram (such as runs of hexadecimal digits) search every text. Matches are leftmost and do not overlap
    within a rule; rules may overlap each other.

    Null texts are empty; rows that repeat an id keep their own texts; null ids are allowed; other columns are ignored.
    An empty table gives no rows; a very long text is one row's work like any other.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for clause in q for option in clause for g in option})
    found = rows.withColumn("rules", F.array().cast("array<string>"))
    if grams:
        index = written(build_index(rows, grams), "trigram-index")
        wanted = candidates(index, queries).withColumnsRenamed({"doc_id": "of_doc", "text_key": "of_text"})
        same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (text_key(F.col("text")) == F.col("of_text"))
        found = rows.join(wanted, same, "left").select("doc_id", "text", "rules")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<first:int,order:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        matches = spans(text, rule, i)
        if rule.kind in queries:
            matches = F.when(F.array_contains("rules", rule.kind), matches).otherwise(none)
        parts.append(matches)
    kinds = F.array(*[F.lit(r.kind) for r in rules]).cast("array<string>")
    bases = F.array(*[F.lit(r.base) for r in rules]).cast("array<boolean>")
    return found.select("doc_id", F.array_sort(F.concat(none, *parts)).alias("at")).select(
        "doc_id",
        F.transform("at", lambda s: F.struct(
            s["first"].alias("first"), s["order"].alias("order"), s["end"].alias("end"),
            F.get(kinds, s["order"]).alias("kind"), F.get(bases, s["order"]).alias("base"),
        )).alias("found"),
    )


def listing(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["first"], s["end"])), ",")
