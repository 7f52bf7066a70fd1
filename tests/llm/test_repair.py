"""Block tables against a search over all edit scripts, and whole conversations against a plain repair."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from clientscope.llm import repair
from clientscope.llm.repair import GONE, Costs, Tables

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute(symbols, costs=Costs()):
    """Least (cost, letters) by prefixes: two ways to one place of equal cost are ordered by their letters."""

    def closed(best):
        for _ in range(4):
            for p, to in NEXT.items():
                for i, q in to.items():
                    if p in best and i in "ua":
                        best[q] = min(best.get(q, (10**9, "")), (best[p][0] + costs.insert, best[p][1] + "I"))
        return best

    best = closed({0: (0, "")})
    for s in symbols:
        new = {}
        for p, (c, letters) in best.items():
            ways = [("D", p, costs.delete)]
            if s != GONE:
                extra, initial = costs.truncated * (s >= 4), "sua?"[s % 4]
                for i, q in NEXT[p].items():
                    ways += [("K", q, extra)] if i == initial else []
                    ways += [("R", q, extra + costs.rerole)] if i in "ua" else []
            for letter, q, more in ways:
                new[q] = min(new.get(q, (10**9, "")), (c + more, letters + letter))
        best = closed(new)
    return min(best[q] for q in (0, 3) if q in best)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_all_short_conversations(block):
    tables = Tables(Costs(), block)
    for n in range(4):
        for symbols in itertools.product(range(9), repeat=n):
            assert tables.solve(bytes(symbols)) == brute(symbols)


@pytest.mark.parametrize("costs", [Costs(), Costs(1, 1, 1, 1), Costs(2, 5, 1, 0), Costs(7, 2, 9, 4)])
def test_long_conversations_and_other_costs(costs):
    tables, rng = Tables(costs, 3), random.Random(1)
    for _ in range(1500):
        symbols = [rng.choice((rng.randrange(9), 0, 1, 2, 2, 1)) for _ in range(rng.randrange(60))]
        assert tables.solve(bytes(symbols)) == brute(symbols, costs)


def plain(rows):
    """The contract's row of a conversation, from (turn, role, text, times), step by step."""
    flat = [r[:3] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())) for _ in range(r[3])]
    seen, symbols, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for _, role, text in flat:
        bare = text.strip(" \t\n\r\x0b\x0c")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        symbols.append(GONE if fault in ("blank", "duplicate") else "sua".find(role[0]) % 4 + 4 * (fault == "truncated"))
    illegal = sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(flat))
    turns = {t for t, _, _ in flat if t is not None}
    cost, audit = brute(symbols)
    lines, at, kept = [], 0, len(audit) - audit.count("D")
    for letter in audit:
        role, text = flat[at][1:] if letter != "I" else ("", "")
        at += letter != "I"
        if letter != "D":
            due = ("user", "assistant")[(len(lines) - kept % 2) % 2]
            lines.append(f"{role if letter == 'K' else due}:{text}")
    initials = "".join(x[0] for x in lines)
    assert re.fullmatch("(s?(ua)+)?", initials)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)


def test_frames_match_a_plain_repair(spark):
    rng = random.Random(6)
    texts = ["Fine.", "Not ended", "", " \t\n", "Is it? ", "Yes!\n", None, "日本。", "Fine.", "x" * 5000 + "."]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(12)):
            turn = rng.choice([turn, turn, turn, None, turn + 3])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(texts)))
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)] + [(901, 5, "user", "only")] * 40
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({c: F.lit("x") for c in ("mark", "fault", "times", "phase", "body", "part", "cost", "audit")}).repartition(5)
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text, 1))
    made = {r[0]: tuple(r[1:]) for r in repair.repair_chats(frame).collect()}
    assert made == {c: plain(g) for c, g in groups.items()}
    assert repair.repair_chats(frame.limit(0)).collect() == []

    planted = {}
    for conv, turn, role, text in rows:
        d = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        text = " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        planted.setdefault(conv, []).append((turn, "user" if d == 4 else role or " ", text, {0: 0, 3: 2}.get(d, 1)))
    made = {r[0]: tuple(r[1:]) for r in repair.repaired(repair.damaged(frame)).collect()}
    assert made == {c: plain(g) for c, g in planted.items()}


def test_other_ids_and_odd_roles(spark):
    rows = [("b", 1, "", "Empty role."), ("b", 2, "assistant", "Answer."), ("a", None, "user", ""), ("c", 1, "user", "Q?"), ("c", 9, "assistant", "A.")]
    made = {r[0]: tuple(r[1:8]) for r in repair.repair_chats(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert made == {"a": (0, 1, 0, 0, 0, 4, "D"), "b": (0, 0, 0, 0, 1, 3, "RK"), "c": (7, 0, 0, 0, 0, 0, "KK")}
