"""Conversation repair: the cheapest edits that make the turns legal, by Four-Russians block tables over row symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.llm.common import name

BLANKS = "\t\n\x0b\x0c\r "
FAR = 1 << 20
#: States of a legal conversation s?(ua)+ or nothing: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
#: Row symbols: initial s, u, a or another one, whole or truncated; a row that has to go; and no row, which fills the last block.
INITIALS = "sua?"
GONE, NONE = 8, 9
SYMBOLS = 10
KEPT, TRUNCATED, BLANK, DUPLICATE = range(4)


@dataclass(frozen=True)
class Costs:
    """What edits cost. A truncated row that stays costs ``truncated`` on top."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


def insertions(costs: Costs) -> list[tuple[int, int]]:
    return [(p, q) for p, to in NEXT.items() for initial, q in to.items() if initial in ROLES]


class Tables:
    """Transitions of normalised cost vectors: for one symbol, and for every block of ``length`` symbols.

    A vector has the least cost of reaching each state, less the least of all, with insertions taken into account. What
    lies more than ``margin`` above the assistant state can never be part of a cheapest way, since from there the same
    rows can follow at no more than one deletion more; such entries become FAR, and so few vectors remain.
    """

    def __init__(self, costs: Costs, length: int):
        self.costs, self.length = costs, length
        self.inserted = insertions(costs)
        self.margin = 2 * (costs.delete + costs.rerole + costs.insert + costs.truncated)
        first, self.first_cost = self.normal([0, FAR, FAR, FAR])
        self.vectors, number = [first], {first: 0}
        to, add = [], []
        for vector in self.vectors:  # grows while it is read
            made = [self.normal(self.step(vector, s)) for s in range(SYMBOLS)]
            for v, _ in made:
                if v not in number:
                    number[v] = len(self.vectors)
                    self.vectors.append(v)
            to.append([number[v] for v, _ in made])
            add.append([c for _, c in made])
        self.to, self.add = np.array(to, np.int32), np.array(add, np.int32)
        block_to, block_add = np.arange(len(to), dtype=np.int32)[:, None], np.zeros((len(to), 1), np.int32)
        for _ in range(length):  # one more symbol at the end of every block
            block_add = (block_add[:, :, None] + self.add[block_to]).reshape(len(to), -1)
            block_to = self.to[block_to].reshape(len(to), -1)
        self.block_to, self.block_add = block_to, block_add
        self.traced: dict[tuple[int, int, tuple[int, ...]], tuple[list, tuple[int, ...]]] = {}

    def edits(self, symbol: int) -> list[tuple[str, int, int, int]]:
        """(letter, from, to, cost) of everything that can be done with a row."""
        if symbol == NONE:
            return [("", q, q, 0) for q in NEXT]
        out = [("D", q, q, self.costs.delete) for q in NEXT]
        if symbol != GONE:
            extra = self.costs.truncated * (symbol >= len(INITIALS))
            initial = INITIALS[symbol % len(INITIALS)]
            for p, to in NEXT.items():
                out += [("K" if i == initial else "R", p, q, extra + self.costs.rerole * (i != initial)) for i, q in to.items() if i == initial or i in ROLES]
        return out

    def closed(self, cost: list[int]) -> list[int]:
        for _ in NEXT:
            for p, q in self.inserted:
                cost[q] = min(cost[q], cost[p] + self.costs.insert)
        return cost

    def step(self, vector: tuple[int, ...], symbol: int) -> list[int]:
        out = [FAR] * len(NEXT)
        for _, p, q, c in self.edits(symbol):
            out[q] = min(out[q], vector[p] + c)
        return self.closed(out)

    def normal(self, cost: list[int]) -> tuple[tuple[int, ...], int]:
        cost = self.closed(list(cost))
        least, most = min(cost), cost[ASSISTANT] + self.margin
        return tuple(c - least if c <= most else FAR for c in cost), least

    def expanded(self, vector: int, block: int, alive: tuple[int, ...]) -> tuple[list, tuple[int, ...]]:
        """A block taken apart from its end, given the states alive there: the edits and insertions of every row that lie
        on a cheapest way, ties included, last row first; and the states alive before the block."""
        if (vector, block, alive) not in self.traced:
            starts, now = [], vector
            symbols = [block // SYMBOLS ** (self.length - 1 - k) % SYMBOLS for k in range(self.length)]
            for s in symbols:
                starts.append(now)
                now = int(self.to[now, s])
            ways, states = [], set(alive)
            for start, s in zip(reversed(starts), reversed(symbols), strict=True):
                then, added, before = int(self.to[start, s]), int(self.add[start, s]), self.vectors[start]
                after = [c + added if c < FAR else FAR for c in self.vectors[then]]
                used = [e for e in self.edits(s) if e[2] in states and after[e[2]] < FAR and before[e[1]] + e[3] == after[e[2]]]
                states, inserts = self.widened({e[1] for e in used}, before)
                # Of a state's edits the first letter counts, and it leads to one state.
                ways.append(({e[1]: e for e in sorted(used, reverse=True)}, dict(inserts)))
            self.traced[vector, block, alive] = ways, tuple(sorted(states))
        return self.traced[vector, block, alive]

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """Least cost, and of all cheapest edit scripts the one whose letters come first."""
        padded = np.frombuffer(symbols + bytes([NONE]) * (-len(symbols) % self.length), np.uint8).astype(np.int64)
        blocks = padded.reshape(-1, self.length) @ (SYMBOLS ** np.arange(self.length - 1, -1, -1))
        at, cost, before = 0, self.first_cost, []
        for b in blocks.tolist():
            before.append((at, b))
            cost += int(self.block_add[at, b])
            at = int(self.block_to[at, b])
        last = self.vectors[at]
        cost += (least := min(last[q] for q in ENDS))
        # Backwards, block by block, with all ties; then forwards by the first letter that stays on a cheapest way.
        goal = {q for q in ENDS if last[q] == least}
        alive, inserts = self.widened(goal, last)
        alive, traced = tuple(sorted(alive)), [[({}, dict(inserts))]]
        for vector, block in reversed(before):
            ways, alive = self.expanded(vector, block, alive)
            traced.append(ways)
        state, out = START, []
        for ways in reversed(traced):
            for rows, inserts in reversed(ways):
                while state in inserts and not (rows[state][0] < "I" if state in rows else state in goal and not rows):
                    out.append("I")
                    state = inserts[state]
                if rows:
                    letter, _, state, _ = rows[state]
                    out.append(letter)
        return cost, "".join(out)

    def widened(self, alive: set[int], vector: tuple[int, ...]) -> tuple[set[int], list[tuple[int, int]]]:
        """The states from which insertions lead to those alive at no loss, and these insertions."""
        alive, used = set(alive), []
        for _ in NEXT:
            for p, q in self.inserted:
                if q in alive and (p, q) not in used and vector[q] < FAR and vector[p] + self.costs.insert == vector[q]:
                    used.append((p, q))
                    alive.add(p)
        return alive, used


@cache
def tables(costs: Costs, length: int) -> Tables:
    """One set of tables for each process."""
    return Tables(costs, length)


class Repaired:
    """Digest of the repaired rows while their texts come by, in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.rows, self.sha = audit, 0, 0, hashlib.sha256()
        self.lead = (len(audit) - audit.count("D")) % 2

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode())
        self.rows += 1

    def role(self) -> str:
        """The role that this place of a legal conversation has."""
        return ROLES["ua"[(self.rows - self.lead) % 2]]

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.put(self.role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self.put(role if letter == "K" else self.role(), text)

    def digest(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


class Conversation:
    """One conversation: its keys come first, in order, and give the edits; its texts follow, one at a time."""

    def __init__(self, key, made: Tables):
        self.key, self.tables = key, made
        self.symbols, self.seen, self.counts = bytearray(), set(), [0] * 4
        self.illegal, self.last, self.repaired = 0, None, None
        self.turns, self.first_turn, self.turn = 0, None, None

    def light(self, role: str, mark: bytes, fault: int, times: int, turn: int | None) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.first_turn = turn if self.turns == 1 else self.first_turn
            self.turn = turn
        for _ in range(times):
            now = fault
            if now != BLANK:
                both = hashlib.md5(mark + role.encode(), usedforsecurity=False).digest()
                now = DUPLICATE if both in self.seen else now
                self.seen.add(both)
            self.counts[now] += 1
            kind = INITIALS.find(role[:1]) if role[:1] and role[:1] in "sua" else len(INITIALS) - 1
            self.symbols.append(GONE if now in (BLANK, DUPLICATE) else kind + len(INITIALS) * (now == TRUNCATED))
            self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
            self.last = role[:1]

    def solved(self) -> Repaired:
        if self.repaired is None:
            self.cost, audit = self.tables.solve(bytes(self.symbols))
            self.repaired = Repaired(audit)
        return self.repaired

    def full(self, role: str, text: str, times: int) -> None:
        for _ in range(times):
            self.solved().row(role, text)

    def result(self) -> tuple:
        done = self.solved()
        gaps = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        digest = done.digest()
        return (self.key, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.cost, done.audit, digest)


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def marked(chats: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Each row as conv_id, turn, role, text, times; nulls in role and text are one space."""
    return chats.select(
        name(conv_col).alias("conv_id"), name(turn_col).cast("bigint").alias("turn"), F.coalesce(name(role_col), F.lit(" ")).alias("role"),
        F.coalesce(name(text_col), F.lit(" ")).alias("text"), F.lit(1).alias("times"),
    )


def repaired(rows: DataFrame, costs: Costs = Costs(), block: int = 3) -> DataFrame:
    """The report of repair_chats for rows (conv_id, turn, role, text, times); rows of times 0 only name their conversation.

    One shuffle deals conversations out. A task sees a conversation's keys first (role, digest of the text, fault), from
    which the edits follow, and then its texts, one after another: it holds about a hundred bytes of each row of a
    conversation, and never its texts.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), KEPT).otherwise(TRUNCATED)
    mark = F.unhex(F.md5(F.encode("text", "UTF-8")))
    keyed = rows.withColumns({"mark": mark, "fault": fault})
    key = F.struct(F.lit(0).alias("phase"), F.lit("").alias("body"))
    body = F.struct(F.lit(1).alias("phase"), F.col("text").alias("body"))
    twice = keyed.withColumn("part", F.explode(F.when(F.col("times") > 0, F.array(key, body)).otherwise(F.array(key))))
    flat = twice.select("conv_id", "part.phase", "turn", "role", "mark", "fault", "times", "part.body")
    order = ["conv_id", "phase", F.col("turn").asc_nulls_first(), "role", "mark"]
    dealt = flat.repartition("conv_id").sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, out, ids = tables(costs, block), None, [], None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], ids), *[pa.array(c) for c in columns[1:]]]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *[c.split()[0] for c in RESULT.split(", ")]])

        for part in batches:
            ids = part.schema.field("conv_id").type
            texts = part.column("body")
            keys = zip(*[part.column(c).to_pylist() for c in flat_names[:-1]], strict=True)
            for at, (conv, phase, turn, role, mark, fault, times) in enumerate(keys):
                if now is None or conv != now.key:
                    if now is not None:
                        out.append(now.result())
                        if len(out) >= 1000:
                            yield batch()
                    now = Conversation(conv, made)
                if phase and times:
                    now.full(role, texts[at].as_py(), times)
                elif times:
                    now.light(role, mark, fault, times, turn)
        if now is not None:
            out.append(now.result())
        if out:
            yield batch()

    flat_names = flat.columns
    return dealt.mapInArrow(run, f"conv_id {kind}, {RESULT}")


def repair_chats(
    chats: DataFrame, costs: Costs = Costs(), *, block: int = 3, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: its faults, and the cheapest edits that make its roles read s?(ua)+ or nothing.

    Rows go by turn, nulls first; equal turns by role, then digest of the text. A row's first fault counts: ``blank`` (no
    character other than ASCII white space), ``duplicate`` (role and text seen earlier), ``truncated`` (the last such
    character is none of . ! ?). ``gaps`` are missing turns between the least and the largest; ``illegal`` adjacent roles
    are those whose initials are not su, ua or au. Edits keep a row, rerole it to user or assistant, delete it (a must
    for blank and duplicate rows) or insert an empty user or assistant row. ``audit`` has the initials of the cheapest
    edits, of equal ones the first in ASCII order; ``repaired_sha256`` is the digest of the repaired `role:text` lines.

    Nulls in role and text are one space; a null conv_id is a conversation of its own; an empty role can be reroled or
    deleted only. Repeated rows are duplicates, an empty table gives no rows, and further columns are ignored. One
    conversation's result is one row, so its keys meet in one task, at about a hundred bytes a row; texts of any length
    pass through it one by one.
    """
    return repaired(marked(chats, conv_col, turn_col, role_col, text_col), costs, block)


def damaged(chats: DataFrame) -> DataFrame:
    """Rows for ``repaired`` with faults planted by d = crc32(`conv_id:turn`) mod 20 (nulls: one space): 0 drops the row,
    1 empties its text, 2 removes its . ! and ?, 3 repeats it and 4 sets role user."""
    blank = F.lit(" ")
    d = F.crc32(F.encode(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]), "UTF-8")) % 20
    text: Column = F.coalesce("text", blank)
    return chats.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.when(d == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("times"),
    )
