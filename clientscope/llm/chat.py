"""Chat formatting: a finite-state machine checks the turn order, a declarative template makes segments with loss flags."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.llm.common import pick


@dataclass(frozen=True)
class Turn:
    prefix: str
    suffix: str
    loss: bool = False


def turns_of_template() -> dict[str, Turn]:
    return {
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn(" ", "</s>", loss=True),
    }


@dataclass(frozen=True)
class Template:
    """What surrounds the text of each role, and the order of turns.

    ``moves`` is the state machine: from a state (the last role, "" at the start) to the roles that may follow; a
    conversation is valid if every move is allowed and it ends in one of ``ends``. A role outside ``turns`` is written
    as ``role_marks[0] role role_marks[1] text role_marks[2]``.

    Control strings start with a sign that does not occur again inside any of them, and none starts another one, so
    that texts can be escaped: a backslash after the first sign, one more if there are some already.
    """

    begin: str = "<s>"
    turns: Mapping[str, Turn] = field(default_factory=turns_of_template)
    role_marks: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    moves: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = self.controls()
        starts = {m[0] for m in marks}
        if any(set(m[1:]) & (starts | {"\\"}) for m in marks):
            raise ValueError("a control string holds the first sign of another one, or a backslash")
        if any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("a control string starts another one")
        if len({t.suffix.strip() for t in self.turns.values()} | {self.role_marks[2]}) != len(self.turns) + 1:
            raise ValueError("the ends of turns must differ")

    def controls(self) -> list[str]:
        around = [p.strip() for t in self.turns.values() for p in (t.prefix, t.suffix)]
        return sorted({m for m in (self.begin.strip(), *around, *self.role_marks) if m})

    def tails(self) -> dict[str, str]:
        """By first sign, a pattern of what follows it in the control strings."""
        by: dict[str, list[str]] = {}
        for m in self.controls():
            by.setdefault(m[0], []).append(re.escape(m[1:]))
        return {sign: "|".join(rest) for sign, rest in by.items()}


def escaped(text: Column, template: Template) -> Column:
    for sign, rest in template.tails().items():
        text = F.regexp_replace(text, rf"({re.escape(sign)})(\\*)({rest})", r"$1\\$2$3")
    return text


def unescaped(text: Column, template: Template) -> Column:
    for sign, rest in template.tails().items():
        text = F.regexp_replace(text, rf"({re.escape(sign)})\\(\\*)({rest})", "$1$2$3")
    return text


def segment(text: Column | str, loss: bool = False) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(loss).alias("loss"))


def turn_segments(turn: Column, template: Template) -> Column:
    """The segments of one turn: marks without loss, the escaped text with the loss of its role."""
    body = escaped(turn["text"], template)
    a, b, c = template.role_marks
    out = F.array(segment(a), segment(escaped(turn["role"], template)), segment(b), segment(body), segment(c))
    for role, t in template.turns.items():
        out = F.when(turn["role"] == role, F.array(segment(t.prefix), segment(body, t.loss), segment(t.suffix))).otherwise(out)
    return out


def order_check(turns: Column, template: Template) -> Column:
    """Run the state machine: struct(state, at, bad) with the number of the first turn that no move allows."""
    pairs = [F.lit(x) for state, roles in template.moves.items() for r in roles for x in (f"{state}>{r}", r)]
    table = F.create_map(*pairs)
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def move(now: Column, turn: Column) -> Column:
        to = F.try_element_at(table, F.concat(now["state"], F.lit(">"), turn["role"]))
        return F.struct(
            F.coalesce(to, F.lit("error")).alias("state"),
            (now["at"] + 1).alias("at"),
            F.coalesce(now["bad"], F.when(to.isNull(), now["at"])).alias("bad"),
        )

    return F.aggregate(turns, start, move)


def format_chats(
    rows: DataFrame, template: Template = Template(), *, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments (text, loss), formatted, valid and bad_turn.

    Turns are ordered by number, null first, then by role and text, so that ties and repeated rows have one order;
    repeated rows stay. A null text or role is empty. Conversations in a wrong order are formatted too: ``valid`` is
    false and ``bad_turn`` counts the turns before the first wrong one (null if only the end is missing). A row without
    a conversation id is a conversation of its own. Other columns are ignored. A conversation becomes one value, so its
    turns meet in one task; no other rows do.
    A text of any length is one value of its row, folded once; an empty table gives no rows.
    """
    named = pick(rows, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    one = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = named.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    single = named.where(F.col("conv_id").isNull()).select("conv_id", F.array(one).alias("turns"))
    begin = F.array(segment(template.begin))
    segments = F.concat(begin, F.flatten(F.transform("turns", lambda t: turn_segments(t, template))))
    checked = grouped.unionByName(single).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), segments.alias("segments"),
        order_check(F.col("turns"), template).alias("check"),
    )
    return checked.select(
        "conv_id", "n_turns", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("check.bad").isNull() & F.col("check.state").isin(*template.ends)).alias("valid"),
        F.col("check.bad").alias("bad_turn"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    ends = "|".join(re.escape(s) for s in (*(t.suffix for t in template.turns.values()), template.role_marks[2]))
    body = F.substring(formatted, F.lit(len(template.begin) + 1), F.length(formatted))
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).*?(?:{ends})"), F.lit(0))

    def turn(piece: Column) -> Column:
        a, b, c = template.role_marks
        role = F.substring_index(F.substring(piece, F.lit(len(a) + 1), F.length(piece)), b, 1)
        text = F.substring(piece, F.length(role) + len(a) + len(b) + 1, F.length(piece) - F.length(role) - len(a) - len(b) - len(c))
        out = F.struct(unescaped(role, template).alias("role"), unescaped(text, template).alias("text"))
        for name, t in template.turns.items():
            inner = F.substring(piece, F.lit(len(t.prefix) + 1), F.length(piece) - len(t.prefix) - len(t.suffix))
            known = F.struct(F.lit(name).alias("role"), unescaped(inner, template).alias("text"))
            out = F.when(piece.endswith(t.suffix), known).otherwise(out)
        return out

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
