"""Line-first cleaning: rules are judged per line, failing lines go, then documents that lost too much text go."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientscope.llm.common import ddl, map_texts, pick, restored, slotted

# Fixed values of the line rules.
END_MARKS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "»", ")", "。", "！", "？")
SEPARATORS = ("|", "»", "›", "•")
BOILERPLATE = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript",
    "click here", "read more", "sign in", "sign up", "log in", "subscribe", "share this", "back to top",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; see ``judge_lines`` for what each one decides."""

    unended_words: int = 10  # a line without an end mark fails below so many words
    marked_percent: int = 20  # share of words that carry a run of marks
    separators: int = 3
    boilerplate_words: int = 30
    lost_percent: int = 30  # of the words' characters
    least_words: int = 50
    repeat_percent: int = 50


RUN = re.compile(rb"[!?#*$%&<>]{2,}")
SEPARATOR = re.compile("|".join(map(re.escape, SEPARATORS)).encode())
PHRASE = re.compile("|".join(BOILERPLATE).encode())
ENDS = tuple(m.encode() for m in END_MARKS)
SYMBOLS = re.compile(rb"[#*$%&|<>]")
CONTINUATION = bytes(range(0x80, 0xC0))
BLANKS = b" \t\n\x0b\x0c\r"


def points(data: bytes) -> int:
    """Code points outside ASCII white space."""
    return len(data.translate(None, CONTINUATION + BLANKS))


def line_fails(line: bytes, words: int, rules: LineRules) -> bool:
    """Whether a line with words breaks the punctuation, navigation or boilerplate rule."""
    bare = line.strip()
    if words < rules.unended_words and not bare.endswith(ENDS):
        return True
    if 100 * len(RUN.findall(bare)) > rules.marked_percent * words:
        return True
    if len(SEPARATOR.findall(bare)) >= rules.separators:
        return True
    return words <= rules.boilerplate_words and PHRASE.search(bare.lower()) is not None


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs at least twice in the text."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    base = len(codes)
    pair = ids[:-1] * base + ids[1:]
    if base > 2_000_000:  # three codes no longer fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * base + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(window)] |= twice
    return int(covered.sum())


def judge(text: bytes | None, rules: LineRules) -> dict:
    text = text or b""
    words = text.split()
    seen: set[bytes] = set()
    kept, failed, lost, duplicates = [], 0, 0, 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            duplicates += line in seen
            seen.add(line)
            if line_fails(line, n, rules):
                failed += 1
                lost += points(line)
                continue
        kept.append(line)
    total, repeated = points(text), repeated_words(words)
    base = len(words) < rules.least_words or 100 * repeated > rules.repeat_percent * len(words)
    return {
        "n_words": len(words),
        "word_chars": total,
        "n_symbols": len(SYMBOLS.findall(text)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated,
        "n_lines_removed": failed,
        "lost_chars": lost,
        "base_failed": base,
        "kept": not base and 100 * lost <= rules.lost_percent * total,
        "clean_text": b"\n".join(kept).decode(),
    }


def verdicts(texts: list[bytes | None], rules: LineRules) -> dict[str, list]:
    made = [judge(t, rules) for t in texts]
    return {k: [m[k] for m in made] for k in made[0]}


COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines_removed long, "
    "lost_chars long, base_failed boolean, kept boolean"
)


def judge_lines(
    docs: DataFrame, rules: LineRules = LineRules(), *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per input row: counts, verdict and, with ``with_text``, the cleaned text.

    A line fails if it is short and has no end mark or if many of its words carry runs of marks (punctuation), if it
    has several separators (navigation), or if it is short and holds a stock phrase (boilerplate). Lines without words
    stay. A document is kept unless the base rule fails or the failed lines hold too many of its characters. It runs
    in one pass without a shuffle. Null or empty texts have no words, so the base rule fails; null ids, ties and
    repeated rows are judged row by row; other columns are ignored. An empty table gives no rows; a very long text is
    handled alone, in memory in proportion to its length.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    return map_texts(rows, lambda texts: verdicts(texts, rules), f"{ddl(rows, 'doc_id')}, {COUNTS}" + ", clean_text string" * with_text)


def clean(docs: DataFrame, rules: LineRules = LineRules(), *, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of the input.

    ``chars_col`` names a column to be set to the new length. Null texts go with the rejected documents.
    """
    plain, slots = slotted(docs)
    at = slots[text_col]
    made = map_texts(plain, lambda texts: verdicts(texts, rules), f"{ddl(plain, *plain.columns)}, kept boolean, clean_text string", at)
    new = {text_col: F.col("clean_text")} | ({chars_col: F.length("clean_text")} if chars_col else {})
    return restored(made.where("kept"), slots, **new)
