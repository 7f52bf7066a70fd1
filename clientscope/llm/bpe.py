"""BPE encoding by speculation: greedy longest match, a vectorised check of adjacent tokens, exact merging where it fails."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable
from functools import cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from clientscope.llm.common import map_texts, pick

I = np.int64
NEVER = np.iinfo(I).max
#: Words whose tokens a task remembers, and the longest one (in characters) that it does remember.
KNOWN_WORDS, KNOWN_CHARS = 400_000, 64
#: Characters outside these ranges may be letters to one Unicode version and unknown to another.
UNUSUAL = regex.compile(r"[^\x00-\u052F\u1E00-\u206F\u20A0-\u20BF\u2100-\u218B\u2190-\u23FF\u2500-\u2BFF\u3000-\u312E\u4E00-\u9FA5\uAC00-\uD7A3\uFF00-\uFFEF\U0001F300-\U0001F64F]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable and no blank, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """A vocabulary's merges: every token's two parts, the merge's rank, and what meets at both ends of a token on the way."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        size = max(vocab.values()) + 1
        self.text = [""] * size
        for t, i in vocab.items():
            self.text[i] = t
        left, right, made = (np.array([vocab[t] for t in side], I) for side in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        self.ranks = {pair: r for r, pair in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        self.made = made.tolist()
        order = np.argsort(left << I(32) | right)
        self.pairs, self.pair_rank = (left << I(32) | right)[order], order
        #: Rank of the merge that makes a token, -1 for single letters; and its parts.
        self.rank, self.left, self.right = np.full(size, -1, I), np.arange(size), np.arange(size)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(merges)), left, right
        # Tokens may be looked at one by one only if merges run in the order of their ranks: one merge for each token, after its parts'.
        self.ordered = len(set(made.tolist())) == len(merges) and bool(
            (np.maximum(self.rank[left], self.rank[right]) < np.arange(len(merges))).all()
        )
        # A token is proposed only if merging its own letters ends in it; the parts of one that does not are no proposal either.
        letters = {t: i for t, i in vocab.items() if self.rank[i] >= 0 or len(t.removesuffix(end) or t) == 1}
        if self.ordered:
            inner = ~self.clash(self.left, self.right, within=self.rank)
            for r in range(len(merges)):
                inner[made[r]] &= inner[left[r]] and inner[right[r]]
            letters = {t: i for t, i in letters.items() if inner[i]}
        self.longest = max((len(t.removesuffix(end)) for t in letters), default=1)
        self.inside = {t: i for t, i in letters.items() if not t.endswith(end)}
        self.final = {t.removesuffix(end): i for t, i in letters.items() if t.endswith(end)} if end else self.inside

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << I(32) | b
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.pair_rank[at], NEVER)

    def clash(self, a: np.ndarray, b: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        """True where a merge would run across the border of tokens a and b before both are complete.

        While a is built, its last part grows step by step, and so does the first part of b. Two of these parts meet as
        long as neither has been merged into the next. From the finished tokens back, the part made last is taken apart,
        and a clash is a merge of the two that comes before the merges which use them up; of equal merges the left one
        runs first. ``within`` has the rank of the merge that is allowed to join a and b in the end.
        """
        bad, at = np.zeros(len(a), bool), np.arange(len(a))
        x, y = a.astype(I), b.astype(I)
        x_used = y_used = np.full(len(a), NEVER) if within is None else within
        while len(at):
            r = self.rank_of(x, y)
            hit = (r < x_used) & (r < y_used) | (r == y_used) & (r < x_used) & (r < NEVER)
            if within is not None:
                hit &= r != within[at]
            bad[at[hit]] = True
            last_x = self.rank[x] > self.rank[y]
            on = ~hit & (np.maximum(self.rank[x], self.rank[y]) >= 0)
            # Equal ranks are equal tokens; then the right one's parts come second, so it is taken apart first.
            x_used, y_used = np.where(last_x, self.rank[x], x_used)[on], np.where(last_x, y_used, self.rank[y])[on]
            x, y = np.where(last_x, self.right[x], x)[on], np.where(last_x, y, self.left[y])[on]
            at = at[on]
        return bad

    def greedy(self, word: str) -> list[int] | None:
        """The longest token at each place in turn; None if no token fits."""
        out, at, n = [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                found = (self.final if end == n else self.inside).get(word[at:end])
                if found is not None:
                    out.append(found)
                    at = end
                    break
            else:
                return None
        return out

    def exact(self, word: str) -> list[int]:
        """Merges in the order of rank, then place, from the letters on; unknown letters are left out."""
        letters = [*word[:-1], word[-1] + self.end]
        ids = [self.vocab[t] for t in letters if t in self.vocab]
        return self.merged_far(ids) if len(ids) > 64 else self.merged(ids)

    def merged(self, ids: list[int]) -> list[int]:
        """For short words: the least rank of all neighbours, again and again."""
        rank = self.ranks.get
        ranks = [rank(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), NEVER)
        return ids

    def merged_far(self, ids: list[int]) -> list[int]:
        """For long words: neighbours in a queue, with those that have changed since passed over."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [(self.ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (p := (ids[k], ids[after[k]])) in self.ranks:
                    heapq.heappush(queue, (self.ranks[p], k, *p))
        return [i for i in ids if i >= 0]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word: the proposals that hold, and exact merges of the others."""
        proposed = [self.greedy(w) if self.ordered else None for w in words]
        sizes = np.fromiter((len(p or ()) for p in proposed), I, len(words))
        tokens = np.fromiter(chain.from_iterable(p or () for p in proposed), I, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        near = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, I)
        both, which = np.unique(tokens[near] << I(32) | tokens[near + 1], return_inverse=True)
        failing = {*word[near[self.clash(both >> I(32), both & I(0xFFFFFFFF))[which]]].tolist()}
        return [self.exact(w) if p is None or i in failing else p for i, (w, p) in enumerate(zip(words, proposed, strict=True))]


class Codec:
    """Encoder and decoder of a tokenizer file: special tokens, normaliser, word pattern, byte letters and merges.

    The file's own normaliser is used, since its Unicode tables decide; words are cut by the file's pattern, in texts of
    unusual characters with the library's tables. Files with anything else than an inverted split into words, byte
    letters and plain merges are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, steps = made["model"], (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = [s["type"] for s in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        plain = plain and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and model["type"] == "BPE" and made["decoder"] is None
        if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")):
            raise ValueError(f"{path} is no file of words, byte letters and plain merges")
        self.normalizer = Tokenizer.from_file(path).normalizer
        steps_of = [(n["type"], n.get("pattern"), n.get("content")) for n in (made["normalizer"] or {}).get("normalizers", [])]
        # White space never gets into a word, so folding is all that such a normaliser does to a composed text.
        self.folds = steps_of == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.split = pre_tokenizers.Split(Regex(steps[0]["pattern"]["Regex"]), "removed", invert=True)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model["end_of_word_suffix"] or "")
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.text = dict(enumerate(self.merges.text)) | {i: t for t, i in self.special.items()}
        self.known: dict[str, tuple[bytes, str]] = {}

    def normal(self, text: str) -> str:
        """The normalised text, up to white space; lower() is right for usual letters but for the sigma that ends a word."""
        if self.folds and not UNUSUAL.search(text) and is_normalized("NFC", text):
            return text.replace("\u03a3", "\u03c3").lower()
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def words(self, text: str) -> list[str]:
        """The words and special tokens of a text, in order; a special token's name starts with a blank, which no word does."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(f" {part}")
            elif part:
                part = self.normal(part)
                out += [w for w, _ in self.split.pre_tokenize_str(part)] if UNUSUAL.search(part) else self.pattern.findall(part)
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Token ids as little-endian 32-bit integers, and token texts joined by blanks, of words not yet known."""
        fresh = [w for w in words if w not in self.known]
        plain = [w for w in fresh if not w.startswith(" ")]
        self.known.update((w, (np.uint32(self.special[w[1:]]).tobytes(), w[1:])) for w in fresh if w.startswith(" "))
        lettered = ["".join([self.letters[b] for b in w.encode()]) for w in plain]
        for w, ids in zip(plain, self.merges.encode(lettered), strict=True):
            self.known[w] = (np.array(ids, "<u4").tobytes(), " ".join([self.text[i] for i in ids]))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        cut = [self.words(t) for t in texts]
        words = set(chain.from_iterable(cut))
        self.learn(words)
        out = []
        for ws in cut:
            ids, decoded = zip(*map(self.known.__getitem__, ws), strict=True) if ws else ((), ())
            out.append((b"".join(ids), " ".join(decoded if all(decoded) else filter(None, decoded))))
        for w in words:
            if len(w) > KNOWN_CHARS:
                del self.known[w]
        return out


@cache
def codec(path: str) -> Codec:
    """One codec for each file and process."""
    return Codec(path)


def token_texts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded text.

    ``path`` names a tokenizer file that every executor has. The ids are those of the tokenizers library without added
    special tokens; special tokens that a text spells out count as such. Decoding joins the tokens' texts by blanks, as
    files without a decoder do. Longest matches propose the tokens of each distinct word, all adjacent pairs are checked
    at once, and only words with a pair that cannot stand are merged step by step. A file whose merges are out of order
    has all of its words merged so.

    Texts are handled in slices bounded in rows and bytes, and a task remembers a bounded number of words. Null and
    empty texts have no tokens; ids may be null or repeated, and further columns are ignored.
    """

    def fn(texts: list[bytes | None]) -> dict[str, list]:
        made = codec(path).encode([(t or b"").decode() for t in texts])
        return {"n_tokens": [len(i) // 4 for i, _ in made], "ids": [i for i, _ in made], "decoded": [d for _, d in made]}

    return mapped(docs, fn, "n_tokens bigint, ids binary, decoded string", id_col, text_col)


def mapped(docs: DataFrame, fn: Callable, schema: str, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, doc_id=id_col, text=text_col)
    return map_texts(rows, fn, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    return tokens.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )
