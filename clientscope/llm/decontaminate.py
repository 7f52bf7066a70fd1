"""Benchmark decontamination: suffix arrays over shards of the corpus, searched with every suffix of the test items."""

from __future__ import annotations

import contextlib
import math
import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.llm.common import ddl, map_texts, name, pick, restored, slotted, written

#: Bytes to words: A-Z folded, all other ASCII outside letters and digits made blank.
TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
FOUND = "n_words long, hit_words array<int>, matches array<struct<item_id:string,words:int,at:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


@dataclass
class Block:
    """A bounded block of test items, ready for search: one sequence of word numbers, items set apart by 0."""

    width: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)

    def build(self, texts: list[list[bytes]]) -> Block:
        number = self.vocabulary
        for w in chain.from_iterable(texts):
            number.setdefault(w, len(number) + 1)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.sequence = np.array([0, *chain.from_iterable([*map(number.get, t), 0] for t in texts)], np.int64)
        first = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        widths = np.minimum(lengths, self.width)
        self.ranks: dict[int, np.ndarray] = {}  # keys of the n-grams that occur here, by n, in order
        self.suffixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        spans = {1: self.sequence}
        for w in sorted(set(widths.tolist()) - {0}):
            self.double(spans, w)
            mine = np.flatnonzero(widths == w)
            n = lengths[mine] - w + 1
            item = np.repeat(mine, n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rank = self.rank(spans, w, first[item] + offset)
            order = np.argsort(rank, kind="stable")
            self.suffixes[w] = rank[order], item[order], offset[order]
        return self

    def double(self, spans: dict[int, np.ndarray], width: int) -> None:
        """Name the n-grams for n = 2, 4, 8 ... up to the width; the names keep the order of the words."""
        n = 1
        while 2 * n <= width:
            if 2 * n not in spans:
                key = self.pair(spans[n], n)
                if 2 * n not in self.ranks:
                    self.ranks[2 * n] = np.unique(key[key > 0])
                spans[2 * n] = self.named(key, self.ranks[2 * n])
            n *= 2

    def pair(self, names: np.ndarray, shift: int) -> np.ndarray:
        """Keys of two names that stand ``shift`` apart; 0 where one of them is missing."""
        key = np.zeros(len(names), np.int64)
        if len(names) > shift:
            a, b = names[:-shift], names[shift:]
            key[:-shift] = np.where((a > 0) & (b > 0), a * (len(self.sequence) + 1) + b, 0)
        return key

    @staticmethod
    def named(key: np.ndarray, known: np.ndarray) -> np.ndarray:
        """1 and up for known keys, else 0; only keys above 0 are looked up."""
        out = np.zeros(len(key), np.int64)
        at = np.flatnonzero(key)
        if len(at) and len(known):
            place = np.minimum(np.searchsorted(known, key[at]), len(known) - 1)
            out[at] = np.where(known[place] == key[at], place + 1, 0)
        return out

    def rank(self, spans: dict[int, np.ndarray], width: int, at: np.ndarray | None = None) -> np.ndarray:
        """Order-keeping key of the ``width`` words from each position; 0 if they can't occur in the items."""
        n = 1 << (width.bit_length() - 1)
        key = spans[n] if n == width else self.pair(spans[n], width - n)
        return key if at is None else key[at]

    def search(self, docs: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, list[tuple[str, int, int]]]]:
        """Per document of the shard: number of words, positions of hit words, and the longest match with each item."""
        lengths = np.array([len(d) for d in docs], np.int64)
        first = np.cumsum(lengths + 1) - lengths - 1
        get = self.vocabulary.get
        corpus = np.fromiter(chain.from_iterable(chain((get(w, 0) for w in d), (0,)) for d in docs), np.int64, int(lengths.sum()) + len(docs))
        edges = np.zeros(len(corpus) + 1, np.int64)
        spans, best = {1: corpus}, {}
        for w, (test_rank, item, offset) in self.suffixes.items():
            self.double(spans, w)
            rank = self.rank(spans, w)
            # The shard's suffix array, sorted to the depth of the window; suffixes that no item can match are left out.
            suffix = np.flatnonzero(rank)
            suffix = suffix[np.argsort(rank[suffix], kind="stable")]
            low = np.searchsorted(rank[suffix], test_rank, "left")
            high = np.searchsorted(rank[suffix], test_rank, "right")
            n = high - low
            test = np.repeat(np.arange(len(test_rank)), n)
            at = suffix[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            edges += np.bincount(at, minlength=len(edges)) - np.bincount(at + w, minlength=len(edges))
            self.longest(best, at, item[test], offset[test], w, first)
        covered = np.cumsum(edges) > 0
        for d, (start, n) in enumerate(zip(first.tolist(), lengths.tolist(), strict=True)):
            hits = np.flatnonzero(covered[start : start + n]).astype(np.int32)
            yield n, hits, [(self.items[i], words, at) for i, (words, at) in sorted(best.get(d, {}).items())]

    @staticmethod
    def longest(best: dict, at: np.ndarray, item: np.ndarray, offset: np.ndarray, width: int, first: np.ndarray) -> None:
        """Matches that follow each other in the document and in the item are parts of one longer match."""
        if not len(at):
            return
        order = np.lexsort((at, at - offset, item))
        at, item, shift = at[order], item[order], (at - offset)[order]
        new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(shift) != 0) | (np.diff(item) != 0)])
        run = np.diff(np.r_[new, len(at)]) + width - 1
        doc = np.searchsorted(first, at[new], "right") - 1
        for d, i, words, place in zip(doc.tolist(), item[new].tolist(), run.tolist(), (at[new] - first[doc]).tolist(), strict=True):
            known = best.setdefault(d, {}).get(i)
            if known is None or (-words, place) < (-known[0], known[1]):
                best[d][i] = words, place


#: Blocks that a worker holds ready for search at one time; with more, each slice of documents unpacks them one after another.
HELD_BLOCKS = 2
_held: OrderedDict[str, Block] = OrderedDict()


def blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, block_words: int) -> DataFrame:
    """The test items in blocks of at most ``block_words`` words (or one longer item), each packed and sorted by a task."""
    rows = benchmark.select(F.coalesce(name(item_col).cast("string"), F.lit("")).alias("item"), name(text_col).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[str] = []
        texts: list[list[bytes]] = []
        n = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(Block(width, items=items).build(texts))], pa.large_binary())})

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words = words_of(text.as_py())
                if not words:
                    continue
                if n and n + len(words) > block_words:
                    yield block()
                    items, texts, n = [], [], 0
                items.append(item)
                texts.append(words)
                n += len(words)
        if n:
            yield block()

    # About six characters a word: as many tasks as blocks, so that small files do not end in small blocks.
    return written(rows.coalesce(max(1, math.ceil(chars / (6 * block_words)))).mapInArrow(pack, "block binary"), "item-blocks")


def loaded(number: str, sent: Broadcast) -> Block:
    if number not in _held:
        _held[number] = pickle.loads(sent.value)
        with contextlib.suppress(AttributeError):
            del sent._value  # the bytes are on the executor's disk and need not stay in the worker too
        while len(_held) > HELD_BLOCKS:
            _held.popitem(last=False)
    _held.move_to_end(number)
    return _held[number]


def search(
    rows: DataFrame, benchmark: DataFrame, text_col: str, *, item_col: str, item_text_col: str, width: int, block_words: int
) -> DataFrame:
    """The rows with the columns of FOUND, in one pass: every slice of documents meets one block of items after another.

    Blocks go to the tasks as broadcasts, one at a time through the driver, which holds and reads none of them.
    """
    spark = rows.sparkSession
    made = blocks(benchmark, item_col, item_text_col, width, block_words)
    sent = {uuid.uuid4().hex: spark.sparkContext.broadcast(bytes(r.block)) for r in made.toLocalIterator()}

    def fn(texts: list[bytes | None]) -> dict[str, list]:
        docs = [words_of(t) for t in texts]
        hits: list[np.ndarray] = [np.zeros(0, np.int32)] * len(docs)
        best: list[dict[str, tuple[int, int]]] = [{} for _ in docs]
        for number, data in sent.items():
            for d, (_, more, matches) in enumerate(loaded(number, data).search(docs)):
                if len(more):
                    hits[d] = np.union1d(hits[d], more) if len(hits[d]) else more
                for item, words, at in matches:
                    known = best[d].get(item)
                    if known is None or (-words, at) < (-known[0], known[1]):
                        best[d][item] = words, at
        return {
            "n_words": [len(d) for d in docs],
            "hit_words": hits,
            "matches": [[{"item_id": i, "words": w, "at": a} for i, (w, a) in sorted(b.items())] for b in best],
        }

    return map_texts(rows, fn, f"{ddl(rows, *rows.columns)}, {FOUND}", text_col)


def item_digest(matches: Column) -> tuple[Column, Column]:
    """Number and digest of the items with a match."""
    items = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))
    return F.size(items).cast("bigint"), F.sha2(F.array_join(items, ","), 256)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_words: int = 1_000_000,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, matches and contaminated.

    A window is ``width`` consecutive words of an item; a shorter item that has words is one window. A document word is
    hit if it lies in an occurrence of a window. ``matches`` has the longest verbatim match with each item: its length
    in words and its place in the document. Every slice of documents is a shard with its own suffix array, which is
    looked up by bisection with every suffix of the test items that has ranks there: a suffix of a document takes part as
    far as its words, pairs, fours and eights occur in the items. Nothing is shuffled. Tasks build blocks of ``block_words``
    words from the items, and all blocks are searched in the one pass over the documents.

    Null or empty texts have no words; null ids, ties and repeated rows are judged row by row; items that share an id
    count once, with their longest match, and a null item id is the empty string; without items nothing is contaminated.
    An empty table gives no rows; a very long text is a shard of its own, in memory in proportion to its length.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    found = search(rows, benchmark, "text", item_col=item_col, item_text_col=item_text_col, width=width, block_words=block_words)
    n_items, digest = item_digest(F.col("matches"))
    n_hit = F.size("hit_words").cast("bigint")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), digest.alias("items_sha256"), "matches",
        (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 10, block_words: int = 1_000_000,
) -> DataFrame:
    """The documents without any hit word, in the columns of the input."""
    plain, slots = slotted(docs)
    found = search(
        plain, benchmark, slots[text_col], item_col=item_col, item_text_col=item_text_col, width=width, block_words=block_words
    )
    return restored(found.where(F.size("hit_words") == 0), slots)
