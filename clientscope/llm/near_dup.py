"""Near-duplicates: fast similarity sketches, banding, and exact verification of the linked documents' shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientscope.llm.common import map_texts, name, pick, restored, slotted, text_key, written
from clientscope.llm.components import components, forest

U = np.uint64
SKETCH = "row long, doc_id {id}, text_key string, n_shingles long, set_key binary, bands array<long>, marks binary"
#: Chance that a pair of the least similarity shares no band.
MISS = 1.3e-7


@dataclass(frozen=True)
class Near:
    """Shingle length, least similarity in percent, and the shape of the sketch.

    Bands of ``rows`` coordinates are as many as it takes for a pair of the least similarity to share none of them with
    a probability of 1.3e-7 (40 bands of 5 at 80 percent), unless both are given; its sketches agree in fewer coordinates
    than ``least_equal`` with about 3e-7. ``chunk`` bounds what one task holds of a band's bucket; larger buckets are
    first linked to ``pivots`` of their members.
    """

    words: int = 5
    percent: int = 80
    bands: int = 0
    rows: int = 0
    chunk: int = 512
    pivots: int = 4

    def __post_init__(self):
        if not 0 < self.percent <= 100:
            raise ValueError("percent must be above 0 and at most 100")
        s = min(self.percent / 100, 0.95)
        for rows in [self.rows] if self.rows else range(5, 0, -1):
            bands = self.bands or math.ceil(math.log(MISS) / math.log(1 - s**rows))
            if bands <= 128 or rows == 1 or self.rows:
                break
        object.__setattr__(self, "rows", rows)
        object.__setattr__(self, "bands", bands)

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        s = self.percent / 100
        return math.floor(self.size * s - 5 * math.sqrt(self.size * s * (1 - s)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are fixed values of a public generator)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: bytes | None, words: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, U)
    if len(known) > 1_000_000:
        known.clear()
    for t in set(tokens).difference(known):
        known[t] = xxhash.xxh64_intdigest(t)
    hashes = np.fromiter(map(known.__getitem__, tokens), U, len(tokens))
    n = min(words, len(hashes))
    last = len(hashes) - n + 1
    out = mixed(hashes[:last] + U(n))
    for j in range(1, n):
        out = mixed(out * U(0x9E3779B97F4A7C15) + hashes[j : last + j])
    return np.unique(out)


def similarity_sketch(items: np.ndarray, size: int) -> np.ndarray:
    """Coordinates of a fast similarity sketch (Dahlgaard, Knudsen and Thorup, 2017).

    In round i < size every item goes to a hashed bin with the value (i, hash); in round size + b all items go to bin b.
    A coordinate is the least value in its bin, so each one fills, mostly within a few rounds.
    """
    out = np.full(size, np.iinfo(U).max, U)
    at_once = max(1, math.ceil(6 * size / len(items)))
    for first in range(0, size, at_once):
        rounds = np.arange(first, min(size, first + at_once), dtype=U)
        h = mixed(items[None, :] ^ mixed(rounds + U(1))[:, None])
        bins = ((h >> U(32)) * U(size)) >> U(32)
        values = (rounds[:, None] << U(32)) | (h & U(0xFFFFFFFF))
        np.minimum.at(out, bins.ravel().astype(np.int64), values.ravel())
        if out.max() < np.iinfo(U).max:
            return out
    empty = np.flatnonzero(out == np.iinfo(U).max).astype(U)
    h = mixed(items[None, :] ^ mixed(empty + U(size + 1))[:, None]) & U(0xFFFFFFFF)
    out[empty.astype(np.int64)] = ((empty + U(size)) << U(32)) | h.min(axis=1)
    return out


def band_keys(sketch: np.ndarray, near: Near) -> np.ndarray:
    out = np.arange(1, near.bands + 1, dtype=U)
    for column in sketch.reshape(near.bands, near.rows).T:
        out = mixed(out * U(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def sketches(rows: DataFrame, near: Near) -> DataFrame:
    """One row per document: row number, id, text key, set size, set key, band keys and one byte of each coordinate."""
    known: dict[bytes, int] = {}

    def fn(texts: list[bytes | None]) -> dict[str, list]:
        made = {"n_shingles": [], "set_key": [], "bands": [], "marks": []}
        for t in texts:
            items = shingle_set(t, near.words, known)
            sketch = similarity_sketch(items, near.size) if len(items) else None
            made["n_shingles"].append(len(items))
            made["set_key"].append(xxhash.xxh128_digest(items.tobytes()))
            made["bands"].append(None if sketch is None else band_keys(sketch, near))
            made["marks"].append(None if sketch is None else (sketch & U(255)).astype(np.uint8).tobytes())
        return made

    return map_texts(rows, fn, SKETCH.format(id=rows.schema["doc_id"].dataType.simpleString()))


def sets_of(rows: DataFrame, near: Near) -> DataFrame:
    """node and items (the shingle set) of rows (node, text)."""
    known: dict[bytes, int] = {}

    def fn(texts: list[bytes | None]) -> dict[str, list]:
        return {"items": [shingle_set(t, near.words, known).tobytes() for t in texts]}

    return map_texts(rows, fn, "node long, items binary")


#: Bits of the filter that texts pass before a join: 512 bitmaps of 4 KB, whatever is wanted.
FILTER_BITS, BITMAP_BITS = 1 << 24, 1 << 15


def passing(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose text_key may be wanted. The filter has 2 MB; when it is full, more rows pass on to the exact join."""
    bit = F.pmod(F.xxhash64("text_key"), F.lit(FILTER_BITS))
    place = [F.expr(f"bit div {BITMAP_BITS}").alias("bitmap_no"), F.expr(f"bit % {BITMAP_BITS}").alias("at")]
    maps = wanted.select(bit.alias("bit")).select(*place).groupBy("bitmap_no").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    marked = rows.withColumn("bit", bit).select(*rows.columns, *place).join(F.broadcast(maps), "bitmap_no")
    byte = "cast(conv(hex(substring(bitmap, cast(at div 8 as int) + 1, 1)), 16, 10) as int)"
    return marked.where(f"(({byte} >> cast(at % 8 as int)) & 1) = 1").select(*rows.columns)


def enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two shingle sets are near enough."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


CELL = ("key", "band", "i", "j")


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell after another, from batches that are sorted by cell."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = [table.column(c).to_numpy() for c in CELL]
        new = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        starts = np.r_[0, np.flatnonzero(new) + 1]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(int(starts[-1]))
    if rest is not None and rest.num_rows:
        yield rest


#: Sides of a cell: all members of a small bucket; members still open in a large one, and those they have to meet.
WHOLE, OPEN, MET = range(3)


class Cell:
    """Members of a small bucket, or open members of a large one with a chunk of it, and the pairs that this cell has to judge."""

    def __init__(self, table: pa.Table, near: Near):
        self.near, self.n = near, table.num_rows
        self.node = table.column("node").to_numpy()
        self.label = table.column("label").to_numpy()
        self.sizes = table.column("n_shingles").to_numpy()
        self.side = table.column("side").to_numpy()
        self.met = np.flatnonzero(self.side == MET)
        self.marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(self.n, near.size)
        self.bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(self.n, near.bands)
        self.band = table.column("band")[0].as_py()

    def partners(self, at: int) -> np.ndarray:
        """Members that may be near this one, are not known to be connected, and share no earlier band, in whose cell the pair is judged."""
        if self.side[at] == MET:
            return self.met[:0]
        found = np.arange(at + 1, self.n) if self.side[at] == WHOLE else self.met
        sizes = self.sizes[found]
        ok = 100 * np.minimum(sizes, self.sizes[at]) >= self.near.percent * np.maximum(sizes, self.sizes[at])
        found = found[ok & (self.label[found] != self.label[at])]
        found = found[~(self.bands[found, : self.band] == self.bands[at, : self.band]).any(axis=1)]
        return found[(self.marks[found] == self.marks[at]).sum(axis=1) >= self.near.least_equal]


def sorted_cells(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def likely(memberships: DataFrame, near: Near) -> DataFrame:
    """The members of each cell that have at least one likely partner there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cells(batches):
            cell = Cell(table, near)
            hit = np.zeros(cell.n, bool)
            for at in range(cell.n):
                if len(found := cell.partners(at)):
                    hit[at] = hit[found] = True
            if hit.any():
                yield from table.filter(pa.array(hit)).select([*CELL, "side", "node", "label"]).to_batches()

    schema = "key long, band int, i int, j int, side int, node long, label long"
    return sorted_cells(memberships).mapInArrow(run, schema)


def confirmed(members: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) between members of a cell whose full sets are near enough.

    Pairs that earlier links already connect are passed over, so a cell returns fewer links than it has members and
    loses no connection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cells(batches):
            cell = Cell(table, near)
            sets = [np.frombuffer(s, U) for s in table.column("items").to_pylist()]
            pairs = [cell.partners(at) for at in range(cell.n)]
            degree = np.zeros(cell.n, np.int64)
            for at, found in enumerate(pairs):
                degree[at] += len(found)
                np.add.at(degree, found, 1)
            group = np.unique(cell.label, return_index=True, return_inverse=True)
            group = group[1][group[2]].tolist()

            def top(x: int, group=group) -> int:
                while group[x] != x:
                    group[x] = x = group[group[x]]
                return x

            links = []
            # Members with most partners first: they connect most of a group, and few pairs are left to compare.
            around: list[list[int]] = [[] for _ in range(cell.n)]
            for at, found in enumerate(pairs):
                for other in found.tolist():
                    around[other if (degree[other], -other) > (degree[at], -at) else at].append(at + other)
            for at in np.argsort(-degree, kind="stable").tolist():
                for both in around[at]:
                    other = both - at
                    if top(at) != top(other) and enough(sets[at], sets[other], near.percent):
                        group[top(at)] = top(other)
                        links.append((int(cell.node[at]), int(cell.node[other])))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return sorted_cells(members).mapInArrow(run, "a long, b long")


def near_pairs(pairs: DataFrame, heads: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) of nodes that are near enough: by size and sketch first, then by their full sets (node, items)."""
    one, other = (heads.select(F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("n_shingles", "marks")]) for n in "ab")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(f"marks_{n}").to_pylist()), np.uint8).reshape(-1, near.size) for n in "ab")
            yield batch.filter(pa.array((x == y).sum(axis=1) >= near.least_equal)).select(["a", "b"])

    sizes = [F.col("n_shingles_a"), F.col("n_shingles_b")]
    close = pairs.join(one, "a").join(other, "b").where(100 * F.least(*sizes) >= near.percent * F.greatest(*sizes))
    close = close.mapInArrow(alike, "a long, b long")
    one, other = (sets.select(F.col("node").alias(n), F.col("items").alias(f"items_{n}")) for n in "ab")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("items_a"), batch.column("items_b"), strict=True)
            ok = [enough(*(np.frombuffer(s.as_py(), U) for s in pair), near.percent) for pair in both]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return close.join(one, "a").join(other, "b").mapInArrow(hold, "a long, b long")


def with_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def nearest(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of the links is linked to, or itself; equal labels are connected."""
    both = links.select("a", "b").union(links.select("b", "a"))
    return both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))


def opened(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, and whether they lie outside the bucket's largest one."""
    known = written(with_labels(members, labels), "near-known")
    parts = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    most = parts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.max("n").alias("in_main"))
    most = most.where("parts > 1").select("key", "main", "all", (F.col("all") - F.col("in_main")).alias("n_open"))
    return known.join(most, "key").withColumn("open", F.col("label") != F.col("main"))


def pivot_links(members: DataFrame, heads: DataFrame, sets: Callable[[DataFrame], DataFrame], near: Near) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Links of the members of large buckets to some of them, the components that follow, and the members of buckets that are not yet one.

    In each round every bucket takes ``pivots`` of its open members, those with the least hashes of some of their part
    of the bucket, and all its members of other components are compared with them: so many pairs as members times
    pivots. Buckets that have become one component are done. Rounds end when the open members of each bucket fit into one
    chunk, so that comparing them with the whole bucket is linear, or when a round leaves over three quarters open.
    """
    spark = members.sparkSession
    links, labels = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, label long")
    members = written(members, "near-large")
    if members.isEmpty():
        return links, labels, None
    items = written(sets(members.select("node").distinct()), "near-sets")
    now, before, number = opened(members, labels), None, 0
    while True:
        number += 1
        lot = F.xxhash64("node", F.lit(number))
        pivots = now.where("open").groupBy("key", F.pmod(lot, F.lit(near.pivots)).alias("part")).agg(F.min_by(F.struct("node", "label"), lot).alias("p"))
        pivots = pivots.select("key", F.col("p.node").alias("b"), F.col("p.label").alias("other"))
        pairs = now.join(pivots, "key").where("label <> other").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        links = written(forest(links.union(near_pairs(pairs, heads, items, near))), "near-links")
        # In a tight group all members are linked to its least pivot; only looser ones need the whole components.
        for labels in (nearest(links), None):
            labels = written(components(links) if labels is None else labels, "near-labels")
            now = written(opened(members, labels), "near-open")
            left, largest = now.where("open").agg(F.count(F.lit(1)), F.max("n_open")).first()
            if not left or largest <= near.chunk:
                break
        if not left:
            return links, labels, None
        if largest <= near.chunk or before is not None and 4 * left > 3 * before:
            return links, labels, now
        before = left


def judged(docs: DataFrame, near: Near, id_col: str, text_col: str) -> DataFrame:
    """The rows of near_groups with the key of their text."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    # Row and class numbers are fixed once they are written; ids are carried along as they are and never computed with.
    numbered = rows.withColumns({"row": F.monotonically_increasing_id(), "text_key": text_key(F.col("text"))})
    made = written(sketches(numbered, near), "near-sketches")
    classes = made.where("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    heads = made.join(classes.select("row", "node"), "row").select("node", "text_key", "n_shingles", "bands", "marks")
    heads = written(heads, "near-heads")

    def sets(nodes: DataFrame) -> DataFrame:
        wanted = written(heads.select("node", "text_key").join(nodes, "node"), "near-wanted")
        texts = passing(rows.select("text", text_key(F.col("text")).alias("text_key")), wanted)
        return sets_of(texts.join(wanted, "text_key").select("node", "text"), near).dropDuplicates(["node"])

    keys = heads.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    placed = keys.join(buckets, "key")
    links, labels, rest = pivot_links(placed.where(F.col("members") > near.chunk).select("key", "band", "node"), heads, sets, near)
    zero = F.lit(0)
    dealt = with_labels(placed.where(F.col("members") <= near.chunk), labels).select(
        "key", "band", zero.alias("i"), zero.alias("j"), F.lit(WHOLE).alias("side"), "node", "label"
    )
    if rest is not None:
        lot = F.xxhash64("node")
        chunks = {c: F.ceil(F.col(n) / near.chunk).cast("int") for c, n in (("i", "n_open"), ("j", "all"))}
        place = {c: F.pmod(lot, n).cast("int").alias(c) for c, n in chunks.items()}
        spread = {c: F.explode(F.sequence(zero, n - 1)).alias(c) for c, n in chunks.items()}
        some = rest.where("open").select("key", "band", place["i"], spread["j"], F.lit(OPEN).alias("side"), "node", "label")
        all_ = rest.select("key", "band", spread["i"], place["j"], F.lit(MET).alias("side"), "node", "label")
        dealt = dealt.unionByName(some).unionByName(all_)
    shapes = heads.select("node", "n_shingles", "bands", "marks")
    members = written(likely(dealt.join(shapes, "node"), near), "near-members")
    full = members.join(shapes, "node").join(sets(members.select("node").distinct()), "node")
    labels = components(links.union(confirmed(full, near)))
    named = with_labels(classes.select("set_key", "node", "least_id"), labels)
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "label").select("set_key", "component_id")
    result = made.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select("doc_id", "text_key", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def near_groups(
    docs: DataFrame, near: Near = Near(), *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and kept.

    Words are runs of characters other than ASCII white space with A-Z folded. Documents are linked if 100 times the
    shingles they share is at least ``percent`` times the shingles of both; ``component_id`` is the least id that links
    reach, and ``kept`` says that it is the document's own.

    Documents with equal sets are one class, found by aggregation, so exact copies cost nothing further. Classes meet
    in buckets of equal bands. Members of a bucket of more than ``chunk`` classes are linked to verified pivots first,
    which makes one component of most groups in time linear in their size; what stays open is compared with the whole
    bucket, in cells of two chunks. A pair is judged in the first band it shares: first by its sketches, then, for the
    members that are left, by the full sets. No pair is returned except links that connect.

    Ids may have any type that can be ordered, and any value. Texts without words are linked with nothing. Every row is
    judged by its own text, so rows that repeat an id may be in two groups. A null id sorts above all others; a group
    without any id has a null component and its rows are kept. An empty table gives no rows. A very long text is handled
    alone, in memory in proportion to its words.
    """
    return judged(docs, near, id_col, text_col).drop("text_key")


def drop_near_copies(docs: DataFrame, near: Near = Near(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stand for their group, in the columns of the input: those that near_groups reports as kept.

    A row goes by its id and its text, so a copy without an id takes no other row without an id with it.
    """
    gone = judged(docs, near, id_col, text_col).where(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    plain, slots = slotted(docs)
    same = name(slots[id_col]).eqNullSafe(F.col("gone_id")) & (text_key(name(slots[text_col])) == F.col("gone_key"))
    return restored(plain.join(gone, same, "left_anti"), slots)
