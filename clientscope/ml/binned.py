"""Binned training matrix: features quantised once to bytes and kept by column in blocks of rows, for many fits.

A block is one row of a table in the shared folder: labels, part numbers and keys of its rows, and one byte per feature
and row, feature after feature. A fit reads only blocks; which rows train and which validate is told by part number.
While fits grow, executors keep the blocks in memory, so that a level of a tree costs a small job and no scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from clientscope.operators.ranking import present
from clientscope.sources.sinks import stored

#: Rows of one block at most.
BLOCK_ROWS = 4096
#: Rows of joined blocks and values by (class, row) in them: small blocks become slabs of so many, so that a task makes few calls.
SLAB_ROWS, SLAB_VALUES = 32768, 1 << 19


def borders(df: DataFrame, features: Sequence[str], bins: int = 64) -> list[list[float]]:
    """Increasing inner borders of each feature, at most ``bins`` - 2 of them, from quantiles over all rows.

    One aggregation for all features. Value bins are numbered from 1; bin 0 is for null and NaN.
    """
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    values = [F.when(present(f), F.col(f).cast("double")) for f in features]
    found = df.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"q{i}") for i, v in enumerate(values)]).first()
    return [sorted(set(q or ())) for q in found]


def bin_numbers(x: np.ndarray, border: Sequence[float]) -> np.ndarray:
    """Bytes: 0 for missing, else 1 and the number of borders below the value."""
    out = np.searchsorted(np.asarray(border, float), x, side="left") + 1
    return np.where(np.isnan(x), 0, out).astype(np.uint8)


def to_floats(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).astype(float)


@dataclass(frozen=True)
class Slab:
    """Blocks side by side: a key of their own, class and part number of each row, and bins by (feature, row)."""

    key: tuple[int, int]
    y: np.ndarray
    p: np.ndarray
    bins: np.ndarray


def joined_blocks(blocks: Iterable[Row], groups: int, rows: int = SLAB_ROWS) -> Iterator[Slab]:
    """Slabs of up to so many rows; the key holds the number of row groups, since it decides which blocks meet."""
    held: list[Row] = []

    def slab() -> Slab:
        y, p = (np.frombuffer(b"".join(bytes(b[c]) for b in held), np.uint8) for c in "yp")
        return Slab((groups, held[0]["block"]), y, p, np.concatenate([np.frombuffer(bytes(b["bins"]), np.uint8).reshape(-1, b["n"]) for b in held], axis=1))

    for b in blocks:
        if held and sum(x["n"] for x in held) + b["n"] > rows:
            yield slab()
            held = []
        held.append(b)
    if held:
        yield slab()


@dataclass(frozen=True)
class Matrix:
    """A binned matrix: its table, features, borders, classes in order, and row counts by (part, class number)."""

    table: DataFrame
    features: tuple[str, ...]
    borders: tuple[tuple[float, ...], ...]
    classes: tuple
    parts: tuple[str, ...]
    counts: dict[tuple[int, int], int]
    uid: str
    kept: dict[int, RDD] = field(default_factory=dict, init=False, compare=False, repr=False)

    @property
    def bins(self) -> int:
        return max(map(len, self.borders), default=0) + 2

    def rows(self, part: str) -> int:
        return sum(n for (p, _), n in self.counts.items() if self.parts[p] == part)

    def slabs(self, groups: int) -> RDD:
        """The rows in so many groups, a partition each. The last division asked for stays with the executors, in memory or
        on their disks; what a lost executor held is read again from the table."""
        if groups not in self.kept:
            for old in self.kept.values():
                old.unpersist()
            self.kept.clear()
            blocks = self.table.select("block", "n", "y", "p", "bins")
            rows = (blocks.coalesce(1) if groups == 1 else blocks.repartition(groups)).rdd
            joined = min(SLAB_ROWS, SLAB_VALUES // max(1, len(self.classes)))
            self.kept[groups] = rows.mapPartitions(lambda part: joined_blocks(part, groups, joined)).persist(StorageLevel.MEMORY_AND_DISK)
        return self.kept[groups]


def build_matrix(df: DataFrame, features: Sequence[str], label: str, part: str = "part", fit_part: str | None = "train", bins: int = 64) -> Matrix:
    """The matrix of all rows of ``df``. Borders come from the rows of ``fit_part``, or from all rows if it is None.

    Driver data: borders, the distinct classes (256 at most) and parts, and a count for each pair of them. A null label
    is an error. One aggregation for the borders, one for the counts, one pass that writes the blocks.
    """
    if not 3 <= bins <= 256:
        raise ValueError("bins must be from 3 to 256")
    cut = borders(df if fit_part is None else df.where(F.col(part) == fit_part), features, bins)
    sizes = df.groupBy(F.col(part).alias("p"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    if any(r.y is None or r.p is None for r in sizes):
        raise ValueError("every row needs a label and a part")
    classes, parts = sorted({r.y for r in sizes}), sorted({r.p for r in sizes})
    if len(classes) > 256 or len(parts) > 256:
        raise ValueError("at most 256 classes and parts")

    def code(col: str, values: list):
        return F.array_position(F.array(*[F.lit(v) for v in values]).cast(f"array<{df.schema[col].dataType.simpleString()}>"), F.col(col)).cast("int") - 1

    flat = df.select(code(label, classes).alias("y"), code(part, parts).alias("p"), *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(features)])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(start, BLOCK_ROWS)
                y, p = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() for c in "yp")
                values = b"".join(bin_numbers(to_floats(rows.column(f"v{i}")), b).tobytes() for i, b in enumerate(cut))
                yield pa.RecordBatch.from_pydict({"n": [rows.num_rows], "y": [y], "p": [p], "bins": [values]})

    table = stored(flat.mapInArrow(blocks, "n long, y binary, p binary, bins binary").withColumn("block", F.monotonically_increasing_id()), "binned")
    counts = {(parts.index(r.p), classes.index(r.y)): r.n for r in sizes}
    return Matrix(table, tuple(features), tuple(map(tuple, cut)), tuple(classes), tuple(parts), counts, uuid.uuid4().hex)
