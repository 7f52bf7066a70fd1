"""Correlations of very many columns: column tiles, tile pairs as keys, and only pairs above a threshold as rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientscope.operators.ranking import present
from clientscope.sources.sinks import stored

#: Columns of a tile, bytes of sums that one task holds, and tasks that sum up rows.
TILE, HELD_BYTES, TASKS = 128, 128 << 20, 64
FOUND = "i int, j int, r double"


def tile_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of two tiles (rows x columns, NaN where missing), for each pair over rows that have both: count, sums, sums of squares
    and the sum of products."""
    has_x, has_y = ((~np.isnan(v)).astype(float) for v in (x, y))
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    return np.stack([has_x.T @ has_y, x.T @ has_y, has_x.T @ y, (x * x).T @ has_y, has_x.T @ (y * y), x.T @ y])


def pearson(sums: np.ndarray) -> np.ndarray:
    """Coefficients from the sums of a pair of tiles; NaN where a column does not vary over the pair's rows."""
    n, sx, sy, qx, qy, xy = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        cov, spread = xy - sx * sy / n, (qx - sx * sx / n) * (qy - sy * sy / n)
        return np.where(spread > 0, cov / np.sqrt(spread), np.nan)


def correlations(df: DataFrame, cols: Sequence[str], threshold: float, tile: int = TILE, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Rows (i, j, r): column pairs i < j with abs(r) above the threshold, and for every column (i, -1, sum of all abs(r)).

    Each pair counts the rows that have both values, relative to the columns' means so that large values do not cancel.
    Columns are cut into tiles. A task sums the products of its rows for as many pairs of tiles as ``held_bytes`` allow,
    so that more columns mean more passes over the rows and not more memory. Sums meet by pair of tiles, where the
    coefficients are made and all pairs below the threshold end.
    """
    values = [F.when(present(c), F.col(c).cast("double")) for c in cols]
    means = df.agg(*[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"m{i}") for i, v in enumerate(values)]).first()
    flat = df.select(*[(v - F.lit(float(m))).alias(f"v{i}") for i, (v, m) in enumerate(zip(values, means, strict=True))])
    starts = list(range(0, len(cols), tile))
    pairs = [(a, b) for k, a in enumerate(starts) for b in starts[k:]]
    at_once = max(1, held_bytes // (6 * 8 * tile * tile))
    passes = [pairs[k : k + at_once] for k in range(0, len(pairs), at_once)]
    if len(passes) > 1:
        flat = stored(flat, "centred")
    out = None
    for some in passes:
        found = one_pass(flat, some, tile, len(cols), threshold)
        out = found if out is None else out.unionByName(found)
    sums = out.where("j < 0").groupBy("i").agg(F.sum("r").alias("r"))
    return out.where("j >= 0").unionByName(sums.select("i", F.lit(-1).alias("j"), "r"))


def one_pass(flat: DataFrame, pairs: Sequence[tuple[int, int]], tile: int, width: int, threshold: float) -> DataFrame:
    read = sorted({c for pair in pairs for start in pair for c in range(start, min(width, start + tile))})
    place = {c: k for k, c in enumerate(read)}

    def part(x: np.ndarray, start: int) -> np.ndarray:
        return x[:, place[start] : place[min(width, start + tile) - 1] + 1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            for a, b in pairs:
                s = tile_sums(part(x, a), part(x, b))
                total[a, b] = total[a, b] + s if (a, b) in total else s
        for (a, b), s in total.items():
            yield pa.RecordBatch.from_pydict({"a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()), "sums": [s.tobytes()]})

    def coefficients(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key)
        shape = (6, min(tile, width - a), min(tile, width - b))
        total = np.zeros(shape)
        for s in sorted(x.as_py() for x in table.column("sums")):  # one order, so that reruns agree
            total += np.frombuffer(s).reshape(shape)
        r = pearson(total)
        size = np.nan_to_num(abs(r))
        i, j = np.nonzero((size > threshold) & (np.arange(shape[1])[:, None] + a < np.arange(shape[2]) + b))
        rows = [(i + a, j + b, r[i, j]), (np.arange(shape[1]) + a, np.full(shape[1], -1), size.sum(axis=1))]
        if a != b:
            rows.append((np.arange(shape[2]) + b, np.full(shape[2], -1), size.sum(axis=0)))
        i, j, r = (np.concatenate(c) for c in zip(*rows, strict=True))
        return pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "r": pa.array(r, pa.float64())})

    rows = flat.select(*[f"v{c}" for c in read]).coalesce(TASKS).mapInArrow(sums, "a int, b int, sums binary")
    return rows.groupBy("a", "b").applyInArrow(coefficients, FOUND)


def kept_greedy(width: int, pairs: Sequence[tuple[int, int]]) -> list[int]:
    """Columns that correlate with no column kept before them."""
    against: dict[int, list[int]] = {}
    for i, j in pairs:
        against.setdefault(j, []).append(i)
    kept: set[int] = set()
    for c in range(width):
        if not kept.intersection(against.get(c, ())):
            kept.add(c)
    return sorted(kept)


def kept_of_groups(width: int, pairs: Sequence[tuple[int, int]], weight: Sequence[float]) -> list[int]:
    """Of every group of linked columns the one with the largest weight, the first of equal ones."""
    group = list(range(width))

    def top(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for i, j in pairs:
        a, b = top(i), top(j)
        group[max(a, b)] = min(a, b)
    best: dict[int, int] = {}
    for c in range(width):
        g = top(c)
        if g not in best or weight[c] > weight[best[g]]:
            best[g] = c
    return sorted(best.values())
