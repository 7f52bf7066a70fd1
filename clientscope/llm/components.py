"""Connected components of a link table by alternating star steps, each one an aggregation and a join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientscope.llm.common import written


def star(links: DataFrame, large: bool) -> DataFrame:
    """Point the larger (or the smaller) neighbours of every node at the least node around it."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("other")).select("a", F.least("a", "other").alias("least"))
    near = both.join(least, "a")
    if large:
        moved = near.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = near.where("b < a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.union(least.where("least < a").select("a", F.col("least").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


#: Links that a task joins up at one time.
AT_ONCE = 500_000


def forest(links: DataFrame) -> DataFrame:
    """The links (a, b) of each task joined up: every node of a stretch of links points at the least node it can reach there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        def stars() -> pa.RecordBatch:
            made = [(x, r) for x in list(above) if (r := top(x)) != x]
            above.clear()
            return pa.RecordBatch.from_arrays([pa.array([side[k] for side in made], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held = 0
        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = top(x), top(y)
                above[max(x, y)] = min(x, y)
            held += batch.num_rows
            if held >= AT_ONCE:
                yield stars()
                held = 0
        yield stars()

    return links.mapInArrow(run, "a long, b long")


def flat(links: DataFrame) -> bool:
    """Whether the links are stars: no node has two centres, and no centre has one."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the least node that can be reached.

    Each task first joins up the links it reads, AT_ONCE at a time, so that tasks are as many as the links that are left
    ask for. What one task can hold is joined up by one; else large-star and small-star steps alternate with it until
    only stars are left, which takes about the logarithm of the longest path. No neighbour list is ever gathered; a node
    with very many links only has its links split over tasks by the adaptive skew join. Self links and repeated links
    are allowed.
    """
    now = written(forest(links.where("a <> b")), "links")
    while now.count() > AT_ONCE and not flat(now):
        now = written(forest(star(star(now, large=True), large=False)), "links")
    if now.count() <= AT_ONCE:
        now = written(forest(now.coalesce(1)), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
