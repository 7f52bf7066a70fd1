"""Feature blocks that join without an exchange: stored in buckets of their keys, sorted, with one bucket number for all."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from clientscope.operators.joins import left_chain, one_row_per_key

KEYS = ("epk", "report_dt")


class BlockStore:
    """Named blocks of one bucket number, as tables of the session's catalog with files under ``folder`` (or its warehouse).

    A block is checked for one row per key and written once, clustered and sorted by the keys; assembling blocks is then
    a merge join of equal buckets, each read by one task. Choose ``buckets`` so that a bucket of the widest block fits a
    task: about the block's size divided by 256 MB.
    """

    def __init__(self, spark: SparkSession, buckets: int, keys: Sequence[str] = KEYS, folder: str | None = None, prefix: str | None = None):
        self.spark, self.buckets, self.keys, self.folder = spark, buckets, list(keys), folder
        self.prefix = prefix or f"block_{uuid.uuid4().hex}"

    def table(self, name: str) -> str:
        return f"{self.prefix}_{name}"

    def put(self, name: str, block: DataFrame) -> DataFrame:
        """Write a block (equal rows count once, two rows for one key are an error) and return it as stored."""
        rows = one_row_per_key(block, self.keys).repartition(self.buckets, *self.keys)
        writer = rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        if self.folder:
            writer = writer.option("path", f"{self.folder}/{self.table(name)}")
        writer.saveAsTable(self.table(name))
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.table(self.table(name))

    def assemble(self, target: str, names: Sequence[str]) -> DataFrame:
        """The target block with all others on its keys. No hint and no size of a side can turn a bucket join into a broadcast."""
        return left_chain(self.get(target).hint("merge"), [self.get(n).hint("merge") for n in names], self.keys)

    def drop(self) -> None:
        """Forget the tables; those without a folder of their own lose their files too."""
        for t in self.spark.catalog.listTables():
            if t.name.startswith(f"{self.prefix}_"):
                self.spark.sql(f"drop table if exists {t.name}")


def stored_blocks(store: BlockStore, target: DataFrame, blocks: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Write the target and every block that is built for it, and assemble them from their buckets."""
    t = store.put("target", target.select(*store.keys).distinct()).select(*store.keys)
    for name, build in blocks.items():
        store.put(name, build(t))
    return store.assemble("target", list(blocks))
