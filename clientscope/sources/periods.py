"""A table of periods that are swapped atomically: versioned folders, and a manifest that says which of them count.

Every write puts its rows into a folder of its own and then publishes the next manifest, a small file that names one
folder for each period. Readers resolve the newest manifest first, so they see all of a write or nothing of it, and a
write that fails leaves files that no manifest names. Old manifests stay readable until ``retain`` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConcurrentWrite(RuntimeError):
    """Another writer has published, or is publishing, the manifest that this write was going to."""


class PeriodTable:
    """Periods under a path of any file system that Spark reaches. The driver handles names only: one per period and version."""

    def __init__(self, spark: SparkSession, path: str, period: str = "report_dt"):
        self.spark, self.path, self.period = spark, path.rstrip("/"), period
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self.Path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def versions(self) -> list[int]:
        """Numbers of the published manifests, oldest first."""
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or an older one: ``schema`` and the folder of each period."""
        known = self.versions()
        if version is None and not known:
            return {"schema": None, "periods": {}}
        if version is not None and version not in known:
            raise ValueError(f"no version {version} in {self.path}")
        stream = self.fs.open(self.Path(f"{self.path}/manifests/{known[-1] if version is None else version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, made: dict) -> None:
        """Manifest ``number``, by one writer only: the claim is created if absent, and a rename makes the text visible whole."""
        claim, text, final = (self.Path(f"{self.path}/manifests/{number:010d}{x}") for x in (".claim", f".{uuid.uuid4().hex}.text", ".json"))
        if not self.fs.createNewFile(claim):
            raise ConcurrentWrite(f"version {number} of {self.path} belongs to another writer")
        stream = self.fs.create(text, False)
        stream.write(bytearray(json.dumps(made).encode()))
        stream.close()
        if not self.fs.rename(text, final):
            raise ConcurrentWrite(f"version {number} of {self.path} could not be published")

    def replace(self, df: DataFrame, salts: int = 8) -> int:
        """Swap in the periods that ``df`` holds and leave all others; returns the new version.

        Rows are clustered by period, each over ``salts`` files. A period of null is kept like any other. Without rows a
        version with the same folders is published.
        """
        before = self.versions()
        old = self.manifest()
        folder = f"data/{uuid.uuid4().hex}"
        named = df.withColumn("__period", F.coalesce(F.col(self.period).cast("string"), F.lit("__null")))
        clustered = named.repartition(F.col("__period"), F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        clustered.write.partitionBy("__period").option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(f"{self.path}/{folder}")
        made = {}
        for n in self._names(folder):
            if n.startswith("__period="):
                made[self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(n.removeprefix("__period="))] = f"{folder}/{n}"
        number = (before[-1] if before else 0) + 1
        self._publish(number, {"schema": json.loads(df.schema.json()), "periods": old["periods"] | made})
        return number

    def abandon(self, number: int) -> None:
        """Free a number whose writer died between its claim and its manifest; the folders it wrote stay unnamed."""
        if number in self.versions():
            raise ValueError(f"version {number} is published")
        self.fs.delete(self.Path(f"{self.path}/manifests/{number:010d}.claim"), False)

    def read(self, periods: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some periods (as text), of the newest or of an older version; only their folders are read."""
        from pyspark.sql.types import StructType

        made = self.manifest(version)
        if made["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        schema = StructType.fromJson(made["schema"])
        folders = [f"{self.path}/{p}" for n, p in made["periods"].items() if periods is None or n in {str(x) for x in periods}]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def retain(self, versions: int) -> list[str]:
        """Keep the newest versions and remove older manifests and the folders that only they name; returns these folders.

        Readers of a removed version fail, so keep as many as the longest read lasts. Folders of writes that have not
        published are left alone.
        """
        if versions < 1:
            raise ValueError("at least one version must stay")
        known = self.versions()
        used = {p for v in known[-versions:] for p in self.manifest(v)["periods"].values()}
        gone = sorted({p for v in known[:-versions] for p in self.manifest(v)["periods"].values()} - used)
        for v in known[:-versions]:
            self.fs.delete(self.Path(f"{self.path}/manifests/{v:010d}.json"), False)
        for p in gone:
            self.fs.delete(self.Path(f"{self.path}/{p}"), True)
        return gone
