"""Writing results: replace, replace one period, skip when present, sized output."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientscope.session import new_path


def overwrite(df: DataFrame, target: str, partition_by: str | None = None) -> DataFrame:
    """Replace a table or a Parquet path and return the written data."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if "/" in target:
        writer.parquet(target)
        return df.sparkSession.read.parquet(target)
    writer.saveAsTable(target)
    return df.sparkSession.table(target)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared work folder: lineage ends there, and a lost executor takes nothing with it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_period(df: DataFrame, target: str, period: str = "report_dt", salts: int = 8) -> DataFrame:
    """Write the periods present in ``df`` and leave all others: running it twice changes nothing.

    ``target`` is a path or a table partitioned by the period. Only the touched partitions are rewritten; history is
    neither read nor copied. Rows are clustered by period first, so that a period gets ``salts`` files and not one from
    every task. The overwrite mode is an option of this write alone; the session and other writers are left alone.
    """
    spark = df.sparkSession
    clustered = df.repartition(F.col(period), F.pmod(F.xxhash64(*df.columns), F.lit(salts)))

    def write(path: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)

    if "/" in target:
        write(target, clustered)
        return spark.read.parquet(target)
    if not spark.catalog.tableExists(target):
        clustered.write.partitionBy(period).format("parquet").saveAsTable(target)
        return spark.table(target)
    # An insert into a table takes the overwrite mode from the session; the table's folder takes it from the writer.
    folder = spark.sql(f"describe formatted {target}").where("col_name = 'Location'").first()["data_type"]
    write(folder, clustered.select(*spark.table(target).columns))
    spark.catalog.recoverPartitions(target)
    spark.catalog.refreshTable(target)
    return spark.table(target)


def stage_if_absent(spark: SparkSession, target: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build and write a block once; later calls read it. A path counts as present when its write was committed."""
    if "/" not in target:
        if not spark.catalog.tableExists(target):
            build().write.saveAsTable(target)
        return spark.table(target)
    marker = spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def fingerprint(df: DataFrame, **parameters: object) -> str:
    """Digest of what a frame is made of: its plan, the parameters given, and path, length and time of every input file.

    The plan is compared in its canonical form, so a rebuilt frame of the same code has the same digest. Python functions
    inside it have no text in the plan: name their version among the parameters. Files are listed and added up by Spark.
    """
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    files = df.inputFiles()
    listed = "none"
    if files:
        found = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
        one = F.conv(F.substring(F.md5(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime"))), 1, 15), 16, 10).cast("decimal(38,0)")
        listed = str(found.agg(F.count(F.lit(1)), F.sum(one)).first())
    # Numbers that Spark gives to objects of one session are no part of what is computed.
    plan = re.sub(r"(#|plan_id=|@)[0-9a-f]+L?", "", plan)
    return hashlib.sha256(json.dumps([plan, listed, sorted((k, repr(v)) for k, v in parameters.items())]).encode()).hexdigest()


def stage(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], **parameters: object) -> DataFrame:
    """A block that is built once for each state of its code, parameters and input files.

    The block's path carries the digest of all three, so a block of other parameters or of changed files is never served,
    and one that is there is not built again. Old blocks stay until their owner removes them.
    """
    df = build()
    return stage_if_absent(spark, f"{folder}/{name}-{fingerprint(df, **parameters)[:32]}", lambda: df)


def write_sized(df: DataFrame, path: str, files: int, key: str = "epk", salts: int = 1) -> DataFrame:
    """Write about ``files`` files clustered by key; ``salts`` spreads a heavy key over several of them."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    df.repartition(files, F.col(key), spread).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
