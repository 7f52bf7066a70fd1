"""Stand-in inputs over the test tables, in Spark and as SQL with the same meaning (see FIXTURES.md).

Every function takes the folder of the tables. Date bounds are applied to the raw timestamp, so they are pushed
into the Parquet scan before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANCHOR = "1998-12-31"
QUARTER = ("1998-10-01", "1998-12-31")
REPORT_MONTHS = ("1998-10-31", "1998-11-30", "1998-12-31")


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One test table. Its schema is read from the footers once, so later reads start without a Spark job."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _bounded(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    if start:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return df


def pos_tx(spark, sf, start: str | None = None, end: str | None = None) -> DataFrame:
    """Card transactions: epk, amt, mcc_code, brand_code, merchant, dt."""
    lines = _bounded(table(spark, sf, "lineitem"), "l_shipdate", start, end)
    return (
        lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("epk"),
            F.col("l_extendedprice").alias("amt"),
            F.col("p_type").alias("mcc_code"),
            F.col("p_brand").alias("brand_code"),
            F.lower("p_name").alias("merchant"),
            F.col("l_shipdate").cast("date").alias("dt"),
        )
    )


def acq_tx(spark, sf, start: str | None = None, end: str | None = None) -> DataFrame:
    """Second transaction source: epk, amt, mcc_code, merchant, dt, status."""
    return _bounded(table(spark, sf, "orders"), "o_orderdate", start, end).select(
        F.col("o_custkey").alias("epk"),
        F.col("o_totalprice").alias("amt"),
        F.col("o_orderpriority").alias("mcc_code"),
        F.lower("o_orderpriority").alias("merchant"),
        F.col("o_orderdate").cast("date").alias("dt"),
        F.col("o_orderstatus").alias("status"),
    )


def snap_sup(spark, sf, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dense monthly snapshot by supplier: epk, report_dt, amt, qty, cnt."""
    return (
        _bounded(table(spark, sf, "lineitem"), "l_shipdate", start, end)
        .groupBy(F.col("l_suppkey").alias("epk"), F.last_day(F.col("l_shipdate").cast("date")).alias("report_dt"))
        .agg(
            F.sum("l_extendedprice").alias("amt"),
            F.sum("l_quantity").alias("qty"),
            F.count(F.lit(1)).alias("cnt"),
        )
    )


def snap_cust(spark, sf, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sparse monthly snapshot by customer: epk, report_dt, amt, cnt."""
    return (
        _bounded(table(spark, sf, "orders"), "o_orderdate", start, end)
        .groupBy(F.col("o_custkey").alias("epk"), F.last_day(F.col("o_orderdate").cast("date")).alias("report_dt"))
        .agg(F.sum("o_totalprice").alias("amt"), F.count(F.lit(1)).alias("cnt"))
    )


def tags(spark, sf) -> DataFrame:
    """Slowly changing tags: epk, nsi_id, is_deleted, row_actual_to_dt."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("epk"),
        F.concat_ws("_", "event_type", (F.get_json_object("props", "$.k").cast("int") % 20).cast("string")).alias(
            "nsi_id"
        ),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_deleted"),
        F.col("ts").cast("date").alias("d"),
        "ts",
        "event_id",
    )
    # Only the last event of a day points to another day, so the order is taken over the days of a (user, tag) pair,
    # not over its events; a pair with very many events costs no single task.
    days = ev.groupBy("epk", "nsi_id", "d").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    w = W.partitionBy("epk", "nsi_id").orderBy("d")
    days = days.withColumn("next", F.coalesce(F.lead("d").over(w).cast("string"), F.lit("9999-12-31")))
    is_last = (F.col("ts") == F.col("last.ts")) & (F.col("event_id") == F.col("last.event_id"))
    return ev.join(days, ["epk", "nsi_id", "d"]).select(
        "epk",
        "nsi_id",
        "is_deleted",
        F.when(is_last, F.col("next")).otherwise(F.col("d").cast("string")).alias("row_actual_to_dt"),
    )


def needs(spark, sf) -> DataFrame:
    """Model scores: best score per client and need: epk, need_id, life_situation, raw_score, scoring_dt."""
    best = F.max(F.struct("amt", "dt", "mcc_code")).alias("b")
    return (
        pos_tx(spark, sf)
        .groupBy("epk", F.col("brand_code").alias("need_id"))
        .agg(best)
        .select(
            "epk",
            "need_id",
            (F.col("b.amt") / 1000).alias("raw_score"),
            F.col("b.mcc_code").alias("life_situation"),
            F.col("b.dt").alias("scoring_dt"),
        )
    )


CHANNELS = ("view", "click", "purchase", "error", "signup")


def contacts(spark, sf) -> DataFrame:
    """Channel counts of the whole table; a channel without events is null: epk, view, click, purchase, error, signup."""
    return _channel_counts(table(spark, sf, "events"), F.col("user_id").alias("epk"))


def daily_contacts(spark, sf) -> DataFrame:
    """The same counts for every client and day of the whole table: epk, day, view, ..."""
    return _channel_counts(table(spark, sf, "events"), F.col("user_id").alias("epk"), F.col("ts").cast("date").alias("day"))


def _channel_counts(events: DataFrame, *by) -> DataFrame:
    return events.groupBy(*by).agg(
        *[F.nullif(F.count(F.when(F.col("event_type") == t, 1)), F.lit(0)).alias(t) for t in CHANNELS]
    )


def binary_scored(spark, sf) -> DataFrame:
    """Labelled scores: id, y, score."""
    return (
        table(spark, sf, "labels")
        .join(table(spark, sf, "documents"), "doc_id")
        .select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score"))
    )


def multi_scored(spark, sf, classes: int = 10) -> DataFrame:
    """Class label and one score column per class: id, y, s0..s9."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("y"),
        *[F.col("embedding")[k].cast("double").alias(f"s{k}") for k in range(classes)],
    )


def features_wide(spark, sf, width: int = 64) -> DataFrame:
    """Flat feature row: epk, target, f0..f63."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("epk"),
        F.col("label").alias("target"),
        *[F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(width)],
    )


SQL = {
    "pos_tx": """
        select o_custkey as epk, l_extendedprice as amt, p_type as mcc_code, p_brand as brand_code,
               lower(p_name) as merchant, cast(l_shipdate as date) as dt
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "acq_tx": """
        select o_custkey as epk, o_totalprice as amt, o_orderpriority as mcc_code,
               lower(o_orderpriority) as merchant, cast(o_orderdate as date) as dt, o_orderstatus as status
        from orders""",
    "snap_sup": """
        select l_suppkey as epk, last_day(cast(l_shipdate as date)) as report_dt, sum(l_extendedprice) as amt,
               sum(l_quantity) as qty, count(*) as cnt
        from lineitem group by 1, 2""",
    "snap_cust": """
        select o_custkey as epk, last_day(cast(o_orderdate as date)) as report_dt, sum(o_totalprice) as amt,
               count(*) as cnt
        from orders group by 1, 2""",
    "tags": """
        select user_id as epk, event_type || '_' || (cast(json_extract_string(props, '$.k') as int) % 20) as nsi_id,
               case when event_type = 'error' then 1 else 0 end as is_deleted,
               coalesce(cast(lead(cast(ts as date)) over (
                   partition by user_id, event_type, cast(json_extract_string(props, '$.k') as int) % 20
                   order by ts, event_id) as varchar), '9999-12-31') as row_actual_to_dt
        from events""",
    "needs": """
        select epk, need_id, amt / 1000 as raw_score, mcc_code as life_situation, dt as scoring_dt
        from (select epk, brand_code as need_id, amt, mcc_code, dt,
                     row_number() over (partition by epk, brand_code order by amt desc, dt desc, mcc_code desc) as rn
              from pos_tx) where rn = 1""",
    "contacts": """
        select user_id as epk,
               nullif(count(*) filter (event_type = 'view'), 0) as "view",
               nullif(count(*) filter (event_type = 'click'), 0) as click,
               nullif(count(*) filter (event_type = 'purchase'), 0) as purchase,
               nullif(count(*) filter (event_type = 'error'), 0) as error,
               nullif(count(*) filter (event_type = 'signup'), 0) as signup
        from events group by 1""",
    "daily_contacts": """
        select user_id as epk, cast(ts as date) as day,
               nullif(count(*) filter (event_type = 'view'), 0) as "view",
               nullif(count(*) filter (event_type = 'click'), 0) as click,
               nullif(count(*) filter (event_type = 'purchase'), 0) as purchase,
               nullif(count(*) filter (event_type = 'error'), 0) as error,
               nullif(count(*) filter (event_type = 'signup'), 0) as signup
        from events group by 1, 2""",
    "binary_scored": """
        select l.doc_id as id, quality as y, cast(n_chars as double) as score
        from labels l join documents d on l.doc_id = d.doc_id""",
    "multi_scored": "select vec_id as id, label as y, "
    + ", ".join(f"cast(embedding[{k + 1}] as double) as s{k}" for k in range(10))
    + " from embeddings",
    "features_wide": "select vec_id as epk, label as target, "
    + ", ".join(f"cast(embedding[{k + 1}] as double) as f{k}" for k in range(64))
    + " from embeddings",
}
_NEEDS = {"needs": ("pos_tx",)}


def with_views(names: str, *more: str) -> str:
    """``with`` clause that defines the named views (blank-separated) and then ``more`` (name as (...)) items."""
    order: list[str] = []
    for n in names.split():
        for dep in (*_NEEDS.get(n, ()), n):
            if dep not in order:
                order.append(dep)
    return "with " + ",\n".join([*(f"{n} as ({SQL[n]})" for n in order), *more]) + "\n"
