"""The whole feature set from named tables: every block a table is given for, assembled on the target."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientscope.plans import features as ft
from clientscope.sources.sinks import stage_if_absent

# Feedback counters and the feature each becomes (before its window suffix).
FEEDBACK_COUNTERS = {
    "opened_feedbacks_cnt": "opened_cnt_all",
    "started_feedbacks_cnt": "started_cnt_all",
    "liked_feedbacks_cnt": "like_cnt_all",
    "opened_invest_feedbacks_cnt": "opened_invest_cnt_all",
    "started_invest_feedbacks_cnt": "started_invest_cnt_all",
    "liked_invest_feedbacks_cnt": "like_invest_cnt_all",
}


def keyed(df: DataFrame) -> DataFrame:
    """The client key under one name, and the report date as a date."""
    for name in ("epk_id", "epkId", "epkid", "cl_epk_id", "ucprbid", "clientid"):
        if name in df.columns and "epk" not in df.columns:
            df = df.withColumnRenamed(name, "epk")
    return df.withColumn("report_dt", F.col("report_dt").cast("date")) if "report_dt" in df.columns else df


def arrest_facts(documents: DataFrame, accounts: DataFrame, owners: DataFrame) -> DataFrame:
    """Arrested amounts per client and day: documents with their accounts on three keys, then the account's owner."""
    keys = ["id_major", "id_minor", "id_mega"]
    linked = accounts.withColumnsRenamed({"idoc_major": "id_major", "idoc_minor": "id_minor"})
    facts = documents.join(linked, keys).dropDuplicates()
    owned = owners.select(F.col("printableNo").alias("id_account"), F.col("epkId").alias("epk")).dropDuplicates()
    return facts.join(owned, "id_account").select(
        "epk", F.col("id_docdate").cast("date").alias("dt"), F.col("d_sum_val").cast("double").alias("amount")
    )


def blocks(spark: SparkSession, tables: Mapping[str, str], mode: str = "correct") -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Block builders by name. ``tables`` maps the roles ``agg feedbacks card_transactions card_transactions_10d
    visits idoc idoc_acc e_cod embeddings month_embeddings`` to table names; a block without its table is left out."""

    def read(role: str) -> DataFrame:
        return keyed(spark.table(tables[role]))

    def feedback(t: DataFrame) -> DataFrame:
        renamed = read("feedbacks").withColumnsRenamed(FEEDBACK_COUNTERS)
        return ft.counter_windows(t, renamed, list(FEEDBACK_COUNTERS.values()))

    def arrests(t: DataFrame) -> DataFrame:
        owners = spark.table(tables["e_cod"])
        facts = arrest_facts(spark.table(tables["idoc"]), spark.table(tables["idoc_acc"]), owners)
        return ft.arrests(t, facts, "amount", mode)

    def visits(t: DataFrame) -> DataFrame:
        return ft.visit_counts(t, read("visits").withColumnRenamed("day_part", "dt"))

    built: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {
        "agg": (("agg",), lambda t: ft.snapshot(t, read("agg"))),
        "arrests": (("idoc", "idoc_acc", "e_cod"), arrests),
        "feedbacks": (("feedbacks",), feedback),
        "visits": (("visits",), visits),
        "card_transactions": (("card_transactions",), lambda t: ft.snapshot(t, read("card_transactions"))),
        "card_transactions_10d": (("card_transactions_10d",), lambda t: ft.snapshot(t, read("card_transactions_10d"))),
        "flows": (("agg",), lambda t: ft.flow_ratios(t, read("agg"), mode=mode)),
        "pos_dynamics": (("agg",), lambda t: ft.pos_dynamics(t, ft.pos_sums(read("agg")), mode)),
        "embeddings": (("embeddings",), lambda t: ft.lagged_embeddings(t, read("embeddings"))),
        "month_embeddings": (("month_embeddings",), lambda t: ft.monthly_embeddings(t, read("month_embeddings"))),
        "dynamics": (("agg",), lambda t: ft.dynamics_by_schema(t, read("agg"), mode=mode)),
    }
    return {name: build for name, (roles, build) in built.items() if all(r in tables for r in roles)}


def feature_set(
    spark: SparkSession,
    target: DataFrame,
    tables: Mapping[str, str],
    oot_month: str | None = None,
    stage: Callable[[str], str] | None = None,
    mode: str = "correct",
) -> tuple[DataFrame, DataFrame | None]:
    """Training features and, when a month is held out, its features.

    ``stage`` gives a path or table per block: a block that is already there is read instead of built, so a failed
    run can be resumed. Without it all blocks are one lazy plan.
    """
    target = keyed(target)

    def staged(name: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        return lambda t: build(t) if stage is None else stage_if_absent(spark, stage(name), lambda: build(t))

    return ft.all_features(target, {n: staged(n, b) for n, b in blocks(spark, tables, mode).items()}, oot_month)
