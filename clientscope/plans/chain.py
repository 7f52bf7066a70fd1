"""The recommendation chain: every step is written once and handed to the next, so that a failed run goes on from there."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from clientscope.operators.joins import left_chain, one_row_per_key
from clientscope.plans.assembly import free_then_paid
from clientscope.sources.sinks import stage_if_absent


def recommendation_chain(
    spark: SparkSession, clients: DataFrame, steps: Mapping[str, Callable[[], DataFrame]], folder: str, key: str = "epk"
) -> DataFrame:
    """One row per client of either tier with the columns of all steps.

    ``steps`` build the blocks by name, in order; one of them gives ``payment_status``. Each is written below ``folder``
    (a shared one on a cluster) unless it is there already, and read back for the join on the client key. The joined rows
    are written once too, since free and paid rows and their null test each read them.
    """
    stored = [stage_if_absent(spark, f"{folder}/{name}", build) for name, build in steps.items()]
    joined = lambda: left_chain(clients, [one_row_per_key(s, [key]) for s in stored], key)
    return free_then_paid(stage_if_absent(spark, f"{folder}/assembled", joined))
