"""Documents to training corpus: quality rules, line dedup, near-dedup, decontamination and mixing, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clientscope.llm import decontaminate, line_dedup, line_quality, mixing, near_dup
from clientscope.session import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from the texts; documents that lose too much or fail the base rule go."""
    return line_quality.clean(docs, chars_col="n_chars")


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in one of them."""
    return line_dedup.drop_lines(docs, chars_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    return near_dup.drop_near_copies(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a whole shorter one, go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources come near their targets."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_repeats),
    ("near_duplicates", near_duplicates),
    ("decontamination", contamination),
    ("mixing", mixture),
]

#: The stages hold similarity groups and drawn copies over cleaned texts; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each one keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage, fn in STAGES[:-1]:
        path = new_path(spark, stage)
        fn(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
