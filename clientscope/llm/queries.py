"""Registered queries over the operators of this subpackage, with their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from clientscope.llm import bpe, chat, decontaminate, licenses, line_dedup, line_quality, mixing, near_dup, periodic, pii, repair, secrets, sql, urls
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query("op1_chat_format", sql.CHAT)
def op1_chat_format(spark, sf_dir):
    """All conversations and one more, number -7, whose texts hold control strings; digests are read from the output."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-7L, 0L, 'user', '{text}'), (-7L, 1L, 'assistant', '{text}') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat.format_chats(rows)
    read = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("segments"))
    return chats.select(
        "conv_id", F.size(read).cast("bigint").alias("n_turns"), sha256(F.array_join(read, "")).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), sha256(loss).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid",
    )


@query("op2_pii_surrogates")
def op2_pii_surrogates(spark, sf_dir):
    """Every document with its new text; the key stands for the one that an owner would keep secret."""
    made = pii.replace_entities(table(spark, sf_dir, "documents"), key="a key of the owner")
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["first"], s["end"])), ",")
    return made.select("doc_id", F.size("found").cast("bigint").alias("n_found"), spans.alias("spans"), "text")


@query("op3_near_duplicates", sql.NEAR_DUPLICATES)
def op3_near_duplicates(spark, sf_dir):
    return near_dup.near_groups(table(spark, sf_dir, "documents"), near_dup.Near(words=4))


@query("op4_quality_rules", sql.LINE_QUALITY)
def op4_quality_rules(spark, sf_dir):
    return line_quality.judge_lines(table(spark, sf_dir, "documents"))


@query("op5_line_dedup", sql.LINE_DEDUP)
def op5_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs), "doc_id", "text")
    return kept.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


@query("op6_mix_sources", sql.MIX)
def op6_mix_sources(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents")).drop("copies")


@query("op7_secret_scan", sql.SECRETS)
def op7_secret_scan(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = map(count, ("assign", "access", "hex"))
    return found.select("doc_id", *counts, sha256(secrets.listing(base)).alias("base_sha256"), secrets.listing(F.col("found")).alias("spans"))


@query("op8_decontaminate", sql.DECONTAMINATE)
def op8_decontaminate(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("matches")


@query("op9_url_filter", sql.URLS)
def op9_url_filter(spark, sf_dir):
    """The list of blocked URLs is that of the pages whose id is divisible by 50."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, pages.where("page_id % 50 = 0"))


@query("op10_license_scan", sql.LICENSES)
def op10_license_scan(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("licenses", lambda m: m["dice"]))
    return found.select(
        "doc_id", F.size("licenses").cast("bigint").alias("n_matches"), licenses.license_names(F.col("licenses")).alias("licenses"),
        F.coalesce(best, F.lit(0.0)).alias("best_dice"),
    )


@query("op11_repair_conversations", sql.REPAIR)
def op11_repair_conversations(spark, sf_dir):
    """All conversations with planted faults, and the cheapest edits that make them legal."""
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


@query("op12_bpe_tokens")
def op12_bpe_tokens(spark, sf_dir):
    """Token ids and decoded texts of all documents, as digests."""
    import public_tokenizers

    return bpe.token_digests(bpe.token_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op13_periodic_runs", sql.PERIODIC)
def op13_periodic_runs(spark, sf_dir):
    """Runs of all documents, some of which have a period planted, and digests of the runs and the collapsed texts."""
    return periodic.run_digests(periodic.find_runs(periodic.planted(table(spark, sf_dir, "documents"))))
