"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientscope.llm.common import WORD, pick, restored, slotted, text_key, written

SPACE = float(2**52)  # thirteen hexadecimal digits


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target size and repetition rate of every source, from (source, source_size).

    The sources get ``weights`` in turn, by code point with null last, and split ``share`` of all sizes by weight. A
    target stops at ``most`` times the source's size and the excess is shared again by weight until none is above. The
    level at which that ends is the largest of the levels reached when the sources are capped one after another, those
    with the least room per weight first. The window runs over one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sizes.select(
        "source", "source_size",
        F.get(pattern, (F.row_number().over(order) - 1) % len(weights)).alias("weight"),
        (F.col("source_size") * most).alias("cap"),
    )
    by_room = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    everything = by_room.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = weighted.withColumn("level", left / F.sum("weight").over(by_room.rowsBetween(0, W.unboundedFollowing)))
    target = F.least(F.col("cap"), F.col("weight") * F.max("level").over(everything))
    return levels.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    )


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / SPACE


def copies(rate: Column, key: Column, seed: str) -> Column:
    """floor(rate) copies and one more with the probability of the fraction."""
    return (F.floor(rate) + (draw(key, seed) < rate - F.floor(rate)).cast("bigint")).cast("int")


def rates(docs: DataFrame, text_col: str, source_col: str, **shares) -> DataFrame:
    """The table of targets, written to the shared folder: the planner then knows its size, and broadcasts it or not."""
    sized = pick(docs, text=text_col, source=source_col).select("source", size_of(F.col("text")).alias("size"))
    return written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **shares), "mix-rates")


def mix_report(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **shares
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies and taken (copies times size).

    The draw depends on the id, or on the text where the id is null, so that reruns agree and rows that repeat an id
    agree too. A source without words has the target 0 and gives no copies. Other columns are ignored; see ``targets``
    for the shares.
    An empty table gives no rows; of a text of any length only the number of words is used.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, of_source=source_col).select(
        "doc_id", "of_source", size_of(F.col("text")).alias("size"), seed_key(F.col("doc_id"), F.col("text")).alias("key")
    )
    joined = rows.join(rates(docs, text_col, source_col, **shares), F.col("of_source").eqNullSafe(F.col("source")), "left")
    n = joined.withColumn("copies", copies(F.col("rate"), F.col("key"), seed))
    return n.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def seed_key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), text_key(text), F.lit(""))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **shares
) -> DataFrame:
    """The documents of the mix in the columns of the input: each row as often as its copies say, or not at all."""
    plain, slots = slotted(docs)
    joined = plain.join(
        rates(docs, text_col, source_col, **shares), F.col(slots[source_col]).eqNullSafe(F.col("source")), "left"
    )
    n = copies(F.col("rate"), seed_key(F.col(slots[id_col]), F.col(slots[text_col])), seed)
    return restored(joined.withColumn("nth", F.explode(F.array_repeat(F.lit(0), n))), slots)
