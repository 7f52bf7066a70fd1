"""Line dedup: hashes in range partitions, first occurrences streamed in order, run-length keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientscope.llm.common import fold, pick, restored, slotted, text_key, written

BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return fold(F.trim(line, F.lit(BLANKS)))


def keep_bitmaps(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, slices: int = 64
) -> DataFrame:
    """Per document with dropped lines: doc_id, text_key, n_dropped and the kept runs of lines.

    A line key of at least ``least_chars`` code points found in at least ``least_docs`` documents stays in the document
    of the largest id only. The bitmap is run-length coded: ``kept_runs`` is an array of (first, length), the lines
    outside the runs are dropped. Documents that lose nothing have no row.

    Line hashes are range-partitioned by (hash, slice of the document), so that a key with a third of all lines spreads
    over up to ``slices`` ranges, and are sorted by document, largest first, and position. One pass in that order yields
    the first documents of every key and slice; those few rows decide about the key.

    Rows that repeat an id are one document here and each gets its own bitmap; a null id is a document that sorts below
    all others. Other columns are ignored.
    An empty table gives no rows; a very long text is dealt out line by line, and only its positions meet again.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("lines", lines_of(F.col("text")))
    keyed = rows.select(
        "doc_id", text_key(F.col("text")).alias("text_key"), F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line")
    ).withColumn("line", line_key(F.col("line")))
    hashed = keyed.where(F.length("line") >= least_chars).select(
        F.unhex(F.md5(F.encode("line", "UTF-8"))).alias("hash"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slices)).alias("slice"),
        "doc_id", "text_key", "n_lines", "pos",
    )
    hashed = written(hashed, "line-hashes")
    ranged = hashed.repartitionByRange("hash", "slice")
    stream = W.partitionBy("hash", "slice").orderBy(F.col("doc_id").desc_nulls_last(), F.col("pos"))
    firsts = ranged.select(
        "hash", "doc_id",
        F.dense_rank().over(W.partitionBy("hash", "slice").orderBy(F.col("doc_id").desc_nulls_last())).alias("nth"),
        F.row_number().over(stream).alias("place"),
        F.lag("doc_id").over(stream).alias("before"),
    ).where((F.col("nth") <= least_docs) & ((F.col("place") == 1) | ~F.col("doc_id").eqNullSafe(F.col("before"))))
    repeated = (
        firsts.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last_doc"))
        .where(F.col("docs") >= least_docs)
    )
    gone = hashed.join(written(repeated, "repeated-lines"), "hash").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    per_doc = gone.groupBy("doc_id", "text_key").agg(
        F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("at")
    )
    return per_doc.select("doc_id", "text_key", "n_lines", F.size("at").alias("n_dropped"), kept_runs().alias("kept_runs"))


def kept_runs() -> Column:
    """Runs (first, length) of the lines that are not in the sorted positions ``at``."""
    starts = F.concat(F.array(F.lit(0)), F.transform("at", lambda p: p + 1))
    ends = F.concat("at", F.array("n_lines"))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("first"), (e - s).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def drop_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, **limits) -> DataFrame:
    """The documents with repeated lines removed, in the columns of the input; ``limits`` as in ``keep_bitmaps``.

    ``chars_col`` names a column to be set to the new length of texts that lost lines. No row is dropped: a text may
    become empty, and a null text stays null.
    """
    plain, slots = slotted(docs)
    kept = with_bitmaps(plain, keep_bitmaps(docs, id_col=id_col, text_col=text_col, **limits), slots[id_col], slots[text_col])
    lost = F.col("kept_runs").isNotNull()
    new = {text_col: F.when(lost, F.col("kept_text")).otherwise(F.col(slots[text_col]))}
    if chars_col is not None:
        new[chars_col] = F.when(lost, F.length("kept_text").cast("bigint")).otherwise(F.col(slots[chars_col]))
    return restored(kept, slots, **new)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with the columns n_lines, n_dropped, kept_runs (null: all lines stay) and kept_text."""
    runs = bitmaps.select(
        F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), F.coalesce("n_dropped", F.lit(0)).alias("gone"), "kept_runs"
    )
    same = F.col(id_col).eqNullSafe(F.col("of_doc")) & (text_key(F.col(text_col)) == F.col("of_text"))
    lines = lines_of(F.col(text_col))
    pieces = F.flatten(F.transform("kept_runs", lambda r: F.slice(F.col("lines"), r["first"] + 1, r["length"])))
    return (
        docs.join(runs, same, "left")
        .withColumn("lines", lines)
        .withColumn("n_lines", F.size("lines").cast("bigint"))
        .withColumn("n_dropped", F.coalesce("gone", F.lit(0)).cast("bigint"))
        .withColumn(
            "kept_text",
            F.when(F.col("kept_runs").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(pieces, "\n")),
        )
        .drop("lines", "of_doc", "of_text", "gone")
    )
