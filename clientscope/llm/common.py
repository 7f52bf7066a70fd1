"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clientscope.session import new_path

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of text that are Python objects at one time inside a task; a longer text stands alone.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def name(column: str) -> Column:
    """The column of this very name, dots and blanks in it included."""
    return F.col(f"`{column}`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that further columns cannot clash with them."""
    return df.select(*[name(c).alias(alias) for alias, c in columns.items()])


#: Texts of ASCII, small Latin-1 letters, general punctuation and CJK signs: lower() changes A-Z in them and nothing else.
PLAIN = r"^[\x00-\x7F\xDF-\xF6\xF8-\xFF\u2010-\u205E\u3000-\u9FFF]*$"


def fold(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does it for most texts, the slower translate() for the others."""
    return F.when((F.length(text) == F.octet_length(text)) | text.rlike(PLAIN), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def text_key(text: Column) -> Column:
    """128-bit fingerprint of a text; null stays null."""
    return F.md5(F.encode(text, "UTF-8"))


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(first, number) of stretches of texts of these sizes, each with at most SLICE_ROWS texts and SLICE_BYTES bytes, or one text."""
    first, held = 0, 0
    for at, size in enumerate(sizes):
        if at > first and (at - first == SLICE_ROWS or held + size > SLICE_BYTES):
            yield first, at - first
            first, held = at, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes) - first


def map_texts(
    rows: DataFrame, fn: Callable[[list[bytes | None]], dict[str, list]], schema: str, text_col: str = "text"
) -> DataFrame:
    """Add columns computed from the texts: fn gets UTF-8 texts and returns lists, one value per text.

    ``schema`` names the columns to return; those that fn does not make are passed on as they came. Only SLICE_ROWS
    texts and SLICE_BYTES bytes, or one longer text, are held as Python objects at a time, whatever the batch holds.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text_col).cast(pa.large_binary())), 0).to_pylist()
            for start, rows_in in slices(sizes):
                part = batch.slice(start, rows_in)
                made = fn(part.column(text_col).cast(pa.binary()).to_pylist())
                columns = [pa.array(made[f.name], f.type) if f.name in made else part.column(f.name) for f in out]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return rows.mapInArrow(run, schema)


def ddl(df: DataFrame, *columns: str) -> str:
    """Schema text of the named columns."""
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def slotted(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """All columns under free names, so that an operator's own columns cannot clash with them; and the names' map."""
    slots = {c: f"slot{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[name(c).alias(s) for c, s in slots.items()]), slots


def restored(rows: DataFrame, slots: dict[str, str], **new: Column) -> DataFrame:
    """The columns of the input again, in their order and types; ``new`` replaces some of them."""
    kinds = {s: rows.schema[s].dataType for s in slots.values()}
    return rows.select(*[(new[c].cast(kinds[s]) if c in new else F.col(s)).alias(c) for c, s in slots.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and the planner knows the table's size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
