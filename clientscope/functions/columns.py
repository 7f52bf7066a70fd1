"""Schema-driven preparation: columns are chosen and treated by name pattern, always in one ``select``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name patterns and fills that decide which snapshot columns become features.
DYNAMIC_PREFIXES = ("crd", "dep", "srv")
DYNAMIC_EXCLUDED = ("3", "6", "9", "12", "dt", "id", "nflag", "cd", "dk", "rate", "1st", "lst")
DROP_SUFFIXES = ("_id", "_dk")
DROP_INFIX = "_oi_"
FILL_RULES = (  # (pattern, fill, cast)
    ("flg", -1, "int"),
    ("_qty", -999999, None),
    ("_pct", -999999, None),
    ("_days", -999999, None),
    ("_num", -999999, None),
    ("_amt", -999999, None),
    ("_prc", -999999, None),
    ("_rate", -999999, "double"),
    ("_frac", -999999, "double"),
    ("_nflag", -999999, "double"),
    ("_dt", -999999, "double"),
)
FILL_NUMBER = -999999
FILL_TEXT = "UNKNOWN"
LAST_DAY = "2262-04-11"


def select_by_pattern(
    names: Sequence[str], prefixes: Sequence[str] = DYNAMIC_PREFIXES, excluded: Sequence[str] = DYNAMIC_EXCLUDED
) -> list[str]:
    return [n for n in names if n.startswith(tuple(prefixes)) and not any(x in n for x in excluded)]


def drop_by_pattern(df: DataFrame, also: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    def bad(name: str) -> bool:
        return name.endswith(DROP_SUFFIXES) or DROP_INFIX in name or name in also

    return df.drop(*[c for c in df.columns if bad(c) and c not in keep])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def fix_types(df: DataFrame) -> DataFrame:
    """Decimals to double; date columns (``_dt`` in the name) capped at the last day a nanosecond clock can hold."""
    cap = F.lit(LAST_DAY).cast("date")

    def fixed(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if "_dt" in f.name and isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.when(c > cap, cap.cast(f.dataType)).otherwise(c).alias(f.name)
        return c

    return df.select([fixed(f) for f in df.schema.fields])


def dates_to_days_before(
    df: DataFrame, report_dt: str = "report_dt", patterns: Sequence[str] = ("_dt",), keep_report: bool = False
) -> DataFrame:
    """Every date column becomes the number of days before the report date; unreadable dates become null."""
    report = F.to_date(F.col(report_dt))

    def converted(f: T.StructField) -> Column:
        if f.name == report_dt or not any(p in f.name for p in patterns):
            return F.col(f.name)
        d = F.col(f.name)
        d = d.try_cast("date") if isinstance(f.dataType, T.StringType) else d.cast("date")
        return F.datediff(report, d).alias(f.name)

    out = df.select([converted(f) for f in df.schema.fields])
    return out if keep_report else out.drop(report_dt)


def fill_missing(df: DataFrame, skip: Sequence[str] = ("report_dt",)) -> DataFrame:
    """The first matching name pattern decides the fill; otherwise double, int and string columns have a default.

    Dates must have been turned into days before; a column that still is a date is left as it is.
    """

    def filled(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name in skip or isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
            return c
        for pattern, value, cast in FILL_RULES:
            if pattern in f.name:
                if isinstance(f.dataType, T.StringType):
                    value = str(value)
                    cast = None
                c = F.coalesce(c, F.lit(value))
                return (c.cast(cast) if cast else c).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.IntegerType)):
            return F.coalesce(c, F.lit(FILL_NUMBER).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(c, F.lit(FILL_TEXT)).alias(f.name)
        return c

    return df.select([filled(f) for f in df.schema.fields])


def ids_first(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return df.select(*ids, *[c for c in df.columns if c not in ids])


def prepare(df: DataFrame, report_dt: str = "report_dt", keep: Sequence[str] = ("epk",)) -> DataFrame:
    """The whole preparation chain; Catalyst folds it into one projection over the scan."""
    return fill_missing(dates_to_days_before(drop_by_pattern(lower_names(df), keep=keep), report_dt))
