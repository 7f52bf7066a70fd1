import datetime as dt

import pytest
from pyspark.sql import functions as F

from clientscope.functions import columns as cols
from clientscope.functions import dates as d
from clientscope.functions import numbers as num
from clientscope.functions import predicates as p


def one(spark, col):
    return spark.range(1).select(col.alias("x")).head()["x"]


def test_shift_month_end_from_short_month(spark):
    assert one(spark, d.shift_month_end("2025-02-28", -2)) == dt.date(2024, 12, 31)
    assert one(spark, d.window_start("2025-02-28", 3)) == dt.date(2024, 12, 31)
    assert one(spark, d.window_start("2025-02-28", 1)) == dt.date(2025, 2, 28)


@pytest.mark.parametrize(
    "day,calendar,month_end",
    [("1998-12-31", 1, 1), ("1998-12-01", 1, 1), ("1998-11-30", 2, 2), ("1998-10-01", 3, 3), ("1998-09-30", 0, 0), ("1999-01-01", 0, 0)],
)
def test_month_buckets(spark, day, calendar, month_end):
    col = F.lit(day).cast("date")
    assert (one(spark, d.calendar_month_bucket(col, "1998-12-31")) or 0) == calendar
    assert (one(spark, d.month_end_bucket(col, "1998-12-31")) or 0) == month_end


def test_month_buckets_inside_month(spark):
    col = F.lit("1998-11-30").cast("date")
    assert one(spark, d.calendar_month_bucket(col, "1998-12-15")) == 2
    assert one(spark, d.month_end_bucket(F.lit("1998-12-20").cast("date"), "1998-12-15")) is None


def test_like_any_is_a_substring_with_one_character_wildcard(spark):
    df = spark.createDataFrame([("Terminal-Aeroport",), ("a.b",), ("axb",), (None,)], "t string")
    got = [r[0] for r in df.select(p.like_any(F.col("t"), ["terminal_aeroport"])).collect()]
    assert got == [True, False, False, None]
    assert [r[0] for r in df.select(p.like_any(F.col("t"), ["a.b"])).collect()][1:3] == [True, False]


def test_first_match_keeps_order_and_code_needs_keyword(spark):
    rules = [{"label": "one", "codes": ["1"], "words": ["x"]}, {"label": "two", "codes": ["1"], "ranges": [("3", "35")], "words": ["x", "y"]}]
    df = spark.createDataFrame([("1", "x"), ("1", "y"), ("1", "z"), ("34", "y"), ("36", "y"), (None, "x")], "c string, t string")
    assert [r[0] for r in df.select(p.code_and_keyword(F.col("c"), F.col("t"), rules)).collect()] == ["one", "two", None, "two", None, None]


def test_ladders_on_null_and_zero(spark):
    df = spark.createDataFrame([(None, None), (0, None), (0, 1), (2, 0)], "a int, b int")
    rows = df.select(
        p.none_of_counts(["a", "b"]), p.some_of_counts(["a", "b"]), p.some_of_counts(["a", "b"], strict=False)
    ).collect()
    assert [tuple(r) for r in rows] == [(True, False, False), (True, False, True), (False, True, True), (False, True, True)]


def test_numbers(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(num.safe_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 1.5]
    assert [r[0] for r in df.select(num.safe_ratio(F.col("a"), F.col("b"), 0.0)).collect()] == [0.0, 0.0, 1.5]
    assert [r[0] for r in df.select(num.null_safe_sum(["a", "b"])).collect()] == [1.0, 2.0, 5.0]
    assert [r[0] for r in df.select(num.gap_percent(F.col("b"), F.col("a"))).collect()] == [None, None, -50.0]


def test_columns(spark):
    names = ["crd_total_amt", "crd_3m_amt", "dep_open_dt", "srv_qty", "prd_amt", "dep_rate", "crd_id"]
    assert cols.select_by_pattern(names) == ["crd_total_amt", "srv_qty"]
    df = spark.createDataFrame([(1, None, None, None, None, None)], "epk long, a_flg int, b_qty double, t string, n long, x_dt date")
    assert tuple(cols.fill_missing(df).head()) == (1, -1, -999999.0, "UNKNOWN", None, None)


def test_fix_types_keeps_null_and_caps(spark):
    df = spark.sql("select cast(1.5 as decimal(10,2)) m, date'9999-12-31' a_dt, cast(null as date) b_dt, date'2020-01-01' c_dt, 'x' d_dt")
    r = cols.fix_types(df).head()
    assert (r.m, r.a_dt, r.b_dt, r.c_dt, r.d_dt) == (1.5, dt.date(2262, 4, 11), None, dt.date(2020, 1, 1), "x")


def test_prepare_chain(spark):
    df = spark.sql("select 1L EPK, 2 client_id, date'2020-01-31' report_dt, date'2020-01-01' open_dt, 'bad' close_dt, cast(null as double) s_amt")
    r = cols.prepare(df).head().asDict()
    assert r == {"epk": 1, "open_dt": 30.0, "close_dt": -999999.0, "s_amt": -999999.0}
