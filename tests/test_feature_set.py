"""The whole feature set from tables, and table sinks."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientscope.plans import feature_set as fs
from clientscope.plans import features as ft
from clientscope.session import new_path
from clientscope.sources import sinks

MONTHS = [d.date() for d in pd.date_range("2025-01-31", periods=14, freq="ME")]


@pytest.fixture(scope="module")
def tables(spark):
    """One snapshot row per client and month, worth client + month number in every column."""
    money = {*ft.FLOW_COLUMNS, *[c for pair in ft.FLOW_RATIOS.values() for c in pair], *ft.INVEST_PARTS, "srv_pmt_utl_amt"}
    money |= {f"crd_{k}_pos_{c}" for k in ("dc", "cc") for c in ft.POS_CATEGORIES}
    base = spark.createDataFrame(
        [(c, m, float(c + i)) for c in (1, 2) for i, m in enumerate(MONTHS) if not (c == 2 and i < 12)],
        "epk_id long, report_dt date, v double",
    )
    base.select("epk_id", "report_dt", *[F.col("v").alias(c) for c in sorted(money)]).createOrReplaceTempView("t_agg")
    base.select("epk_id", "report_dt", *[F.lit(1).alias(c) for c in fs.FEEDBACK_COUNTERS]).createOrReplaceTempView("t_feedback")
    spark.createDataFrame([(1, 2, 3, MONTHS[-1], 10.0), (1, 2, 4, MONTHS[-2], 5.0)], "id_major int, id_minor int, id_mega int, id_docdate date, d_sum_val double").createOrReplaceTempView("t_idoc")
    spark.createDataFrame([(1, 2, 3, "acc"), (1, 2, 3, "acc"), (1, 2, 4, "acc")], "idoc_major int, idoc_minor int, id_mega int, id_account string").createOrReplaceTempView("t_acc")
    spark.createDataFrame([("acc", 1), ("acc", 1)], "printableNo string, epkId long").createOrReplaceTempView("t_cod")
    spark.createDataFrame([(1, "v1", MONTHS[-1])], "epk_id long, visit_id string, day_part date").createOrReplaceTempView("t_visits")
    return {"agg": "t_agg", "feedbacks": "t_feedback", "idoc": "t_idoc", "idoc_acc": "t_acc", "e_cod": "t_cod", "visits": "t_visits"}


def target(spark):
    return spark.createDataFrame([(c, m, "1") for c in (1, 2) for m in MONTHS[-2:]], "epk_id long, report_dt date, target string")


def test_all_blocks_are_assembled(spark, tables):
    train, oot = fs.feature_set(spark, target(spark), tables, oot_month=str(MONTHS[-1]))
    assert train.count() == oot.count() == 2
    r = {x.epk: x.asDict() for x in oot.collect()}[1]
    last = [1.0 + i for i in range(14)]
    assert r["target"] == "1" and r["report_dt"] == MONTHS[-1]
    assert r["crd_inf_total_qty"] == last[-1] and r["crd_inf_total_qty_12m"] == pytest.approx(sum(last[-12:]) / 12)
    assert r["crd_inf_total_qty_sum_3m"] == sum(last[-3:])
    assert r["pos_auto_rub_amt_avg_3_12"] == pytest.approx((sum(last[-3:]) / 3) / (sum(last[-12:]) / 12))
    assert r["pfm_opened_cnt_all_3m"] == 3 and r["pfm_opened_cnt_all_12m"] == 12
    assert (r["sum_val_arrests_sum_1m"], r["sum_val_arrests_sum_3m"], r["qty_val_arrests_sum_3m"]) == (10.0, 15.0, 2.0)
    assert (r["visits_3m"], r["visits_12m"]) == (1, 1)
    short = {x.epk: x.asDict() for x in oot.collect()}[2]
    assert short["crd_inf_total_qty_sum_12m"] == 14.0 + 15.0 and short["visits_3m"] is None


def test_staged_blocks_are_built_once(spark, tables):
    folder = new_path(spark, "blocks")
    a, _ = fs.feature_set(spark, target(spark), {"agg": tables["agg"]}, stage=lambda n: f"{folder}/{n}")
    spark.table("t_agg").limit(0).createOrReplaceTempView("t_empty")
    b, _ = fs.feature_set(spark, target(spark), {"agg": "t_empty"}, stage=lambda n: f"{folder}/{n}")
    keys = ["epk", "report_dt"]
    rows = a.orderBy(keys).collect()
    assert len(rows) == 4 and a.columns == b.columns and rows == b.orderBy(keys).collect()


def test_replace_period_on_a_table(spark):
    name = f"scores_{dt.datetime.now():%H%M%S%f}"
    frame = lambda rows: spark.createDataFrame(rows, "epk long, score double, report_dt string")
    try:
        sinks.replace_period(frame([(1, 1.0, "a"), (1, 2.0, "b")]), name)
        for _ in range(2):
            out = sinks.replace_period(frame([(5, 9.0, "b")]).select("report_dt", "epk", "score"), name)
        assert sorted(tuple(r) for r in out.select("epk", "score", "report_dt").collect()) == [(1, 1.0, "a"), (5, 9.0, "b")]
        assert sinks.stage_if_absent(spark, name, lambda: 1 / 0).count() == 2
    finally:
        spark.sql(f"drop table if exists {name}")
