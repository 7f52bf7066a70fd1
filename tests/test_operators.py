import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientscope.operators import joins, ranking, windows
from clientscope.operators.rolling import rolling_windows
from clientscope.session import new_path
from clientscope.sources import readers, sinks


def scores(spark, seed=1, n=400, values=7, hot=0.4):
    """Scores with many ties; one value holds a large share of the rows."""
    rng = random.Random(seed)
    rows = [(i, 3.0 if rng.random() < hot else float(rng.randrange(values)), int(rng.random() < 0.3)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, score double, y int"), pd.DataFrame(rows, columns=["id", "score", "y"])


@pytest.mark.parametrize("seed,values,hot", [(1, 7, 0.4), (2, 1, 1.0), (3, 500, 0.0)])
def test_global_row_number(spark, seed, values, hot):
    df, pdf = scores(spark, seed, values=values, hot=hot)
    want = pdf.sort_values(["score", "id"], ascending=[False, True]).id.tolist()
    got = ranking.global_row_number(df, "score", "id", ranges=5).orderBy("rank").toPandas()
    assert got.id.tolist() == want and got["rank"].tolist() == list(range(1, len(want) + 1))


@pytest.mark.parametrize("values,hot", [(7, 0.4), (1, 1.0), (300, 0.1)])
def test_cumulative_counts(spark, values, hot):
    df, pdf = scores(spark, 5, values=values, hot=hot)
    got = ranking.cumulative_counts(df, "score", F.col("y") == 1, ranges=4).orderBy(F.desc("score")).toPandas()
    for r in got.itertuples():
        upper = pdf[pdf.score >= r.score]
        assert (r.tp, r.fp) == (upper.y.sum(), (1 - upper.y).sum())


def test_top_share_breaks_ties_by_key(spark):
    df, pdf = scores(spark, 4)
    want = set(pdf.sort_values(["score", "id"], ascending=[False, True]).id[:40])
    assert {r.id for r in ranking.top_share(df, "score", "id", 0.1).collect()} == want


@pytest.mark.parametrize("n", [0, 1, 57, 400, 1000])
def test_sample_is_exact_and_repeatable(spark, n):
    df, _ = scores(spark)
    a = sorted(r.id for r in ranking.sample_rows(df, n, "id", "s").collect())
    b = sorted(r.id for r in ranking.sample_rows(df.repartition(7), n, "id", "s").collect())
    assert a == b and len(a) == len(set(a)) == min(n, 400)


def test_sample_follows_unique_hash_not_input_order(spark):
    df, _ = scores(spark)
    a = {r.id for r in ranking.sample_rows(df, 50, "id", "one").collect()}
    assert a != {r.id for r in ranking.sample_rows(df, 50, "id", "two").collect()}


def test_best_row_has_one_row_per_key(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (1, "c", 1.0), (2, "z", None)], "k int, name string, v double")
    got = windows.best_row(df, ["k"], [F.col("v")], ["name", "v"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "b", 2.0), (2, "z", None)]


@pytest.mark.parametrize("rows,want", [([1, 2], [3]), ([1, None], []), ([], [1, 3, None])])
def test_not_in_follows_null_rules(spark, rows, want):
    left = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    right = spark.createDataFrame([(r,) for r in rows], "k int")
    assert sorted([r.k for r in joins.not_in(left, right, "k").collect()], key=str) == sorted(want, key=str)


def test_keys_seen_once(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [r.k for r in joins.keys_seen_once(df, "k").collect()] == [2]


# --- rolling windows ----------------------------------------------------------------------------------------

MONTHS = [d.date() for d in pd.date_range("2020-01-31", periods=16, freq="ME")]


def history(spark, seed=3, clients=6, share=0.6):
    rng = random.Random(seed)
    rows = [(c, m, float(rng.randrange(1, 50))) for c in range(clients) for m in MONTHS if rng.random() < share]
    target = [(c, m) for c in range(clients + 1) for m in MONTHS[-3:]]
    return (
        spark.createDataFrame(rows, "epk long, report_dt date, v double"),
        spark.createDataFrame(target, "epk long, report_dt date"),
        rows,
        target,
    )


def inside(rows, c, m, w):
    start = MONTHS[MONTHS.index(m) - (w - 1)]
    return [v for k, d, v in rows if k == c and start <= d <= m]


def test_rolling_correct(spark):
    h, t, rows, target = history(spark)
    got = {(r.epk, r.report_dt): r for r in rolling_windows(t, h, ["v"]).collect()}
    assert set(got) == set(target)
    for (c, m), r in got.items():
        for w in (3, 6, 9, 12):
            part = inside(rows, c, m, w)
            assert r[f"v_sum_{w}m"] == (sum(part) if part else None)
            assert r[f"v_avg_{w}m"] == (pytest.approx(sum(part) / len(part)) if part else None)
        sums = [r[f"v_sum_{w}m"] or 0 for w in (3, 6, 9, 12)]
        assert sums == sorted(sums)


def test_rolling_compat_equals_one_join_per_window(spark):
    h, t, rows, target = history(spark, share=0.4)
    got = {(r.epk, r.report_dt): r for r in rolling_windows(t, h, ["v"], mode="compat").collect()}
    for c, m in target:
        parts = {w: inside(rows, c, m, w) for w in (3, 6, 9, 12)}
        if not parts[3]:
            assert (c, m) not in got
            continue
        fan = {w: 1 for w in parts}
        for w in parts:
            for o in parts:
                fan[w] *= len(parts[o]) if o != w else 1
        r = got[(c, m)]
        assert all(r[f"v_sum_{w}m"] == sum(parts[w]) * fan[w] for w in parts)
        assert r["v_sum_3_6"] == pytest.approx((sum(parts[3]) / len(parts[3])) / (sum(parts[6]) / len(parts[6])))


def test_rolling_with_several_rows_per_month(spark):
    h, t, _, _ = history(spark)
    halves = h.withColumn("v", F.col("v") / 2)
    doubled = halves.unionByName(halves)
    a = rolling_windows(t, h, ["v"], aggs=("sum",)).orderBy("epk", "report_dt").collect()
    b = rolling_windows(t, doubled, ["v"], aggs=("sum",), unique_history=False).orderBy("epk", "report_dt").collect()
    assert a == b


def test_rolling_uses_one_join_and_no_cartesian_product(spark):
    h, t, _, _ = history(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rolling_windows(t, h, ["v"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    initial = plan.split("Initial Plan")[-1]
    assert "CartesianProduct" not in initial and "NestedLoop" not in initial
    assert initial.count("Join") == 1


# --- sources and sinks --------------------------------------------------------------------------------------


def test_replace_period_is_idempotent_and_keeps_history(spark):
    path = new_path(spark, "t")
    first = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (1, "b", 3.0)], "epk long, report_dt string, score double")
    sinks.replace_period(first, path)
    new = spark.createDataFrame([(9, "b", 5.0)], "epk long, report_dt string, score double")
    for _ in range(2):
        out = sinks.replace_period(new, path)
    assert sorted((r.epk, r.report_dt, r.score) for r in out.collect()) == [(1, "a", 1.0), (2, "a", 2.0), (9, "b", 5.0)]


def test_stage_if_absent_builds_once(spark):
    path, calls = new_path(spark, "stage"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert sinks.stage_if_absent(spark, path, build).count() == sinks.stage_if_absent(spark, path, build).count() == 3
    assert len(calls) == 1


def test_month_sequence_fills_gaps(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 31),), (dt.date(2020, 4, 30),)], "report_dt date")
    assert [r.report_dt.month for r in readers.month_sequence(df).orderBy("report_dt").collect()] == [1, 2, 3, 4]


def test_work_folder_comes_from_the_session(spark):
    from clientscope.session import work_folder

    before = spark.conf.get("spark.checkpoint.dir", None)
    assert work_folder(spark) == work_folder(spark) == (before or work_folder(spark))
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_assemble_takes_equal_rows_once_and_refuses_different_ones(spark):
    target = spark.createDataFrame([(1, 1), (2, 1)], "epk long, report_dt long")
    block = spark.createDataFrame([(1, 1, None), (1, 1, None), (2, 1, 5)], "epk long, report_dt long, v long")
    rows = joins.assemble(target, [block, block.drop("v")]).orderBy("epk").collect()
    assert [tuple(r) for r in rows] == [(1, 1, None), (2, 1, 5)]
    other = block.unionByName(spark.createDataFrame([(2, 1, 7)], block.schema))
    with pytest.raises(Exception, match="different rows for one key"):
        joins.assemble(target, [other]).collect()


def test_missing_scores_have_no_place_in_an_order(spark):
    from clientscope.ml import evaluate as e

    rows = [(i, i % 2, float(i) if i % 5 else None, float("nan") if i % 4 == 0 else float(-i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    lift = {(r.cls, r.share): r.size for r in e.class_lift_table(df, "y", {0: "a", 1: "b"}, "id", [0.5, 1.0]).collect()}
    assert lift == {("0", 0.5): 40, ("0", 1.0): 80, ("1", 0.5): 37, ("1", 1.0): 75}
    hit = F.col("y") == 1
    assert e.roc_auc(df, hit, "b").first().positives == 50 and e.describe_scores(df, "b").first()["count"] == 75
    assert e.lift_table(df, hit, "b", "id", [1.0]).first()["size"] == 75 and e.best_fbeta(df, hit, "b").count() == 1


def test_ranges_follow_the_rows():
    from clientscope.operators.ranking import ranges_for

    assert ranges_for(1000) == 64 and ranges_for(10**10) == 10_000


def test_rolling_reads_only_the_reachable_partitions(spark):
    h, t, _, _ = history(spark)
    path = new_path(spark, "hist")
    h.write.partitionBy("report_dt").parquet(path)
    stored = spark.read.parquet(path).select("epk", F.col("report_dt").cast("date").alias("report_dt"), "v")
    last = t.where(F.col("report_dt") == F.lit(MONTHS[-1]))
    out = rolling_windows(last, stored, ["v"], windows=(3,), aggs=("sum",))
    assert out.count() == last.count()
    assert "report_dt" in out._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_rolling_in_several_passes_is_the_same(spark):
    from clientscope.plans.features import dynamics_by_schema

    h, t, _, _ = history(spark)
    wide = h.select("epk", "report_dt", F.col("v").alias("crd_a_amt"), (F.col("v") * 2).alias("dep_b_amt"), (F.col("v") + 1).alias("srv_c_amt"))
    one = dynamics_by_schema(t, wide).orderBy("epk", "report_dt").collect()
    assert one == dynamics_by_schema(t, wide, columns_per_pass=2).orderBy("epk", "report_dt").collect()
