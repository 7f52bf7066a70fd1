import random

import pytest
from pyspark.sql import functions as F

from clientscope.ml import evaluate as ev
from clientscope.ml import models as m
from clientscope.ml.split import assign_parts, month_folds


def data(spark, seed=0, n=300, levels=20):
    rng = random.Random(seed)
    rows = [(i, float(rng.randrange(levels)), int(rng.random() < 0.4)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, score double, y int"), rows


def brute_auc(rows):
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("levels", [1, 2, 20, 10000])
def test_auc_is_exact_and_symmetric(spark, levels):
    df, rows = data(spark, levels=levels)
    a = ev.roc_auc(df, F.col("y") == 1, "score").head().auc
    b = ev.roc_auc(df.withColumn("score", -F.col("score")), F.col("y") == 1, "score").head().auc
    assert a == pytest.approx(brute_auc(rows), abs=1e-8) and a + b == pytest.approx(1, abs=1e-8)


def test_auc_without_positives_is_null(spark):
    df, _ = data(spark)
    assert ev.roc_auc(df, F.lit(False), "score").head().auc is None


@pytest.mark.parametrize("beta", [0.5, 1.0, 2.0])
def test_best_fbeta(spark, beta):
    df, rows = data(spark, 7)
    total = sum(y for *_, y in rows)
    best = 0.0
    for t in {s for _, s, _ in rows}:
        hit = [y for _, s, y in rows if s >= t]
        p, r = sum(hit) / len(hit), sum(hit) / total
        if p + r:
            best = max(best, (1 + beta**2) * p * r / (beta**2 * p + r))
    assert ev.best_fbeta(df, F.col("y") == 1, "score", beta).head().fbeta == pytest.approx(best, abs=1e-8)


def test_lift_of_the_whole_is_one(spark):
    df, rows = data(spark)
    table = {r.share: r for r in ev.lift_table(df, F.col("y") == 1, "score", "id").collect()}
    assert table[1.0].lift == 1.0 and table[1.0].recall == 1.0 and table[1.0].size == len(rows)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))[:30]
    assert table[0.1].precision == pytest.approx(sum(y for *_, y in order) / 30, abs=1e-8)


def test_describe_matches_pandas(spark):
    df, _ = data(spark, 9, n=101, levels=7)
    want = df.toPandas().score.describe()
    got = ev.describe_scores(df, "score").head()
    for a, b in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert got[a] == pytest.approx(want[b], abs=1e-6)


def test_class_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "y int, p int")
    got = {r.name: (r.precision, r.recall, r.f1, r.support) for r in ev.class_report(ev.confusion(df, "y", "p")).collect()}
    assert got["1"] == (0.0, 0.0, 0.0, 1) and got["2"] == (1.0, 1.0, 1.0, 1)
    assert got["0"][0] == pytest.approx(2 / 3, abs=1e-8) and got["macro avg"][3] == 4


def test_histogram_shares_sum_to_one(spark):
    df, _ = data(spark)
    h = ev.class_histogram(df, "y", ["score"], 0, 10, 5).groupBy("y").agg(F.sum("share").alias("s"))
    assert all(r.s == pytest.approx(1, abs=1e-6) for r in h.collect())


def test_split_is_stable_and_near_its_shares(spark):
    df = spark.range(5000).withColumnRenamed("id", "epk")
    counts = {r.part: r["count"] for r in assign_parts(df, "epk").groupBy("part").count().collect()}
    assert abs(counts["train"] - 3000) < 150 and abs(counts["val"] - 1000) < 120
    again = assign_parts(df.repartition(13), "epk")
    assert again.exceptAll(assign_parts(df, "epk")).count() == 0


def test_folds():
    assert [f[0] for f in month_folds([4, 1, 2, 3])] == ["m1_to_m2", "m1_to_m3", "m1_m2_to_m3", "m1_to_m4", "m1_m2_m3_to_m4"]
    with pytest.raises(ValueError):
        month_folds([1, 1])
    assert month_folds([3, 1, 2]) == [("m1_to_m2", [1], [2]), ("m1_to_m3", [1], [3]), ("m1_m2_to_m3", [1, 2], [3])]


def test_ordinal_codes(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",)], "c string")
    (out,) = m.ordinal_encode(train, [spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")], ["c"])
    assert [r.c for r in out.collect()] == [0, 1, -1, -1]


def learnable(spark, n=300):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(n)]
    return spark.createDataFrame([(i, a, b, c, int(a > 0.5)) for i, a, b, c in rows], "epk long, a double, b double, c double, target int")


def test_fit_eliminate_search_and_score(spark):
    parts = assign_parts(learnable(spark), "epk")
    train, val = (parts.where(F.col("part") == p).drop("part") for p in ("train", "val"))
    names = ["a", "b", "c"]
    model = m.fit(m.boosting(rounds=3, depth=2), train, names, "target", val=val)
    assert m.top_features(model, names, k=1) == ["a"] and m.binary_auc(model, val, names, "target") > 0.95
    steps = m.eliminate(lambda: m.forest(trees=5), train, val, names, "target", lambda x, d, f: m.binary_auc(x, d, f, "target"))
    assert steps[0][1] == "" and steps[-1][0] == 1
    trials = m.search(
        lambda p: m.forest(trees=p["trees"]), [{"trees": 2}, {"trees": 5}], train, val, names, "target",
        lambda x, d: m.binary_auc(x, d, names, "target"), gap=-1.0,
    )
    assert [t[0] for t in trials] == [0, 1] and all(t[4] == 0.0 for t in trials)
    out = m.score_binary(model, val, names, "2026-04-30")
    assert out.dtypes == [("epk", "bigint"), ("score", "float"), ("report_dt", "string")] and out.count() == val.count()
    wide = m.score_multiclass(model, val, names, [1, 2], "2026-04-30")
    assert wide.columns == ["epk", "cluster_1_score", "cluster_2_score", "report_dt"]


def test_python_scorer(spark):
    out = m.score_with(learnable(spark, 20), ["a", "b"], m.linear_scorer([2.0, 0.0], 1.0), "x").join(learnable(spark, 20), "epk")
    assert all(r.score == pytest.approx(2 * r.a + 1) for r in out.collect())
