import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientscope.plans import catalog, core_products, features, life_situation, lifestyle, needs, targets, tiers

A = "2026-04-30"


def tx(spark, rows):
    return spark.createDataFrame(
        [(k, float(a), c, m, dt.date.fromisoformat(d)) for k, a, c, m, d in rows],
        "epk long, amt double, mcc_code string, merchant string, dt date",
    )


def tags(spark, rows):
    return spark.createDataFrame([(k, t, d, e) for k, t, d, e in rows] or [], "epk long, nsi_id string, is_deleted int, row_actual_to_dt string")


OPEN = "9999-12-31"


def test_free_tier_takes_the_best_level(spark):
    t = tags(spark, [(1, "39541", 0, OPEN), (1, "41620", 0, OPEN), (2, "41384", 1, OPEN), (3, "39542", 0, "2026-01-01"), (4, "x", 0, OPEN)])
    assert [(r.epk, r.approval_level, r.approval_criteria) for r in tiers.free_tier(t).collect()] == [(1, 5, "41620")]


@pytest.mark.parametrize("x,y,z,score,level", [(2.5e6, 0, 0, 1, 3), (1.5e6, 0, 0, 1, 3), (4e6, 3e5, 4e6, 1, 0), (6e5, 0, 0, 1, 1), (6e5, 0, 0, 0, 0)])
def test_band_level(spark, x, y, z, score, level):
    """x = 1.5 million alone also satisfies level 3's upper bounds but not its lower ones."""
    df = spark.createDataFrame([(float(x), float(y), float(z), float(score))], "x double, y double, z double, score double")
    got = df.select(tiers.band_level(tiers.PAID_BANDS, F.col("score") >= 1).alias("l")).head().l
    assert got == (2 if x == 1.5e6 else level)


def test_lifestyle_clear_race_ignores_tags(spark):
    t = tx(spark, [(1, 900, "7298", "", "2026-04-02"), (1, 100, "7941", "", "2026-03-02")])
    g = tags(spark, [(1, x, 0, OPEN) for x in catalog.EXHIBITION_TAGS])
    assert lifestyle.top_category(t, g, A).collect()[0].top_category == "spa"


def test_lifestyle_close_race_is_decided_by_tags(spark):
    t = tx(spark, [(1, 500, "7298", "", "2026-04-02"), (1, 500, "5945", "", "2026-04-02")])
    assert lifestyle.top_category(t, tags(spark, []), A).collect()[0].top_category == "exhibitions"
    # a third category can win by its tags, limited by the top score
    g = tags(spark, [(1, x, 0, OPEN) for x in ("10138", "33532", "10175")])
    assert lifestyle.top_category(t, g, A).collect()[0].top_category == "exhibitions"
    spa = tx(spark, [(1, 505, "7298", "", "2026-04-02"), (1, 500, "5945", "", "2026-04-02")])
    g = tags(spark, [(1, catalog.EXHIBITION_TAGS[0], 0, OPEN)])
    assert lifestyle.top_category(spa, tags(spark, []), A).collect()[0].top_category == "spa"
    assert lifestyle.top_category(spa, g, A).collect()[0].top_category == "exhibitions"


def test_lifestyle_all_scores_zero_falls_to_tags(spark):
    t = tx(spark, [(1, 0, "7298", "", "2026-04-02")]).withColumn("amt", F.lit(None).cast("double"))
    spend = lifestyle.category_spend(t, A, F.lit("spa"), ["spa", "event"])
    assert spend.head().spa_cnt == 1 and spend.head().all_amt == 0.0


def test_lifestyle_codes_belong_to_the_first_list(spark):
    t = tx(spark, [(1, 10, "5812", "", "2026-04-02")])
    assert lifestyle.top_category(t, tags(spark, []), A).collect()[0].top_category == "excursion"


def test_perks(spark):
    t = tx(spark, [(1, 1, "5814", "", "2026-04-02"), (2, 1, "4121", "", "2026-03-31"), (3, 1, "4121", "", "2026-03-30")])
    assert sorted(tuple(r) for r in lifestyle.perk_flags(t, A).collect()) == [(1, 1, 0), (2, 0, 1)]


def sphere_scores(spark, rows=()):
    df = spark.createDataFrame(list(rows), "epk long, need_id string, raw_score double, scoring_dt date")
    from clientscope.plans.scoring import tag_label

    labels = [r["label"] for r in catalog.SPHERES]
    return life_situation.propensity(
        df, None, F.lit("2026-02-28").cast("date"), F.lit(A).cast("date"),
        label=tag_label(F.col("need_id"), catalog.SPHERE_NEEDS), labels=labels,
    )


def situation(spark, rows, tag_rows=(), score_rows=(), mode="correct"):
    from clientscope.plans.scoring import tag_label

    spend = life_situation.sphere_spend(tx(spark, rows), A)
    out = life_situation.situation(
        spend, tags(spark, list(tag_rows)), sphere_scores(spark, score_rows), [r["label"] for r in catalog.SPHERES],
        tag_label(F.col("nsi_id"), catalog.SPHERE_TAGS), mode=mode,
    )
    return {r.epk: r.lifestyle_situation for r in out.collect()}


def test_situation_gate_and_unclassified(spark):
    rows = [
        (1, 50000, "7941", "sport club", "2026-04-02"),
        (2, 10, "7941", "sport club", "2026-04-02"),
        (3, 10, "5511", "avto", "2026-04-02"),
        (4, 10, "7941", "bakery", "2026-04-02"),
    ]
    assert situation(spark, rows) == {1: "sport", 2: "general", 3: "auto"}


def test_situation_bonuses(spark):
    close = [(1, 50000, "7941", "sport club", "2026-04-02"), (1, 50500, "4112", "vokzal", "2026-04-02")]
    assert situation(spark, close) == {1: "trips"}
    assert situation(spark, close, [(1, "33538", 0, OPEN)]) == {1: "sport"}
    score = [(1, "1.51.3", 90.0, dt.date(2026, 4, 1))]
    assert situation(spark, close, score_rows=score) == {1: "sport"}
    assert situation(spark, close, score_rows=score, mode="compat") == {1: "trips"}
    assert situation(spark, close, score_rows=[(1, "1.51.3", 69.0, dt.date(2026, 4, 1))]) == {1: "trips"}


def test_sub_situation(spark):
    from clientscope.plans.scoring import tag_label

    clients = spark.createDataFrame([(1, "sport"), (2, "auto"), (3, "sport"), (4, "health")], "epk long, lifestyle_situation string")
    rows = [(1, 100, "7298", "spa", "2026-04-02"), (1, 90, "7997", "sport", "2026-04-02"), (3, 5, "7832", "kino", "2026-04-02"),
            (2, 5, "7997", "sport", "2026-04-02"), (4, 5, "8062", "laborat", "2026-04-02")]
    none = spark.createDataFrame([], "epk long, propensity double")

    def run(tag_rows):
        out = life_situation.sub_situation(clients, tx(spark, rows), tags(spark, tag_rows), none, tag_label(F.col("nsi_id"), catalog.SUB_TAGS))
        return {r.epk: r.lifestyle_sub_situation for r in out.collect()}

    assert run([]) == {1: "beauty", 2: "", 3: "general", 4: "laboratory"}
    assert run([(1, "33538", 0, OPEN)])[1] == "fitness"


def test_needs_to_products(spark):
    rules = needs.product_table(spark, catalog.product_needs("x"))
    assert rules.where("need_id = '8.8.4'").count() > 5
    first = needs.product_table(spark, catalog.product_needs("x"), first_match=True)
    assert [r.product for r in first.where("need_id = '8.8.4'").collect()] == ["cooper"]
    scored = spark.createDataFrame(
        [(1, "8.8.4", "trips", 90.0), (1, "2.25.3", "auto", 80.0), (1, "3.26.4", "home", 85.0)],
        "epk long, need_id string, life_situation string, raw_score double",
    )
    levels = spark.createDataFrame([(1, 4)], "epk long, approval_level int")
    ranked = needs.product_ranking(scored, levels, first, catalog.PRODUCT_LEVELS)
    got = needs.with_situation(ranked, needs.situation_table(spark, catalog.situation_rules("x"))).orderBy("rank").collect()
    assert [(r.product, r.situation, r.sub_situation) for r in got] == [
        ("cooper", "trips", "default"), ("zls", "realEstate", "houseInsurance"), ("citydrive", "auto", "carsharing")
    ]


@pytest.mark.parametrize("level,want", [(3, ("", "")), (4, ("auto", "carRepair")), (6, ("auto", "carRepair"))])
def test_situation_rules_respect_levels(spark, level, want):
    ranked = spark.createDataFrame([("lifestyleGeneral", "2.30.3", level)], "product string, need_id string, approval_level int")
    r = needs.with_situation(ranked, needs.situation_table(spark, catalog.situation_rules())).head()
    assert (r.situation, r.sub_situation) == want


def test_house_brand_is_a_parameter():
    assert ("acmeHealth" in dict(catalog.product_needs("acme"))) and ("newAcmemobileSubscriber" in {r[5] for r in catalog.situation_rules("acme")})


def test_score_rules_are_first_match(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (0, 1, 10.0), (0, 0, 10.0)], "a int, b int, g double")
    rule = core_products.ScoreRule("s", F.col("a") == 1, F.col("g"), F.col("b") == 1, F.lit(2.0))
    assert [r.s for r in df.select(rule.column()).collect()] == [10.0, 5.2, 1.0]


def contacts(spark, rows):
    return spark.createDataFrame(rows, "epk long, b int, o int, c1 int, c2 int")


def test_four_and_five_classes(spark):
    df = contacts(spark, [(1, 2, 1, None, 0), (2, 2, None, 1, None), (3, None, 1, None, None), (4, None, None, 3, None),
                          (5, None, None, None, None), (6, 1, 1, None, None), (7, 1, None, 0, None)])
    four = {r.epk: r.target for r in targets.four_class(df, "b", "o", ["c1", "c2"]).collect()}
    assert four == {1: "1", 2: "2", 3: "3", 4: "4", 6: "1"}
    five = {r.epk: r.target for r in targets.five_class(df, "b", "o", ["c1", "c2"]).collect()}
    assert five == {1: "1", 2: "2", 5: "5", 6: "3"}
    compat = {r.epk: r.target for r in targets.five_class(df, "b", "o", ["c1", "c2"], strict=False).collect()}
    assert compat[7] == "4"


def test_targets_scan_their_input_once(spark):
    df = contacts(spark, [(1, 2, 1, None, 0)])
    plan = targets.five_class(df, "b", "o", ["c1"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Union" not in plan


def test_campaign_contacts_accepts_a_missing_type_only_when_listed(spark):
    df = spark.createDataFrame(
        [(1, "a", None, "c", 1, 1, 1), (1, "hot", "t", "c", 1, 1, 1), (2, "a", "t", "c", 99, 1, 1), (3, "a", "t", None, 1, 1, 1), (4, "a", "t", "c", 1, 1, 1)],
        "epk long, split string, product_type string, campaign string, days_to_sale int, offered int, accepted int",
    )
    run = lambda types: sorted(r.epk for r in targets.campaign_contacts(df, ["hot"], [], types, ["c"]).collect())
    assert run([None, "t"]) == [1, 4] and run(["t"]) == [4]


# --- correlation filters against brute force ----------------------------------------------------------------


def frame(spark, seed=0, n=200):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    data = np.column_stack([x[:, 0], x[:, 0] + 0.1 * x[:, 1], x[:, 1], x[:, 2], x[:, 2] * -2 + 0.05 * x[:, 0], x[:, 0] * 0.5 + x[:, 1] * 0.5])
    names = [f"c{i}" for i in range(data.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "epk long, " + ", ".join(f"{c} double" for c in names)), data, names


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99])
def test_greedy_filter(spark, threshold):
    df, data, names = frame(spark)
    m, kept = np.abs(np.corrcoef(data.T)), []
    for i in range(len(names)):
        if all(m[i][j] <= threshold for j in kept):
            kept.append(i)
    assert features.drop_correlated_greedy(df, threshold).columns == ["epk", *[names[i] for i in kept]]


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99])
def test_group_filter(spark, threshold):
    df, data, names = frame(spark)
    m = np.abs(np.corrcoef(data.T))
    reach = np.linalg.matrix_power((m > threshold).astype(int) + np.eye(len(names), dtype=int), 10) > 0
    groups = {tuple(np.flatnonzero(r)) for r in reach}
    want = {names[max(g, key=lambda i: m[i].sum())] for g in groups}
    assert set(features.drop_correlated_groups(df, threshold).columns) == {"epk", *want}


def test_visit_counts_include_the_first_day(spark):
    t = spark.createDataFrame([(1, A)], "epk long, report_dt string").withColumn("report_dt", F.col("report_dt").cast("date"))
    v = spark.createDataFrame([(1, dt.date(2026, 1, 30)), (1, dt.date(2026, 1, 29)), (2, dt.date(2020, 1, 1))], "epk long, dt date")
    assert [tuple(r) for r in features.visit_counts(t, v).collect()] == [(1, dt.date(2026, 4, 30), 1, 2)]


def test_closed_tags_do_not_count(spark):
    from clientscope.plans import tiers
    from clientscope.queries.client_plans import LEVEL_TAGS

    tag = LEVEL_TAGS[6][0]
    rows = [(1, tag, "9999-12-31", 0), (2, tag, "2024-01-05", 0), (3, tag, "9999-12-31", 1)]
    history = spark.createDataFrame(rows, "epk long, nsi_id string, row_actual_to_dt string, is_deleted int")
    assert {r.epk for r in tiers.free_tier(history, LEVEL_TAGS).collect()} == {1}
    opened = history.withColumn("row_actual_to_dt", F.lit("9999-12-31"))
    assert {r.epk for r in tiers.free_tier(opened, LEVEL_TAGS).collect()} == {1, 2}


def test_first_level_looks_at_all_lines(spark):
    names = "card metal_card subscription subscription_plus service_fee notify_fee cash_fee transfer bonus metal_account coins credit_card loan".split()
    base = {n: 0 for n in names} | {f"only_{p}_{x}": 0 for p in ("deposit", "savings") for x in ("first", "second", "third")}
    base |= {"avg_balance_3m": 60_000, "sum_sent_3m": 0, "avg_spend_3m": 0}
    base |= {f"{p}_{n}": 0 for p in ("card", "deposit", "savings", "bonus", "transfer") for n in (1, 4)}
    rows = [base | {"epk": 1}, base | {"epk": 2, "only_deposit_second": 1, "only_savings_third": 1}, base | {"epk": 3, "only_savings_first": 1}]
    values = {"card": 1, "deposit": 2, "savings": 6, "metal_account": 9, "credit_card": 8, "loan": 10}
    rules = core_products.level_rules(1, "first", values) + core_products.level_rules(4, "second", values, lending=True)
    got = {r.epk: r for r in core_products.product_scores(spark.createDataFrame(rows), rules).collect()}
    assert (got[1].score_deposit_1, got[1].score_savings_1) == (1.2, 3.6) and (got[2].score_deposit_1, got[2].score_savings_1) == (1.0, 1.0)
    assert got[1].score_savings_4 == 3.6 and got[3].score_savings_4 == 1.0 and got[1].score_credit_card_4 == 2.0


def test_two_writers_replace_periods_at_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    from clientscope.session import new_path
    from clientscope.sources.sinks import replace_period

    def rows(month, v):
        return spark.createDataFrame([(i, month, v) for i in range(20)], "epk long, report_dt string, v int")

    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    paths = [new_path(spark, "periods"), new_path(spark, "periods")]
    for p in paths:
        replace_period(rows("2024-01-31", 1).unionByName(rows("2024-02-29", 1)), p)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda p: replace_period(rows("2024-02-29", 2), p), paths))
    for p in paths:
        got = spark.read.parquet(p).groupBy("report_dt").agg(F.sum("v").alias("v")).collect()
        assert {str(r.report_dt): r.v for r in got} == {"2024-01-31": 20, "2024-02-29": 40}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_correlations_use_the_rows_that_have_both_values(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    x = pd.DataFrame(rng.normal(size=(400, 5)), columns=list("abcde"))
    x["b"] = x["a"] * 0.9 + x["b"] * 0.2 + 1e6
    x["e"] = 7.0
    x = x.mask(rng.random(x.shape) < 0.2)
    df = spark.createDataFrame(x).withColumn("c", F.when(F.col("c") > 1.5, None).otherwise(F.col("c")))
    want = x.assign(c=x["c"].where(~(x["c"] > 1.5))).corr().to_numpy()
    got = features.correlation_matrix(df, list("abcde"))
    assert np.allclose(got[:4, :4], want[:4, :4], atol=1e-9) and np.isnan(got[4]).all()
    assert len(features.drop_correlated_groups(df, 0.8, ()).columns) == 4
    kept = features.drop_correlated_greedy(df, 0.8, ()).columns
    assert kept == ["a", "c", "d", "e"]


def test_missing_features_do_not_stop_a_model(spark):
    from clientscope.ml import models as m

    rows = [(i, float(i % 2), None if i % 7 == 0 else float(i % 2), float("nan") if i % 5 == 0 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "epk long, target double, x double, y double")
    model = m.fit(m.forest(trees=3, depth=2), df, ["x", "y"], "target")
    assert m.predict(model, df, ["x", "y"], "target", "epk").count() == 60


def test_chain_reads_its_blocks_once_and_then_the_joined_rows(spark, tmp_path):
    from clientscope.plans.chain import recommendation_chain

    blocks = {
        "tier": lambda: spark.createDataFrame([(1, "FREE"), (2, "PAID"), (3, None)], "epk long, payment_status string"),
        "other": lambda: spark.createDataFrame([(2, 5.0)], "epk long, score double"),
    }
    made = recommendation_chain(spark, spark.range(1, 5).withColumnRenamed("id", "epk"), blocks, str(tmp_path))
    assert sorted(made.collect()) == [(1, "FREE", None), (2, "PAID", 5.0)]
    assert made.inputFiles() and all("/assembled/" in f for f in made.inputFiles())
