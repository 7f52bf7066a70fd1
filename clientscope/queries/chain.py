"""Composed jobs: the recommendation chain, recent need scores and scoring from the raw snapshot to the stored period."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientscope.functions.columns import prepare
from clientscope.ml import models as m
from clientscope.plans import chain, needs
from clientscope.queries import category_plans, client_plans
from clientscope.queries.models import MULTI, multi_forest
from clientscope.queries.registry import ORACLES, query
from clientscope.session import new_path
from clientscope.sources import fixtures as fx
from clientscope.sources.sinks import replace_period

# Step name: (query, columns after the client key, as they are called in the result).
STEPS = {
    "tier": (client_plans.client_paid_tier, {"approval_level": "approval_level", "payment_status": "payment_status"}),
    "benefit": (
        client_plans.client_benefit_rollup,
        {"sum_benefit_rubles_lvl1": "rubles", "sum_benefit_bonuses_lvl1": "bonuses"},
    ),
    "core": (client_plans.core_product_scores, {"score_card_1": "card", "score_deposit_1": "deposit", "score_loan_4": "loan"}),
    "needs": (
        client_plans.need_product_topn,
        {f"top{i}_{c}": f"top{i}_{c}" for i in range(1, 4) for c in ("product", "raw_score")},
    ),
    "lifestyle": (category_plans.lifestyle_top_category, {"top_category": "top_category"}),
    "situation": (category_plans.life_situation_top, {"lifestyle_situation": "situation"}),
    "sub_situation": (category_plans.life_sub_situation, {"lifestyle_sub_situation": "sub_situation"}),
}


def chain_sql() -> str:
    columns = ", ".join(f"{name}.{c} as {out}" for name, (_, cs) in STEPS.items() for c, out in cs.items())
    joins = " ".join(f"left join ({ORACLES[fn.__name__]}) {name} on {name}.epk = c_custkey" for name, (fn, _) in STEPS.items())
    return f"""with j as (select c_custkey as epk, {columns} from customer {joins})
        select distinct * from j where payment_status = 'FREE'
        or (payment_status = 'PAID' and epk not in (select epk from j where payment_status = 'FREE'))"""


@query("recommendation_chain", chain_sql())
def recommendation_chain(spark, sf):
    def step(fn, columns):
        return lambda: fn(spark, sf).select("epk", *[F.col(c).alias(out) for c, out in columns.items()])

    clients = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("epk"))
    steps = {name: step(fn, columns) for name, (fn, columns) in STEPS.items()}
    return chain.recommendation_chain(spark, clients, steps, new_path(spark, "chain"))


WANTED = tuple(f"Brand#{i}" for i in range(1, 21))


@query(
    "recent_need_scores",
    fx.with_views("pos_tx")
    + """, dict as (select distinct p_brand as model_id, p_brand as need_id, p_type as life_situation,
                          case when p_brand like '%5' then 'other_' else 'client_' end || lower(p_brand) as model_name from part),
           best as (select epk, brand_code as model_id, max(amt / 1000) as raw_score from pos_tx
                    where dt between date '1998-12-17' and date '1998-12-31' group by 1, 2)
         select epk, need_id, life_situation, round(max(raw_score), 5) as raw_score from best join dict using (model_id)
         where model_name like 'client%' and cast(substr(need_id, 7) as int) between 1 and 20 group by 1, 2, 3""",
)
def recent_need_scores(spark, sf):
    scores = fx.pos_tx(spark, sf, "1998-12-17", fx.ANCHOR).select(
        "epk", F.col("brand_code").alias("model_id"), (F.col("amt") / 1000).alias("raw_score"), F.col("dt").alias("scoring_dt")
    )
    brand = F.col("p_brand")
    dictionary = fx.table(spark, sf, "part").select(
        brand.alias("model_id"), brand.alias("need_id"), F.col("p_type").alias("life_situation"),
        F.concat(F.when(brand.endswith("5"), "other_").otherwise("client_"), F.lower(brand)).alias("model_name"),
    ).distinct()
    found = needs.recent_needs(scores, dictionary, fx.ANCHOR, WANTED, "client%")
    return found.withColumn("raw_score", F.round("raw_score", 5))


PERIODS = ("1998-11-30", fx.ANCHOR)
SCORED = ("balance_amt", "order_qty", "last_order_dt")
SCORE_WEIGHTS, SCORE_BASE = (0.5, 2.0, 0.25), 1.0


def raw_snapshot(spark, sf, report_dt):
    """Columns as a snapshot has them: mixed case, gaps, dates, texts and technical keys."""
    orders = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("epk")).agg(
        F.count(F.lit(1)).cast("double").alias("Order_QTY"), F.max("o_orderdate").cast("date").alias("Last_Order_DT")
    )
    c = fx.table(spark, sf, "customer")
    base = c.select(
        F.col("c_custkey").alias("epk"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("Balance_AMT"),
        F.col("c_mktsegment").alias("Segment_CD"), F.col("c_nationkey").alias("Nation_ID"),
    )
    return base.join(orders, "epk", "left").withColumn("report_dt", F.lit(report_dt).cast("date"))


@query(
    "score_pipeline_binary",
    """with o as (select o_custkey as epk, cast(count(*) as double) as q, max(cast(o_orderdate as date)) as d from orders group by 1),
            p as (select unnest([date '1998-11-30', date '1998-12-31']) as report_dt)
       select c_custkey as epk, cast(report_dt as varchar) as report_dt,
              round(coalesce(case when c_acctbal >= 0 then c_acctbal end, -999999) * 0.5::double + coalesce(q, -999999) * 2.0::double
                    + coalesce(date_diff('day', d, report_dt), -999999) * 0.25::double + 1.0::double, 6) as score
       from customer left join o on o.epk = c_custkey cross join p""",
)
def score_pipeline_binary(spark, sf):
    """Only the needed columns, prepared and scored, replace their period; the last period is run twice."""
    path = new_path(spark, "scores")
    for period in (*PERIODS, PERIODS[-1]):
        raw = raw_snapshot(spark, sf, period).select("epk", "report_dt", *SCORED)
        scored = m.score_with(prepare(raw), list(SCORED), m.linear_scorer(list(SCORE_WEIGHTS), SCORE_BASE), period)
        stored = replace_period(scored, path)
    return stored.select("epk", F.col("report_dt").cast("string").alias("report_dt"), F.round("score", 6).alias("score"))


@query(
    "score_pipeline_multiclass",
    "select vec_id as epk, '1998-12-31' as report_dt, 10 as classes, 1 as sums_to_one from embeddings",
)
def score_pipeline_multiclass(spark, sf):
    """Features with gaps are prepared, scored by the fitted model and stored; every row has ten probabilities."""
    gaps = fx.features_wide(spark, sf).withColumn("f0", F.when(F.col("epk") % 9 != 0, F.col("f0"))).drop("target")
    prepared = prepare(gaps.withColumn("report_dt", F.lit(fx.ANCHOR).cast("date")))
    scored = m.score_multiclass(multi_forest(spark, sf), prepared, MULTI, list(range(1, 11)), fx.ANCHOR)
    stored = replace_period(scored, new_path(spark, "cluster-scores"))
    scores = F.array(*[F.col(f"cluster_{k}_score") for k in range(1, 11)])
    total = F.aggregate(scores, F.lit(0.0).cast("double"), lambda s, x: s + x)
    return stored.select(
        "epk", F.col("report_dt").cast("string").alias("report_dt"), F.size(scores).alias("classes"),
        F.when(F.abs(total - 1) < 1e-4, 1).otherwise(0).alias("sums_to_one"),
    )
