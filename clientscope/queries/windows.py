"""Ranking, gaps, cumulative counts, top shares and samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clientscope.functions.numbers import gap_percent
from clientscope.functions.predicates import flag
from clientscope.operators import ranking as r
from clientscope.operators import windows as w
from clientscope.queries.registry import query
from clientscope.sources import fixtures as fx

PER_SQL = """per as (select epk, mcc_code as category, round(sum(amt), 2) as score from pos_tx group by 1, 2)"""
RANKED_SQL = """r as (select *, row_number() over (partition by epk order by score desc, category) as rn,
                             lead(score) over (partition by epk order by score desc, category) as second_score from per)"""


def per_category(spark, sf):
    """One row per client and category: a bounded number of rows per client whatever their spending."""
    return (
        fx.pos_tx(spark, sf)
        .groupBy("epk", F.col("mcc_code").alias("category"))
        .agg(F.round(F.sum("amt"), 2).alias("score"))
    )


@query("win_row_number_tiebreak", fx.with_views("pos_tx", PER_SQL, RANKED_SQL) + "select epk, category, score, rn from r")
def win_row_number_tiebreak(spark, sf):
    ranked = w.rank_in_client(per_category(spark, sf), "epk", [F.col("score").desc(), F.col("category")])
    return ranked.withColumn("rn", F.col("rn").cast("bigint"))


@query(
    "win_dedupe_cascade",
    fx.with_views("needs")
    + """, a as (select *, left(need_id, 7) as product, row_number() over (partition by epk, left(need_id, 7)
                 order by raw_score desc, need_id desc) as p from needs),
           b as (select *, row_number() over (partition by epk, life_situation
                 order by raw_score desc, product desc) as s from a where p = 1)
         select epk, product, need_id, life_situation, round(raw_score, 5) as raw_score,
                row_number() over (partition by epk order by raw_score desc, product) as rank_num from b where s = 1""",
)
def win_dedupe_cascade(spark, sf):
    from clientscope.plans.needs import best_per_product, best_per_situation

    scored = fx.needs(spark, sf).withColumn("product", F.substring("need_id", 1, 7))
    best = best_per_situation(best_per_product(scored))
    ranked = w.rank_in_client(best, "epk", [F.col("raw_score").desc(), F.col("product")], "rank_num")
    return ranked.select(
        "epk", "product", "need_id", "life_situation", F.round("raw_score", 5).alias("raw_score"),
        F.col("rank_num").cast("bigint").alias("rank_num"),
    )


@query(
    "win_topn_pivot",
    fx.with_views("needs")
    + ", r as (select *, row_number() over (partition by epk order by raw_score desc, need_id) as rn from needs) select epk, "
    + ", ".join(
        f"max(case when rn = {i} then need_id end) as top{i}_need_id, "
        f"round(max(case when rn = {i} then raw_score end), 5) as top{i}_raw_score"
        for i in range(1, 8)
    )
    + " from r group by epk",
)
def win_topn_pivot(spark, sf):
    ranked = w.rank_in_client(fx.needs(spark, sf), "epk", [F.col("raw_score").desc(), F.col("need_id")])
    wide = w.wide_top(ranked, "epk", "rn", 7, ["need_id", "raw_score"])
    return wide.select("epk", *[(F.round(c, 5) if c.endswith("score") else F.col(c)).alias(c) for c in wide.columns[1:]])


@query(
    "win_lead_runner_up",
    fx.with_views("pos_tx", PER_SQL, RANKED_SQL) + "select epk, category, score, second_score from r where rn = 1",
)
def win_lead_runner_up(spark, sf):
    return w.with_runner_up(per_category(spark, sf), "epk", "score", "category").where("rn = 1").drop("rn")


@query(
    "win_first_last_full_frame",
    fx.with_views("pos_tx", PER_SQL, RANKED_SQL)
    + """select epk, category, score, first_value(score) over w as best, last_value(score) over w as worst,
                round(abs(first_value(score) over w - last_value(score) over w) * 100
                      / nullif(first_value(score) over w, 0), 6) as diff_pct
         from r where rn <= 2 window w as (partition by epk order by score desc, category
                                           rows between unbounded preceding and unbounded following)""",
)
def win_first_last_full_frame(spark, sf):
    two = w.rank_in_client(per_category(spark, sf), "epk", [F.col("score").desc(), F.col("category")]).where("rn <= 2")
    full = W.partitionBy("epk").orderBy(F.col("score").desc(), "category").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )
    return two.select(
        "epk", "category", "score", F.first("score").over(full).alias("best"), F.last("score").over(full).alias("worst")
    ).withColumn("diff_pct", F.round(F.try_divide(F.abs(F.col("best") - F.col("worst")) * 100, F.col("best")), 6))


TOP2_SQL = """select epk, max(case when rn = 1 then category end) as top1_category, max(case when rn = 1 then score end) as top1_score,
    max(case when rn = 2 then category end) as top2_category, max(case when rn = 2 then score end) as top2_score from r group by epk"""


@query("win_top2_collapse", fx.with_views("pos_tx", PER_SQL, RANKED_SQL) + TOP2_SQL)
def win_top2_collapse(spark, sf):
    return w.top_two(per_category(spark, sf), "epk", "category", "score").drop("gap_pct")


@query(
    "win_gap_percent",
    fx.with_views("pos_tx", PER_SQL, RANKED_SQL)
    + f"""select epk, round((top1_score - coalesce(top2_score, 0)) * 100 / nullif(top1_score, 0), 6) as gap_pct,
                 case when (top1_score - coalesce(top2_score, 0)) * 100 / nullif(top1_score, 0) < 10 then 1 else 0 end as close_race
          from ({TOP2_SQL})""",
)
def win_gap_percent(spark, sf):
    gap = w.top_two(per_category(spark, sf), "epk", "category", "score").select(
        "epk", gap_percent(F.col("top1_score"), F.coalesce("top2_score", F.lit(0.0))).alias("gap_pct")
    )
    return gap.select("epk", F.round("gap_pct", 6).alias("gap_pct"), flag(F.col("gap_pct") < 10).alias("close_race"))


@query(
    "win_cumulative_counts",
    fx.with_views("binary_scored")
    + """select score, pos, neg, cast(sum(pos) over (order by score desc) as bigint) as tp,
                cast(sum(neg) over (order by score desc) as bigint) as fp
         from (select floor(score / 500) as score, cast(sum(y) as bigint) as pos, cast(sum(1 - y) as bigint) as neg
               from binary_scored group by 1)""",
)
def win_cumulative_counts(spark, sf):
    tied = fx.binary_scored(spark, sf).withColumn("score", F.floor(F.col("score") / 500).cast("double"))
    return r.cumulative_counts(tied, "score", F.col("y") == 1)


@query("sort_result", "select report_dt, target, n from (select last_day(cast(o_orderdate as date)) as report_dt, "
       "o_orderstatus as target, count(*) as n from orders group by 1, 2) order by 1, 2")  # fmt: skip
def sort_result(spark, sf):
    return (
        fx.table(spark, sf, "orders")
        .groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("report_dt"), F.col("o_orderstatus").alias("target"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("report_dt", "target")
    )


def sample_sql(table, key, n, seed):
    return f"select {key} from {table} order by md5({key} || '|{seed}') limit {n}"


@query("sample_random_limit", sample_sql("orders", "o_orderkey", 1000, "7"))
def sample_random_limit(spark, sf):
    return r.sample_rows(fx.table(spark, sf, "orders").select("o_orderkey"), 1000, "o_orderkey", "7")


@query("sample_fixed_n", sample_sql("events", "event_id", 500, "0"))
def sample_fixed_n(spark, sf):
    return r.sample_rows(fx.table(spark, sf, "events").select("event_id"), 500, "event_id", "0")


@query(
    "topk_share",
    fx.with_views("binary_scored")
    + """select id, score, rank from (select id, floor(score / 500) as score,
              row_number() over (order by floor(score / 500) desc, id) as rank, count(*) over () as n from binary_scored)
         where rank <= floor(n * 0.1::double)""",
)
def topk_share(spark, sf):
    tied = fx.binary_scored(spark, sf).select("id", F.floor(F.col("score") / 500).cast("double").alias("score"))
    return r.top_share(tied, "score", "id", 0.1)
