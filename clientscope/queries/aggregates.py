"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientscope.functions import dates as d
from clientscope.functions import predicates as p
from clientscope.operators import aggregate as a
from clientscope.operators import bitmaps as bm
from clientscope.queries.registry import query
from clientscope.sources import fixtures as fx
from clientscope.sources.sinks import stored

CATEGORIES = ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE", "NONE")


@query(
    "agg_group_basic",
    fx.with_views("pos_tx")
    + """select epk, round(sum(amt), 2) as total, max(amt) as largest, round(avg(amt), 4) as mean, count(*) as n
         from pos_tx group by epk""",
)
def agg_group_basic(spark, sf):
    return fx.pos_tx(spark, sf).groupBy("epk").agg(
        F.round(F.sum("amt"), 2).alias("total"),
        F.max("amt").alias("largest"),
        F.round(F.avg("amt"), 4).alias("mean"),
        F.count(F.lit(1)).alias("n"),
    )


@query("agg_global", "select round(avg(c_acctbal), 6) as avg_score, count(*) as n from customer")
def agg_global(spark, sf):
    return fx.table(spark, sf, "customer").agg(
        F.round(F.avg("c_acctbal"), 6).alias("avg_score"), F.count(F.lit(1)).alias("n")
    )


@query(
    "agg_distinct_count",
    "select o_orderstatus as payment_status, count(o_custkey) as n, count(distinct o_custkey) as clients from orders group by 1",
)
def agg_distinct_count(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("payment_status")).agg(
        F.count("o_custkey").alias("n"), F.countDistinct("o_custkey").alias("clients")
    )


@query(
    "agg_distinct_count_case",
    fx.with_views("tags")
    + """select epk, count(distinct case when nsi_id like 'view%' then nsi_id end) as view_tags,
                count(distinct case when nsi_id like 'click%' then nsi_id end) as click_tags
         from tags where row_actual_to_dt = '9999-12-31' and is_deleted = 0 group by epk""",
)
def agg_distinct_count_case(spark, sf):
    """Distinct (client, tag) first, then plain conditional counts: one exchange per step and no row expansion."""
    tags = fx.tags(spark, sf).where(p.is_current()).select("epk", "nsi_id").distinct()
    return a.count_and_flag(
        tags,
        ["epk"],
        {"view_tags": F.col("nsi_id").startswith("view"), "click_tags": F.col("nsi_id").startswith("click")},
    )


PIVOT_SQL = ", ".join(
    f"count(*) filter (mcc_code = '{c}') as {c.lower()}_cnt, "
    f"round(coalesce(sum(amt) filter (mcc_code = '{c}'), 0), 2) as {c.lower()}_amt"
    for c in CATEGORIES
)


@query(
    "agg_conditional_pivot",
    fx.with_views("pos_tx")
    + f"select epk, {PIVOT_SQL}, count(*) as all_cnt, round(sum(amt), 2) as all_amt from pos_tx group by epk",
)
def agg_conditional_pivot(spark, sf):
    wide = a.conditional_pivot(fx.pos_tx(spark, sf), ["epk"], "mcc_code", CATEGORIES, "amt")
    return wide.select("epk", *[(F.round(c, 2) if c.endswith("_amt") else F.col(c)).alias(c.lower()) for c in wide.columns[1:]])


@query(
    "agg_two_level",
    fx.with_views("pos_tx acq_tx")
    + """select epk, cast(sum(n) as bigint) as n, round(sum(s), 2) as amt, cast(sum(big) as bigint) as big from (
            select epk, 'pos' as src, count(*) as n, sum(amt) as s, sum(case when amt > 50000 then 1 else 0 end) as big
            from pos_tx group by 1
            union all select epk, 'acq', count(*), sum(amt), sum(case when amt > 50000 then 1 else 0 end)
            from acq_tx group by 1) group by epk""",
)
def agg_two_level(spark, sf):
    """Partial and final aggregation of one ``groupBy`` already are the two levels."""
    both = fx.pos_tx(spark, sf).select("epk", "amt").unionByName(fx.acq_tx(spark, sf).select("epk", "amt"))
    return both.groupBy("epk").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("amt"), 2).alias("amt"),
        F.count(F.when(F.col("amt") > 50000, 1)).alias("big"),
    )


@query(
    "agg_max_flags",
    fx.with_views("pos_tx")
    + """select c_custkey as epk, max(coalesce(case when mcc_code = 'ECONOMY' then 1 end, 0)) as economy,
                max(coalesce(case when amt > 90000 then 1 end, 0)) as large from customer
         left join pos_tx t on t.epk = c_custkey
         group by 1""",
)
def agg_max_flags(spark, sf):
    tx = fx.pos_tx(spark, sf)
    flags = a.max_flags(
        tx.select(
            "epk",
            F.when(tx.mcc_code == "ECONOMY", 1).alias("economy"),
            F.when(tx.amt > 90000, 1).alias("large"),
        ),
        "epk",
        ["economy", "large"],
    )
    base = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("epk"))
    return base.join(flags, "epk", "left").na.fill(0, ["economy", "large"])


@query("agg_distinct_rows", "select distinct o_custkey as epk, o_orderstatus, o_orderpriority from orders")
def agg_distinct_rows(spark, sf):
    return fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("epk"), "o_orderstatus", "o_orderpriority").distinct()


@query(
    "agg_having",
    """select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) = 1""",
)
def agg_having(spark, sf):
    return (
        fx.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("cnt"))
        .where("cnt = 1").drop("cnt")
    )


@query(
    "agg_month_end_rollup",
    fx.with_views("pos_tx")
    + """select last_day(dt) as report_dt, epk, round(sum(v), 2) as sum_val, count(case when v > 0 then v end) as qty_val
         from (select epk, dt, amt - 50000 as v from pos_tx) group by 1, 2""",
)
def agg_month_end_rollup(spark, sf):
    from clientscope.plans.features import month_end_rollup

    tx = fx.pos_tx(spark, sf).select("epk", "dt", (F.col("amt") - 50000).alias("v"))
    out = month_end_rollup(tx, "v", "val")
    return out.withColumn("sum_val", F.round("sum_val", 2))


def calls(spark, sf):
    """Activities with a duration. The end comes from the amount column, so no order over a client is needed."""
    return fx.table(spark, sf, "events").select(
        F.col("user_id").alias("epk"),
        F.col("ts").alias("start"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))).alias("end"),
        "event_type",
    )


@query(
    "agg_duration_conditional",
    """select user_id as epk, cast(ts as date) as activity_dt,
              count(*) filter (event_type in ('view', 'click')) as is_call,
              count(*) filter (event_type in ('view', 'click') and value >= 60) as is_call_60,
              count(*) filter (event_type = 'purchase' and value >= 60) as is_meet_60
       from events where event_type <> 'error' group by 1, 2""",
)
def agg_duration_conditional(spark, sf):
    from clientscope.plans.targets import manager_activity

    # The duration is played by the value column: the activity ends that many seconds after its start.
    return manager_activity(
        calls(spark, sf).where("event_type <> 'error'"),
        is_call=F.col("event_type").isin("view", "click"),
        is_meeting=F.col("event_type") == "purchase",
    )


@query(
    "agg_call_status",
    """select user_id as epk, cast(ts as date) as activity_dt, count(*) filter (value > 50) as is_call,
              count(*) filter (value >= 100 or (value > 50 and event_type = 'purchase')) as is_call_success, 0 as is_meet
       from events group by 1, 2""",
)
def agg_call_status(spark, sf):
    from clientscope.plans.targets import remote_calls

    ev = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("epk"), F.col("ts").cast("date").alias("activity_dt"), (F.col("value") - 50).alias("seconds"),
        (F.col("event_type") == "purchase").alias("answered"),
    )
    return remote_calls(ev, success_seconds=50)


@query(
    "agg_period_counts",
    fx.with_views("pos_tx", "d as (select unnest([date '1998-10-31', date '1998-11-30', date '1998-12-31']) as report_dt)")
    + """select epk, report_dt, count(*) filter (dt >= cast(report_dt - interval 3 month as date)) as visits_3m,
                count(*) as visits_12m
         from pos_tx join d on dt between cast(report_dt - interval 12 month as date) and report_dt group by 1, 2""",
)
def agg_period_counts(spark, sf):
    from clientscope.plans.features import visit_counts
    from clientscope.queries.rolling import every_client

    return visit_counts(every_client(spark, sf), fx.pos_tx(spark, sf).select("epk", "dt"))


@query(
    "agg_campaign_monthly",
    """select last_day(cast(o_orderdate as date)) as month, o_orderpriority as campaign,
              case when l_returnflag = 'R' then 1 else 0 end as flag, count(distinct o_custkey) as clients
       from orders join lineitem on o_orderkey = l_orderkey
       where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1999-01-01' group by 1, 2, 3""",
)
def agg_campaign_monthly(spark, sf):
    o = fx.table(spark, sf, "orders").where(
        "o_orderdate >= timestamp_ntz'1998-01-01' and o_orderdate < timestamp_ntz'1999-01-01'"
    )
    return (
        o.join(fx.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(
            F.last_day(F.col("o_orderdate").cast("date")).alias("month"),
            F.col("o_orderpriority").alias("campaign"),
            p.flag(F.col("l_returnflag") == "R").alias("flag"),
        )
        .agg(F.countDistinct("o_custkey").alias("clients"))
    )


CAMPAIGN_FACTS = """f as (select last_day(cast(o_orderdate as date)) as month, o_orderpriority as campaign, l_returnflag = 'R' as flag, o_custkey as epk
    from orders join lineitem on o_orderkey = l_orderkey)"""


@query(
    "agg_distinct_bitmaps",
    f"""with {CAMPAIGN_FACTS}
        select cast(month as varchar) as period, campaign, count(distinct epk) as clients from f group by 1, 2
        union all select 'all months', campaign, count(distinct epk) from f group by campaign
        union all select 'all flags', campaign, count(*) from (select campaign, epk from f group by 1, 2 having count(distinct flag) = 2) group by campaign""",
)
def agg_distinct_bitmaps(spark, sf):
    """Clients per month and campaign as bits; months and flags are then united and met without the facts."""
    facts = fx.table(spark, sf, "orders").join(fx.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.last_day(F.col("o_orderdate").cast("date")).cast("string").alias("month"), F.col("o_orderpriority").alias("campaign"),
        (F.col("l_returnflag") == "R").alias("flag"), F.col("o_custkey").alias("epk"),
    )
    bits = stored(bm.client_bitmaps(facts, ["month", "campaign", "flag"], "epk"), "bitmaps")
    monthly = bm.clients(bm.merged(bits, ["month", "campaign"]), ["month", "campaign"]).withColumnRenamed("month", "period")
    every = bm.clients(bm.merged(bits, ["campaign"]), ["campaign"]).select(F.lit("all months").alias("period"), "campaign", "clients")
    flags = bm.common(bm.merged(bits, ["campaign", "flag"]), ["campaign"], "flag")
    both = bm.clients(flags, ["campaign"]).select(F.lit("all flags").alias("period"), "campaign", "clients")
    return monthly.unionByName(every).unionByName(both)


SHARE_SQL = ", ".join(
    f"round(count(*) filter (mcc_code = '{c}') / count(*), 6) as {c.lower()}_cnt_share, "
    f"round(coalesce(sum(amt) filter (mcc_code = '{c}'), 0) / nullif(sum(amt), 0), 6) as {c.lower()}_amt_share"
    for c in CATEGORIES
)


@query("agg_share_of_total", fx.with_views("pos_tx") + f"select epk, {SHARE_SQL} from pos_tx group by epk")
def agg_share_of_total(spark, sf):
    wide = a.conditional_pivot(fx.pos_tx(spark, sf), ["epk"], "mcc_code", CATEGORIES, "amt")
    shares = wide.select("epk", *a.share_columns(CATEGORIES))
    return shares.select("epk", *[F.round(c, 6).alias(c.lower()) for c in shares.columns[1:]])


BUCKET_SQL = """select epk, max(case when dt > date '1998-11-30' and dt <= date '1998-12-31' then 1 else 0 end) as spend_m1,
    max(case when dt > date '1998-10-31' and dt <= date '1998-11-30' then 1 else 0 end) as spend_m2,
    max(case when dt > date '1998-09-30' and dt <= date '1998-10-31' then 1 else 0 end) as spend_m3
    from pos_tx where dt between date '1998-09-30' and date '1998-12-31' group by epk"""


def month_flags(spark, sf):
    tx = fx.pos_tx(spark, sf, "1998-09-30", fx.ANCHOR)
    bucket = F.coalesce(d.month_end_bucket(F.col("dt"), fx.ANCHOR), F.lit(0))
    return tx.groupBy("epk").agg(*a.active_month_flags(bucket, F.col("amt"), "spend"))


@query("agg_month_bucket_flags", fx.with_views("pos_tx") + BUCKET_SQL)
def agg_month_bucket_flags(spark, sf):
    return month_flags(spark, sf)


@query(
    "agg_regularity_flag",
    fx.with_views("pos_tx")
    + f"select epk, case when spend_m1 + spend_m2 + spend_m3 >= 2 then 1 else 0 end as regular from ({BUCKET_SQL})",
)
def agg_regularity_flag(spark, sf):
    return month_flags(spark, sf).select("epk", a.regular("spend").alias("regular"))


@query("agg_value_counts", "select quality as target, toxic as flag, count(*) as n from labels group by 1, 2 order by 1, 2")
def agg_value_counts(spark, sf):
    return (
        fx.table(spark, sf, "labels")
        .groupBy(F.col("quality").alias("target"), F.col("toxic").alias("flag"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("target", "flag")
    )


@query(
    "agg_masked_group_means",
    fx.with_views("features_wide")
    + "select target, "
    + ", ".join(f"round(avg(case when f{k} > -0.2 and f{k} < 0.25 then f{k} end), 6) as f{k}" for k in range(64))
    + " from features_wide group by target",
)
def agg_masked_group_means(spark, sf):
    names = [f"f{k}" for k in range(64)]
    means = a.masked_means(fx.features_wide(spark, sf), "target", names, -0.2, 0.25)
    return means.select("target", *[F.round(c, 6).alias(c) for c in names])


@query(
    "agg_pattern_counts",
    fx.with_views("daily_contacts")
    + """select count(*) filter ((error is null or error = 0) and (signup is null or signup = 0)
                                 and "view" is not null and click is not null) as no_contact_both,
                count(*) filter ("view" is null and click is not null and (error is null or signup is null)) as click_only
         from daily_contacts""",
)
def agg_pattern_counts(spark, sf):
    """All patterns counted in one scan."""
    view, click = F.col("view"), F.col("click")
    return fx.daily_contacts(spark, sf).agg(
        F.count(F.when(p.none_of_counts(["error", "signup"]) & view.isNotNull() & click.isNotNull(), 1)).alias("no_contact_both"),
        F.count(F.when(view.isNull() & click.isNotNull() & (F.isnull("error") | F.isnull("signup")), 1)).alias("click_only"),
    )
