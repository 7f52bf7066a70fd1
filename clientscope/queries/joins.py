"""Join shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientscope.functions import dates as d
from clientscope.functions.predicates import is_current
from clientscope.operators import joins as j
from clientscope.queries.registry import query
from clientscope.queries.scans import LEVELS_SQL, levels
from clientscope.sources import fixtures as fx



def customers(spark, sf, *more):
    return fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("epk"), *more)


def spend(spark, sf, name="amt", start=None, end=None):
    """Spend per client, aggregated before any join."""
    return fx.pos_tx(spark, sf, start, end).groupBy("epk").agg(
        F.round(F.sum("amt"), 2).alias(name), F.count(F.lit(1)).alias(f"{name}_n")
    )


@query(
    "join_inner",
    """select o_orderkey, o_custkey as epk, c_mktsegment, o_totalprice from orders join customer on o_custkey = c_custkey""",
)
def join_inner(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.join(fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_custkey").alias("epk"), "c_mktsegment", "o_totalprice"
    )


CHAIN_SQL = (
    fx.with_views("pos_tx acq_tx contacts tags")
    + f""", a as (select epk, round(sum(amt), 2) as pos_amt, count(*) as pos_amt_n from pos_tx group by 1),
           b as (select epk, round(sum(amt), 2) as acq_amt from acq_tx where status = 'F' group by 1),
           t as (select epk, count(distinct nsi_id) as tags from tags
                 where row_actual_to_dt = '9999-12-31' and is_deleted = 0 group by 1)
         select c_custkey as epk, pos_amt, pos_amt_n, acq_amt, tags, "view", click from customer
         left join a on a.epk = c_custkey left join b on b.epk = c_custkey left join t on t.epk = c_custkey
         left join contacts c on c.epk = c_custkey"""
)


@query("join_left_chain", CHAIN_SQL)
def join_left_chain(spark, sf):
    acq = fx.acq_tx(spark, sf).where("status = 'F'").groupBy("epk").agg(F.round(F.sum("amt"), 2).alias("acq_amt"))
    tags = fx.tags(spark, sf).where(is_current()).groupBy("epk").agg(F.countDistinct("nsi_id").alias("tags"))
    contacts = fx.contacts(spark, sf).select("epk", "view", "click")
    return j.left_chain(customers(spark, sf), [spend(spark, sf, "pos_amt"), acq, tags, contacts], "epk")


@query(
    "join_right_case_sum",
    fx.with_views("pos_tx")
    + """select c_custkey as epk, round(sum(case when mcc_code in ('ECONOMY', 'PROMO') then amt end), 2) as transfer
         from (select * from pos_tx where dt >= date '1998-11-01' and dt < date '1998-12-01') t
         right join customer on t.epk = c_custkey group by c_custkey""",
)
def join_right_case_sum(spark, sf):
    """The sums are taken per client before the join, so a heavy client never widens the joined rows."""
    tx = fx.pos_tx(spark, sf, "1998-11-01", "1998-11-30")
    sums = tx.where(d.in_previous_month(tx.dt, fx.ANCHOR)).groupBy("epk").agg(
        F.round(F.sum(F.when(F.col("mcc_code").isin("ECONOMY", "PROMO"), F.col("amt"))), 2).alias("transfer")
    )
    return customers(spark, sf).join(sums, "epk", "left")


@query(
    "join_left_where_inner",
    """select c_custkey as epk, o_orderkey, o_totalprice from customer left join orders on o_custkey = c_custkey
       where o_orderstatus = 'F' and o_totalprice > 100000""",
)
def join_left_where_inner(spark, sf):
    """A condition on the right side of a left join makes it an inner join, so it is written as one."""
    o = fx.table(spark, sf, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000")
    return customers(spark, sf).join(
        o.select(F.col("o_custkey").alias("epk"), "o_orderkey", "o_totalprice"), "epk"
    )


@query(
    "join_anti_not_exists",
    f"with {LEVELS_SQL} select * from levels a where payment_status = 'PAID' and not exists "
    "(select 1 from levels b where b.payment_status = 'FREE' and b.epk = a.epk)",
)
def join_anti_not_exists(spark, sf):
    lv = levels(spark, sf)
    return lv.where("payment_status = 'PAID'").join(lv.where("payment_status = 'FREE'"), "epk", "left_anti")


@query(
    "join_anti_not_in",
    """with k as (select case when event_type = 'view' then null else user_id end as epk from events)
       select 'with_nulls' as case_name, count(*) as n from customer where c_custkey not in (select epk from k)
       union all
       select 'without_nulls', count(*) from customer
       where c_custkey not in (select epk from k where epk is not null)""",
)
def join_anti_not_in(spark, sf):
    keys = fx.table(spark, sf, "events").select(
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("epk")
    )
    base = customers(spark, sf)

    def counted(name, other):
        return j.not_in(base, other, "epk").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("case_name"), "n")

    return counted("with_nulls", keys).unionByName(counted("without_nulls", keys.where("epk is not null")))


@query(
    "join_semi_unique_keys",
    """with o as (select o_custkey || '|' || last_day(cast(o_orderdate as date)) as client_month, o_custkey as epk, o_orderkey from orders)
       select * from o where client_month in (select client_month from o group by 1 having count(*) = 1)""",
)
def join_semi_unique_keys(spark, sf):
    """The orders of clients who ordered once in a month, over all months."""
    month = F.last_day(F.col("o_orderdate").cast("date")).cast("string")
    o = fx.table(spark, sf, "orders").select(F.concat_ws("|", F.col("o_custkey").cast("string"), month).alias("client_month"), F.col("o_custkey").alias("epk"), "o_orderkey")
    return j.keys_seen_once(o, "client_month")


@query(
    "join_cross_params",
    fx.with_views("pos_tx", "params as (select date '1998-12-31' as dt0, date '1998-11-30' as m1_end)")
    + """select epk, count(*) as n, round(sum(amt), 2) as amt from pos_tx cross join params p
         where dt > p.m1_end and dt <= p.dt0 group by epk""",
)
def join_cross_params(spark, sf):
    """Parameters are literals in the filter; no one-row table is joined."""
    tx = fx.pos_tx(spark, sf, "1998-12-01", fx.ANCHOR)
    return (
        tx.where((tx.dt > d.shift_month_end(fx.ANCHOR, -1)) & (tx.dt <= d.day(fx.ANCHOR)))
        .groupBy("epk")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amt"), 2).alias("amt"))
    )


@query(
    "join_scalar_subquery",
    """select c_custkey as epk, c_acctbal as balance from customer
       where c_acctbal >= (select avg(c_acctbal) from customer)""",
)
def join_scalar_subquery(spark, sf):
    c = customers(spark, sf, F.col("c_acctbal").alias("balance"))
    return c.where(F.col("balance") >= c.agg(F.avg("balance")).scalar())


@query(
    "join_interval",
    fx.with_views("snap_cust")
    + """, t as (select c_custkey as epk, cast(m as date) as report_dt from customer,
                 (values (date '1998-11-30'), (date '1998-12-31')) v(m) where c_mktsegment = 'BUILDING')
         select t.epk, t.report_dt, count(s.cnt) as months, round(coalesce(sum(s.amt), 0), 2) as amt
         from snap_cust s right join t on s.epk = t.epk and s.report_dt <= t.report_dt
              and s.report_dt >= cast(t.report_dt - interval 11 month as date) group by 1, 2""",
)
def join_interval(spark, sf):
    building = customers(spark, sf, "c_mktsegment").where("c_mktsegment = 'BUILDING'")
    t = building.select(
        "epk", F.explode(F.array(F.lit("1998-11-30").cast("date"), F.lit("1998-12-31").cast("date"))).alias("report_dt")
    )
    hist = fx.snap_cust(spark, sf, "1997-12-01", fx.ANCHOR).withColumnRenamed("report_dt", "dt")
    return j.join_recent(hist, t, 12).groupBy("epk", "report_dt").agg(
        F.count("cnt").alias("months"), F.round(F.coalesce(F.sum("amt"), F.lit(0.0)), 2).alias("amt")
    )


@query(
    "join_multi_window_self",
    fx.with_views("snap_sup")
    + """, t as (select epk, report_dt from snap_sup where report_dt = date '1998-12-31')
         select t.epk, round(sum(case when s.report_dt >= date '1998-10-31' then s.amt end), 2) as amt_sum_3m,
                round(sum(case when s.report_dt >= date '1998-07-31' then s.amt end), 2) as amt_sum_6m,
                round(sum(s.amt), 2) as amt_sum_12m
         from t join snap_sup s on s.epk = t.epk and s.report_dt between date '1998-01-31' and t.report_dt group by 1""",
)
def join_multi_window_self(spark, sf):
    """One join for all windows; the snapshot is scanned, aggregated and shuffled once per side."""
    from clientscope.operators.rolling import rolling_windows

    snap = fx.snap_sup(spark, sf, "1998-01-01", fx.ANCHOR)
    t = fx.snap_sup(spark, sf, "1998-12-01", fx.ANCHOR).select("epk", "report_dt")
    out = rolling_windows(t, snap, ["amt"], windows=(3, 6, 12), aggs=("sum",), ratios=False, prune=False)
    return out.select("epk", *[F.round(f"amt_sum_{w}m", 2).alias(f"amt_sum_{w}m") for w in (3, 6, 12)])


@query(
    "join_composite_key_dedupe",
    """with l as (select distinct l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem),
            m as (select distinct l_orderkey as k1, l_partkey as k2, l_suppkey as k3 from lineitem where l_returnflag = 'R')
       select o_custkey as epk, count(*) as n from l
       join m on l.l_orderkey = m.k1 and l.l_partkey = m.k2 and l.l_suppkey = m.k3
       join orders on o_orderkey = l.l_orderkey group by 1""",
)
def join_composite_key_dedupe(spark, sf):
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    lines = fx.table(spark, sf, "lineitem")
    left = lines.select(*keys, "l_linenumber").dropDuplicates()
    right = lines.where("l_returnflag = 'R'").select(*keys).dropDuplicates()
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("epk"))
    return left.join(right, keys).join(orders, "l_orderkey").groupBy("epk").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_key_and_category",
    fx.with_views("pos_tx needs")
    + """select p.epk, p.mcc_code as category, p.n, n.needs from
           (select epk, mcc_code, count(*) as n from pos_tx group by 1, 2) p
           join (select epk, life_situation, count(*) as needs from needs group by 1, 2) n
             on p.epk = n.epk and p.mcc_code = n.life_situation""",
)
def join_key_and_category(spark, sf):
    tx = fx.pos_tx(spark, sf).groupBy("epk", F.col("mcc_code").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    nd = (
        fx.needs(spark, sf)
        .groupBy("epk", F.col("life_situation").alias("category"))
        .agg(F.count(F.lit(1)).alias("needs"))
    )
    return tx.join(nd, ["epk", "category"])


@query(
    "join_residual_predicate",
    fx.with_views("snap_cust")
    + """select c_custkey as epk, report_dt, round(amt, 2) as amt from customer join snap_cust
         on c_custkey = epk and amt > c_acctbal * 50""",
)
def join_residual_predicate(spark, sf):
    snap = fx.snap_cust(spark, sf).withColumnRenamed("epk", "k")
    c = customers(spark, sf, "c_acctbal")
    return c.join(snap, (c.epk == snap.k) & (snap.amt > c.c_acctbal * 50)).select(
        "epk", "report_dt", F.round("amt", 2).alias("amt")
    )


@query(
    "join_campaign_response",
    """with hist as (select o_custkey as epk, l_returnflag as campaign, date '2024-01-01' + cast(day(o_orderdate) - 1 as int) as start_dt
                     from orders join lineitem on o_orderkey = l_orderkey),
            resp as (select user_id as epk, cast(ts as date) as day, max(case when event_type = 'purchase' then 1 else 0 end) as flag from events group by 1, 2),
            sent as (select epk, campaign, start_dt, count(*) as n from hist group by all),
            met as (select s.epk, s.campaign, s.start_dt, any_value(s.n) as n, max(r.flag) as flag from sent s
                    left join resp r on r.epk = s.epk and r.day >= s.start_dt and r.day <= s.start_dt + 7 group by s.epk, s.campaign, s.start_dt)
       select epk, campaign, cast(sum(n) as bigint) as n, count(flag) as answered_starts, max(flag) as responded from met group by epk, campaign""",
)
def join_campaign_response(spark, sf):
    """Each contact has its campaign's start; a response counts if it falls into the week from that start on.

    The dates of both sides belong to the join. Contacts and responses are reduced to one row per client and day first,
    so the join widens neither of them by more than the days of the window.
    """
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.dayofmonth("o_orderdate") - 1)
    lines = fx.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("campaign"))
    history = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("epk"), start.alias("start_dt"))
    sent = history.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("epk", "campaign", "start_dt").agg(F.count(F.lit(1)).alias("n"))
    flag = F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("flag")
    resp = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("__k"), F.col("ts").cast("date").alias("day")).agg(flag)
    near = (F.col("epk") == F.col("__k")) & F.col("day").between(F.col("start_dt"), F.date_add("start_dt", 7))
    met = sent.join(resp, near, "left").groupBy("epk", "campaign", "start_dt").agg(F.first("n").alias("n"), F.max("flag").alias("flag"))
    return met.groupBy("epk", "campaign").agg(F.sum("n").alias("n"), F.count("flag").alias("answered_starts"), F.max("flag").alias("responded"))


@query(
    "join_broadcast_hint",
    """select r_name, n_name, count(*) as clients from customer join nation on c_nationkey = n_nationkey
       join region on n_regionkey = r_regionkey group by 1, 2""",
)
def join_broadcast_hint(spark, sf):
    """The hinted side is a rule table that is literal in the code; tables are left to the planner's statistics."""
    nation, region = fx.table(spark, sf, "nation"), fx.table(spark, sf, "region")
    return (
        fx.table(spark, sf, "customer")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.count(F.lit(1)).alias("clients"))
        .join(nation, "n_nationkey")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.sum("clients").alias("clients"))
    )


@query(
    "join_wide_assemble",
    fx.with_views("snap_sup")
    + """, t as (select epk, report_dt from snap_sup
                 where report_dt in (date '1998-10-31', date '1998-11-30', date '1998-12-31'))
         select t.epk, t.report_dt, round(s.amt, 2) as amt, s.qty, cast(p.cnt as bigint) as prev_cnt
         from t left join snap_sup s on s.epk = t.epk and s.report_dt = t.report_dt
         left join (select epk, last_day(cast(report_dt + interval 1 month as date)) as report_dt, cnt from snap_sup
                    where cnt > 8) p on p.epk = t.epk and p.report_dt = t.report_dt""",
)
def join_wide_assemble(spark, sf):
    snap = fx.snap_sup(spark, sf, "1998-09-01", fx.ANCHOR)
    t = snap.select("epk", "report_dt").where(F.col("report_dt") >= F.lit("1998-10-31").cast("date"))
    now = snap.select("epk", "report_dt", F.round("amt", 2).alias("amt"), "qty")
    prev = snap.where("cnt > 8").select(
        "epk", d.shift_month_end(F.col("report_dt"), 1).alias("report_dt"), F.col("cnt").alias("prev_cnt")
    )
    return j.assemble(t, [now, prev])


@query(
    "join_back_keys",
    "select vec_id as epk, label as target, date '1998-12-31' as report_dt from embeddings",
)
def join_back_keys(spark, sf):
    """Rows keep their key through a split, so no positional join is needed to bring it back."""
    df = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("epk"), F.col("label").alias("target"), F.lit(fx.ANCHOR).cast("date").alias("report_dt")
    )
    from clientscope.ml.split import assign_parts

    parts = assign_parts(df, "epk")
    names = ("train", "val", "test")
    a, b, c = (parts.where(F.col("part") == n).drop("part") for n in names)
    return a.unionByName(b).unionByName(c)
