"""Training targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientscope.functions import dates as d
from clientscope.plans import targets as t
from clientscope.queries.registry import query
from clientscope.sources import fixtures as fx

CONTACT = ["error", "signup", "purchase"]
NONE = " and ".join(f"coalesce({c}, 0) = 0" for c in CONTACT)
STRICT = "(" + " or ".join(f"coalesce({c}, 0) > 0" for c in CONTACT) + ")"
PRESENT = "(" + " or ".join(f"{c} is not null" for c in CONTACT) + ")"


def four_sql(some):
    b, o = '"view" is not null', "click is not null"
    return (
        fx.with_views("daily_contacts")
        + " union all ".join(
            f"select epk, day, '{k}' as target from daily_contacts where {cond}"
            for k, cond in (
                ("1", f"{b} and {o} and {NONE}"), ("2", f"{b} and not {o} and {some}"),
                ("3", f"not {b} and {o} and {NONE}"), ("4", f"not {b} and not {o} and {some}"),
            )
        )
    )


def five_sql(some):
    b, on, off = '"view"', "click is not null" if some is PRESENT else "coalesce(click, 0) > 0", "coalesce(click, 0) = 0"
    return (
        fx.with_views("contacts")
        + ", all_clients as (select c_custkey as epk, contacts.* exclude (epk) from customer left join contacts on epk = c_custkey) "
        + " union all ".join(
            f"select epk, '{k}' as target from all_clients where {cond}"
            for k, cond in (
                ("1", f"{b} >= 2 and {on} and {NONE}"), ("2", f"{b} >= 2 and {off} and {some}"),
                ("3", f"{b} < 2 and {on} and {NONE}"), ("4", f"{b} < 2 and {off} and {some}"),
                ("5", f"coalesce({b}, 0) = 0 and {off} and {NONE}"),
            )
        )
    )


@query("target_four_class", four_sql(STRICT))
def target_four_class(spark, sf):
    """The channel mix of every client and day of the whole table."""
    return t.four_class(fx.daily_contacts(spark, sf), "view", "click", CONTACT).select("epk", "day", "target")


@query("target_four_class_compat", four_sql(PRESENT))
def target_four_class_compat(spark, sf):
    return t.four_class(fx.daily_contacts(spark, sf), "view", "click", CONTACT, strict=False).select("epk", "day", "target")


def all_clients(spark, sf):
    """Every client with the channel counts of the whole period. All channels come from one table and one aggregation."""
    base = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("epk"))
    return base.join(fx.contacts(spark, sf), "epk", "left")


@query("target_five_class", five_sql(STRICT))
def target_five_class(spark, sf):
    return t.five_class(all_clients(spark, sf), "view", "click", CONTACT).select("epk", "target")


@query("target_five_class_compat", five_sql(PRESENT))
def target_five_class_compat(spark, sf):
    return t.five_class(all_clients(spark, sf), "view", "click", CONTACT, strict=False).select("epk", "target")


@query(
    "target_channel_counts",
    """select c_custkey as epk, sales, calls from customer
       left join (select o_custkey, count(*) as sales from orders where o_orderstatus = 'F' group by 1) s on o_custkey = c_custkey
       left join (select user_id, count(*) as calls from events where event_type = 'signup' group by 1) e on user_id = c_custkey""",
)
def target_channel_counts(spark, sf):
    base = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("epk"))
    sales = fx.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("epk"))
    calls = fx.table(spark, sf, "events").where("event_type = 'signup'").select(F.col("user_id").alias("epk"))
    return t.channel_counts(base, {"sales": sales, "calls": calls})


PERIODS_SQL = """periods as (select o_custkey as epk, last_day(cast(o_orderdate as date)) as report_dt, max(o_orderstatus) as target
    from orders where o_orderdate >= timestamp '1998-10-01' and o_orderdate < timestamp '1999-01-01' group by 1, 2)"""
UNIQUE_SQL = f"with {PERIODS_SQL} select * from periods where epk in (select epk from periods group by 1 having count(*) = 1)"


def periods(spark, sf):
    per = (
        fx.acq_tx(spark, sf, *fx.QUARTER)
        .groupBy("epk", F.last_day("dt").alias("report_dt"))
        .agg(F.max("status").alias("target"))
    )
    return [per.where(F.col("report_dt") == d.day(m)) for m in fx.REPORT_MONTHS]


@query("target_unique_keys", UNIQUE_SQL)
def target_unique_keys(spark, sf):
    return t.unique_over_periods(periods(spark, sf))


@query("target_unique_sample", UNIQUE_SQL + " order by md5(epk || '|0') limit 200")
def target_unique_sample(spark, sf):
    return t.unique_sample(periods(spark, sf), 200)


@query(
    "channel_sales_extract",
    """select o_custkey as epk, cast(o_orderdate as date) as sale_dt, o_orderpriority as product_class, o_orderstatus as channel, o_orderkey as id
       from orders where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1999-01-01'
       and o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW') and o_orderstatus in ('F', 'O')
       and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0)""",
)
def channel_sales_extract(spark, sf):
    o = fx.table(spark, sf, "orders").where(
        "o_orderdate >= timestamp_ntz'1998-01-01' and o_orderdate < timestamp_ntz'1999-01-01'"
    )
    sales = o.select(
        F.col("o_custkey").alias("epk"), F.col("o_orderdate").cast("date").alias("sale_dt"),
        F.col("o_orderpriority").alias("product_class"), F.col("o_orderstatus").alias("channel"), F.col("o_orderkey").alias("id"),
    )
    segment = fx.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 0")
    return t.channel_sales(
        sales, segment.select(F.col("c_custkey").alias("epk")), ["1-URGENT", "2-HIGH", "5-LOW"], ["F", "O"],
        d.day("1998-01-01"), d.day(fx.ANCHOR),
    )


@query(
    "telemarketing_filter",
    """with o as (select distinct user_id as epk, event_type as split, case when k % 10 = 0 then null else 'type' || (k % 10) end as product_type,
                         case when k % 7 = 0 then null else 'camp' || (k % 7) end as campaign, k % 30 as days_to_sale,
                         k % 2 as offered, case when value > 30 then 1 else 0 end as accepted
                  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))
       select epk, count(*) as offers from o where split not in ('error', 'signup') and coalesce(product_type, '') not in ('type3')
       and campaign in ('camp1', 'camp2', 'camp3', 'camp4') and (product_type is null or product_type in ('type1', 'type5', 'type7'))
       and days_to_sale <= 10 and offered = 1 and accepted = 1 group by epk""",
)
def telemarketing_filter(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    offers = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("epk"), F.col("event_type").alias("split"),
        F.when(k % 10 != 0, F.concat(F.lit("type"), k % 10)).alias("product_type"),
        F.when(k % 7 != 0, F.concat(F.lit("camp"), k % 7)).alias("campaign"), (k % 30).alias("days_to_sale"),
        (k % 2).alias("offered"), F.when(F.col("value") > 30, 1).otherwise(0).alias("accepted"),
    )
    return t.campaign_contacts(
        offers, ["error", "signup"], ["type3"], [None, "type1", "type5", "type7"], ["camp1", "camp2", "camp3", "camp4"]
    )


RESPONSE_SQL = """select o_orderkey as id, o_custkey as epk, cast(o_orderdate as date) as start_dt, coalesce(r.flag, 0) as target from orders
    left join (select user_id, max(case when event_type = 'purchase' then 1 else 0 end) as flag from events group by 1) r on user_id = o_custkey
    where o_orderdate >= timestamp '1998-07-01' and o_orderdate < timestamp '1998-10-01'"""


def campaign_history(spark, sf):
    return fx.table(spark, sf, "orders").where(
        "o_orderdate >= timestamp_ntz'1998-07-01' and o_orderdate < timestamp_ntz'1998-10-01'"
    ).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("epk"), F.col("o_orderdate").cast("date").alias("start_dt"))


def labelled(spark, sf):
    responses = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("epk"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("responded")
    )
    return t.binary_response(campaign_history(spark, sf), responses, ["epk"])


@query("target_binary_response", RESPONSE_SQL)
def target_binary_response(spark, sf):
    return labelled(spark, sf)


@query(
    "target_lag_report_date",
    "select id, epk, target, "
    + ", ".join(f"last_day(cast(start_dt - interval {n} month as date)) as report_dt_{n}" for n in (1, 3, 13))
    + f" from ({RESPONSE_SQL})",
)
def target_lag_report_date(spark, sf):
    return labelled(spark, sf).select(
        "id", "epk", "target", *[t.lagged_report_date(F.col("start_dt"), n).alias(f"report_dt_{n}") for n in t.LAGS]
    )
