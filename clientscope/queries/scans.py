"""Sources and sinks, reshape and set operations on scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientscope.operators.windows import rank_in_client, wide_top
from clientscope.queries.registry import query
from clientscope.session import new_path
from clientscope.sources.periods import PeriodTable
from clientscope.sources import fixtures as fx
from clientscope.sources import readers, sinks
from clientscope.functions.columns import ids_first

SNAP_OUT = "epk, report_dt, round(amt, 2) as amt, cast(cnt as bigint) as cnt"


def rounded(df):
    return df.select("epk", "report_dt", F.round("amt", 2).alias("amt"), "cnt")


@query("scan_table", "select c_custkey as epk, c_mktsegment as segment, c_acctbal as balance from customer")
def scan_table(spark, sf):
    df = readers.scan(spark, f"{sf}/customer.parquet", ["c_custkey", "c_mktsegment", "c_acctbal"])
    return df.toDF("epk", "segment", "balance")


@query(
    "scan_parquet_view",
    "select n_name, r_name from nation join region on n_regionkey = r_regionkey",
)
def scan_parquet_view(spark, sf):
    readers.scan_view(spark, f"{sf}/nation.parquet", "cs_nation")
    readers.scan_view(spark, f"{sf}/region.parquet", "cs_region")
    return spark.sql("select n_name, r_name from cs_nation join cs_region on n_regionkey = r_regionkey")


@query(
    "scan_partition_list",
    fx.with_views("snap_sup")
    + f"select {SNAP_OUT} from snap_sup where report_dt in (date '1998-10-31', date '1998-11-30', date '1998-12-31')",
)
def scan_partition_list(spark, sf):
    return rounded(readers.at_dates(fx.snap_sup(spark, sf, "1998-10-01", "1998-12-31"), fx.REPORT_MONTHS))


@query(
    "scan_month_sequence",
    fx.with_views("snap_sup")
    + """select last_day(cast(m as date)) as report_dt
         from (select unnest(generate_series(date_trunc('month', min(report_dt)), date_trunc('month', max(report_dt)),
                                             interval 1 month)) as m from snap_sup)""",
)
def scan_month_sequence(spark, sf):
    return readers.month_sequence(fx.snap_sup(spark, sf))


@query(
    "scan_sharded_union",
    "select l_suppkey % 11 as shard, count(*) as n, round(sum(l_extendedprice), 2) as amt from lineitem group by 1",
)
def scan_sharded_union(spark, sf):
    """The shards are folders of a table that is written first, so each branch of the union reads its own files only."""
    lines = fx.table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_suppkey") % 11).alias("shard"))
    stored = sinks.overwrite(lines, new_path(spark, "shards"), partition_by="shard")
    shards = [stored.where(F.col("shard") == i) for i in range(11)]
    return (
        readers.union_shards(shards, lambda d: d.select(F.col("shard").cast("bigint").alias("shard"), "l_extendedprice"))
        .groupBy("shard")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("amt"))
    )


@query("sink_table_overwrite", fx.with_views("snap_sup") + f"select {SNAP_OUT} from snap_sup")
def sink_table_overwrite(spark, sf):
    path = new_path(spark, "snapshot")
    sinks.overwrite(rounded(fx.snap_sup(spark, sf)).limit(0), path)
    return sinks.overwrite(rounded(fx.snap_sup(spark, sf)), path)


@query("sink_parquet", fx.with_views("snap_cust") + f"select {SNAP_OUT} from snap_cust")
def sink_parquet(spark, sf):
    return sinks.overwrite(rounded(fx.snap_cust(spark, sf)), new_path(spark, "features"))


@query(
    "sink_replace_period",
    fx.with_views("snap_sup")
    + f"""select epk, report_dt, round(case when report_dt = date '1998-12-31' then amt * 2 else amt end, 2) as amt,
                 cast(cnt as bigint) as cnt from snap_sup""",
)
def sink_replace_period(spark, sf):
    path = new_path(spark, "scores")
    scores = fx.snap_sup(spark, sf)
    sinks.replace_period(rounded(scores), path)
    last = scores.where("report_dt = date'1998-12-31'").withColumn("amt", F.col("amt") * 2)
    sinks.replace_period(rounded(last), path)
    return sinks.replace_period(rounded(last), path)


@query("stage_if_absent", fx.with_views("snap_sup") + f"select {SNAP_OUT} from snap_sup")
def stage_if_absent(spark, sf):
    path = new_path(spark, "block")
    sinks.stage_if_absent(spark, path, lambda: rounded(fx.snap_sup(spark, sf)))
    return sinks.stage_if_absent(spark, path, lambda: rounded(fx.snap_sup(spark, sf)).limit(0))


@query(
    "sink_period_versions",
    fx.with_views("snap_sup")
    + """select epk, report_dt, round(case when report_dt = date '1998-12-31' then amt * 2 else amt end, 2) as amt,
                cast(cnt as bigint) as cnt, case when report_dt = date '1998-12-31' then 2 else 1 end as version from snap_sup
         union all select epk, report_dt, round(amt, 2), cast(cnt as bigint), 0 from snap_sup where report_dt = date '1998-12-31'""",
)
def sink_period_versions(spark, sf):
    """The last month is swapped in a second version; the first one's month is read beside it as version 0."""
    table = PeriodTable(spark, new_path(spark, "versioned"))
    scores = rounded(fx.snap_sup(spark, sf)).withColumn("version", F.lit(1))
    first = table.replace(scores)
    last = scores.where("report_dt = date'1998-12-31'")
    table.replace(last.withColumns({"amt": F.round(F.col("amt") * 2, 2), "version": F.lit(2)}))
    return table.read().unionByName(table.read(["1998-12-31"], first).withColumn("version", F.lit(0)))


@query("stage_by_content", fx.with_views("snap_sup") + f"select {SNAP_OUT}, 2::int as factor from snap_sup")
def stage_by_content(spark, sf):
    """A block of one parameter is written and another one of a second parameter; the second is read back."""
    folder = new_path(spark, "staged")

    def block(factor):
        return sinks.stage(spark, folder, "snapshot", lambda: rounded(fx.snap_sup(spark, sf)).withColumn("factor", F.lit(factor)))

    block(1)
    block(2)
    return block(2)


@query("sink_repartitioned", fx.with_views("snap_cust") + f"select {SNAP_OUT} from snap_cust")
def sink_repartitioned(spark, sf):
    return sinks.write_sized(rounded(fx.snap_cust(spark, sf)), new_path(spark, "sized"), files=8, salts=4)


@query(
    "union_all_segments",
    """select c_custkey as epk, 'FREE' as payment_status, 1 as approval_level from customer
       where c_mktsegment = 'BUILDING'
       union all
       select c_custkey, 'PAID', case when c_acctbal >= 5000 then 2 else 1 end from customer
       where c_mktsegment = 'MACHINERY'""",
)
def union_all_segments(spark, sf):
    c = fx.table(spark, sf, "customer")
    free = c.where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("epk"), F.lit("FREE").alias("payment_status"), F.lit(1).alias("approval_level")
    )
    paid = c.where("c_mktsegment = 'MACHINERY'").select(
        F.when(F.col("c_acctbal") >= 5000, 2).otherwise(1).alias("approval_level"),
        F.lit("PAID").alias("payment_status"),
        F.col("c_custkey").alias("epk"),
    )
    return free.unionByName(paid)


@query(
    "union_two_sources",
    fx.with_views("pos_tx acq_tx")
    + """select src, epk, count(*) as n, round(sum(amt), 2) as amt from (
           select epk, amt, 'pos' as src from pos_tx
           union all
           select epk, amt, 'acquiring' from acq_tx
           where status = 'F') group by 1, 2""",
)
def union_two_sources(spark, sf):
    common = ["epk", "amt", "mcc_code", "merchant", "dt"]
    pos = fx.pos_tx(spark, sf).select(*common, F.lit("pos").alias("src"))
    acq = fx.acq_tx(spark, sf).where("status = 'F'").select(*common, F.lit("acquiring").alias("src"))
    return (
        pos.unionByName(acq)
        .groupBy("src", "epk")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amt"), 2).alias("amt"))
    )


@query(
    "union_replace",
    fx.with_views("snap_cust")
    + """select epk, report_dt, round(case when report_dt = date '1998-12-31' then amt + 1 else amt end, 2) as amt,
                cast(cnt as bigint) as cnt from snap_cust""",
)
def union_replace(spark, sf):
    old = fx.snap_cust(spark, sf)
    new = fx.snap_cust(spark, sf, "1998-12-01", "1998-12-31").withColumn("amt", F.col("amt") + 1)
    return rounded(old.where("report_dt <> date'1998-12-31'").unionByName(new))


@query(
    "union_period_loop",
    """select last_day(cast(o_orderdate as date)) as month, o_orderstatus as flag, count(distinct o_custkey) as clients
       from orders where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1999-01-01' group by 1, 2""",
)
def union_period_loop(spark, sf):
    """All months in one grouped query instead of one query per month."""
    return (
        fx.acq_tx(spark, sf, "1998-01-01", "1998-12-31")
        .groupBy(F.last_day("dt").alias("month"), F.col("status").alias("flag"))
        .agg(F.countDistinct("epk").alias("clients"))
    )


LEVELS_SQL = """levels as (
    select distinct c_custkey as epk, 'FREE' as payment_status from customer where c_mktsegment = 'BUILDING'
    union all
    select distinct o_custkey, 'PAID' from orders where o_totalprice > 250000)"""


def levels(spark, sf):
    """Clients with a status; a client may be both free and paid."""
    free = (
        fx.table(spark, sf, "customer")
        .where("c_mktsegment = 'BUILDING'")
        .select(F.col("c_custkey").alias("epk"), F.lit("FREE").alias("payment_status"))
    )
    paid = (
        fx.table(spark, sf, "orders")
        .where("o_totalprice > 250000")
        .select(F.col("o_custkey").alias("epk"), F.lit("PAID").alias("payment_status"))
    )
    return free.unionByName(paid.distinct())


@query(
    "union_final_priority",
    f"with {LEVELS_SQL} select distinct * from levels where payment_status = 'FREE' union all select distinct * "
    "from levels where payment_status = 'PAID' and epk not in (select epk from levels where payment_status = 'FREE')",
)
def union_final_priority(spark, sf):
    from clientscope.plans.assembly import free_then_paid

    return free_then_paid(levels(spark, sf))


CATEGORY_SCORES_SQL = """wide as (
    select epk, round(sum(case when mcc_code = 'ECONOMY' then amt else 0 end), 2) as economy,
           round(sum(case when mcc_code = 'PROMO' then amt else 0 end), 2) as promo,
           round(sum(case when mcc_code = 'SMALL' then amt else 0 end), 2) as small
    from pos_tx group by epk)"""


def wide_scores(spark, sf):
    return (
        fx.pos_tx(spark, sf)
        .groupBy("epk")
        .agg(
            *[
                F.round(F.sum(F.when(F.col("mcc_code") == m.upper(), F.col("amt")).otherwise(0.0)), 2).alias(m)
                for m in ("economy", "promo", "small")
            ]
        )
    )


@query(
    "unpivot_scores",
    fx.with_views("pos_tx", CATEGORY_SCORES_SQL)
    + """select epk, 'economy' as category, economy as score from wide
         union all select epk, 'promo', promo from wide union all select epk, 'small', small from wide""",
)
def unpivot_scores(spark, sf):
    return wide_scores(spark, sf).unpivot("epk", ["economy", "promo", "small"], "category", "score")


@query(
    "pivot_categories",
    fx.with_views("pos_tx")
    + """, per as (select epk, mcc_code, round(sum(amt), 2) as amt from pos_tx group by 1, 2),
           r as (select *, row_number() over (partition by epk order by amt desc, mcc_code) as rn from per)
         select epk, max(case when rn = 1 then mcc_code end) as top1_mcc_code,
                max(case when rn = 1 then amt end) as top1_amt, max(case when rn = 2 then mcc_code end) as top2_mcc_code,
                max(case when rn = 2 then amt end) as top2_amt, max(case when rn = 3 then mcc_code end) as top3_mcc_code,
                max(case when rn = 3 then amt end) as top3_amt from r group by epk""",
)
def pivot_categories(spark, sf):
    per = fx.pos_tx(spark, sf).groupBy("epk", "mcc_code").agg(F.round(F.sum("amt"), 2).alias("amt"))
    ranked = rank_in_client(per, "epk", [F.col("amt").desc(), F.col("mcc_code")])
    return wide_top(ranked, "epk", "rn", 3, ["mcc_code", "amt"])


@query("reorder_columns", "select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders")
def reorder_columns(spark, sf):
    df = fx.table(spark, sf, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey", "o_custkey")
    return ids_first(df, ["o_custkey", "o_orderkey"])
