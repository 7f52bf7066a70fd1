"""Filters, flags, tiers and schema-driven projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientscope.functions import columns as cols
from clientscope.functions import dates as d
from clientscope.functions import numbers as num
from clientscope.functions import predicates as p
from clientscope.operators import keywords as kw
from clientscope.queries.registry import query
from clientscope.sources import fixtures as fx

ANCHOR = fx.ANCHOR
TX_COUNT = "count(*) as n, round(sum(amt), 2) as amt"


def totals(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amt"), 2).alias("amt"))


@query(
    "filter_active_base",
    """select c_custkey as epk, date '1998-12-31' as report_dt, c_mktsegment as segment from customer
       where c_nationkey between 3 and 17 and c_acctbal > 0 and c_mktsegment <> 'HOUSEHOLD'""",
)
def filter_active_base(spark, sf):
    """Age is played by the nation key, alive by a positive balance, active by the segment."""
    from clientscope.plans.tiers import active_base

    snap = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("epk"),
        F.lit(ANCHOR).cast("date").alias("report_dt"),
        F.col("c_nationkey").alias("age"),
        p.flag(F.col("c_acctbal") <= 0).alias("dead"),
        p.flag(F.col("c_mktsegment") != "HOUSEHOLD").alias("active"),
        F.col("c_mktsegment").alias("segment"),
    )
    return active_base(snap, ANCHOR, age_range=(3, 17)).select("epk", "report_dt", "segment")


@query(
    "filter_in_list",
    fx.with_views("pos_tx")
    + f"select epk, {TX_COUNT} from pos_tx where mcc_code in ('ECONOMY', 'PROMO') "
    "and brand_code in ('Brand#1', 'Brand#5', 'Brand#12', 'Brand#23') group by epk",
)
def filter_in_list(spark, sf):
    tx = fx.pos_tx(spark, sf)
    return totals(
        tx.where(tx.mcc_code.isin("ECONOMY", "PROMO") & tx.brand_code.isin("Brand#1", "Brand#5", "Brand#12", "Brand#23")),
        "epk",
    )


@query(
    "filter_like_any",
    fx.with_views("pos_tx")
    + f"""select merchant, {TX_COUNT} from pos_tx
          where merchant like '%ring%' or merchant like '%gear%' or merchant like '%b_lt%' or merchant like '%blue%'
          group by merchant""",
)
def filter_like_any(spark, sf):
    tx = fx.pos_tx(spark, sf)
    return totals(tx.where(p.like_any(tx.merchant, ["ring", "gear", "b_lt", "blue"])), "merchant")


@query(
    "filter_string_range",
    fx.with_views("pos_tx")
    + f"select brand_code, {TX_COUNT} from pos_tx where brand_code between 'Brand#11' and 'Brand#19' group by 1",
)
def filter_string_range(spark, sf):
    tx = fx.pos_tx(spark, sf)
    return totals(tx.where(p.code_in_ranges(tx.brand_code, [], [("Brand#11", "Brand#19")])), "brand_code")


@query(
    "filter_current_scd",
    fx.with_views("tags") + "select epk, nsi_id from tags where row_actual_to_dt = '9999-12-31' and is_deleted = 0",
)
def filter_current_scd(spark, sf):
    return fx.tags(spark, sf).where(p.is_current()).select("epk", "nsi_id")


@query(
    "filter_month_to_date",
    fx.with_views("pos_tx")
    + f"""select 'date' as form, {TX_COUNT} from pos_tx where dt between date '1998-12-01' and date '1998-12-20'
          union all select 'int', {TX_COUNT} from pos_tx
          where cast(strftime(dt, '%Y%m%d') as int) between 19981201 and 19981220""",
)
def filter_month_to_date(spark, sf):
    day = "1998-12-20"
    tx = fx.pos_tx(spark, sf, "1998-12-01", day)
    by_date = tx.where(d.in_month_to_date(tx.dt, day))
    by_int = tx.where(d.int_day(tx.dt).between(d.int_day(d.month_start(day)), d.int_day(day)))
    total = [F.count(F.lit(1)).alias("n"), F.round(F.sum("amt"), 2).alias("amt")]
    return (
        by_date.agg(*total).select(F.lit("date").alias("form"), "n", "amt")
        .unionByName(by_int.agg(*total).select(F.lit("int").alias("form"), "n", "amt"))
    )


@query(
    "filter_prev_month",
    fx.with_views("pos_tx")
    + f"select epk, {TX_COUNT} from pos_tx where dt >= date '1998-11-01' and dt < date '1998-12-01' group by epk",
)
def filter_prev_month(spark, sf):
    tx = fx.pos_tx(spark, sf, "1998-11-01", "1998-11-30")
    return totals(tx.where(d.in_previous_month(tx.dt, ANCHOR)), "epk")


@query(
    "filter_lookback",
    fx.with_views("pos_tx")
    + """select epk, count(*) filter (dt between date '1998-09-30' and date '1998-12-31') as n_3m,
                count(*) filter (dt between date '1998-12-17' and date '1998-12-31') as n_2w
         from pos_tx where dt between date '1998-09-30' and date '1998-12-31' group by epk""",
)
def filter_lookback(spark, sf):
    tx = fx.pos_tx(spark, sf, "1998-09-30", ANCHOR)
    return (
        tx.where(d.in_lookback(tx.dt, ANCHOR, 3))
        .groupBy("epk")
        .agg(
            F.count(F.lit(1)).alias("n_3m"), F.count(F.when(d.in_last_weeks(F.col("dt"), ANCHOR, 2), 1)).alias("n_2w")
        )
    )


@query(
    "flag_case",
    fx.with_views("pos_tx")
    + """select epk, max(case when amt > 90000 then 1 else 0 end) as large_flag,
                max(case when merchant like '%anvil%' then 1 else 0 end) as anvil_flag,
                cast(sum(case when mcc_code in ('SMALL', 'MEDIUM') then 1 else 0 end) as bigint) as small_or_medium
         from pos_tx group by epk""",
)
def flag_case(spark, sf):
    return fx.pos_tx(spark, sf).groupBy("epk").agg(
        F.max(p.flag(F.col("amt") > 90000)).alias("large_flag"),
        F.max(p.flag(p.like_any(F.col("merchant"), ["anvil"]))).alias("anvil_flag"),
        F.sum(p.flag(F.col("mcc_code").isin("SMALL", "MEDIUM"))).alias("small_or_medium"),
    )


@query(
    "tier_case_max",
    fx.with_views("tags")
    + """select epk, max(case when nsi_id = 'purchase_1' then 6 when nsi_id in ('view_2', 'click_2') then 5
                              when nsi_id in ('view_3', 'click_3') then 4 else 0 end) as approval_level
         from tags where row_actual_to_dt = '9999-12-31' and is_deleted = 0 group by epk""",
)
def tier_case_max(spark, sf):
    tag = F.col("nsi_id")
    level = p.first_match(
        [(6, tag == "purchase_1"), (5, tag.isin("view_2", "click_2")), (4, tag.isin("view_3", "click_3"))], 0
    )
    return fx.tags(spark, sf).where(p.is_current()).groupBy("epk").agg(F.max(level).alias("approval_level"))


@query(
    "tier_threshold_bands",
    fx.with_views("snap_cust needs")
    + """, x as (select epk, sum(amt) as x, max(amt) as y from snap_cust
                 where report_dt between date '1998-01-31' and date '1998-12-31' group by epk),
           s as (select epk, max(raw_score) as score from needs group by epk)
         select x.epk, case
             when s.score >= (select avg(score) from s) and (x >= 900000 or y >= 420000)
                  and (x <= 3000000 or y <= 600000) then 3
             when s.score >= (select avg(score) from s) and (x >= 500000 or y >= 300000)
                  and (x <= 900000 or y <= 420000) then 2
             when s.score >= (select avg(score) from s) and (x >= 200000 or y >= 100000)
                  and (x <= 500000 or y <= 300000) then 1 else 0 end as level
         from x left join s on x.epk = s.epk""",
)
def tier_threshold_bands(spark, sf):
    from clientscope.plans.tiers import band_level

    totals_98 = fx.snap_cust(spark, sf, "1998-01-01", ANCHOR).groupBy("epk").agg(
        F.sum("amt").alias("x"), F.max("amt").alias("y")
    )
    score = fx.needs(spark, sf).groupBy("epk").agg(F.max("raw_score").alias("score"))
    bands = {
        3: {"x": (900_000, 3_000_000), "y": (420_000, 600_000)},
        2: {"x": (500_000, 900_000), "y": (300_000, 420_000)},
        1: {"x": (200_000, 500_000), "y": (100_000, 300_000)},
    }
    mean = score.agg(F.avg("score")).scalar()
    gated = totals_98.join(score, "epk", "left").withColumn("passes", F.col("score") >= mean)
    return gated.select("epk", band_level(bands, F.col("passes")).alias("level"))


LEFT_SUMS_SQL = """select c_custkey as epk, v.n as views, a.amt as acq from customer
    left join (select user_id, count(*) as n from events where event_type = 'view' group by 1) v on v.user_id = c_custkey
    left join (select o_custkey, round(sum(o_totalprice), 2) as amt from orders where o_orderstatus = 'F' group by 1) a
           on a.o_custkey = c_custkey"""


def left_sums(spark, sf):
    """Customers with two left-joined totals; clients without rows give nulls."""
    views = (
        fx.table(spark, sf, "events").where("event_type = 'view'")
        .groupBy(F.col("user_id").alias("epk")).agg(F.count(F.lit(1)).alias("views"))
    )
    acq = (
        fx.acq_tx(spark, sf).where("status = 'F'")
        .groupBy("epk").agg(F.round(F.sum("amt"), 2).alias("acq"))
    )
    base = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("epk"))
    return base.join(views, "epk", "left").join(acq, "epk", "left")


@query(
    "null_safe_sum",
    f"select epk, round(coalesce(views, 0) + coalesce(acq, 0), 2) as total from ({LEFT_SUMS_SQL})",
)
def null_safe_sum(spark, sf):
    return left_sums(spark, sf).select("epk", F.round(num.null_safe_sum(["views", "acq"]), 2).alias("total"))


@query(
    "safe_ratio",
    fx.with_views("snap_sup")
    + """select epk, report_dt, round(amt / nullif(qty - 30, 0), 6) as per_qty,
                round(coalesce(amt / nullif(qty - 30, 0), 0), 6) as per_qty_or_zero from snap_sup""",
)
def safe_ratio(spark, sf):
    q = F.col("qty") - 30
    return fx.snap_sup(spark, sf).select(
        "epk",
        "report_dt",
        F.round(num.safe_ratio(F.col("amt"), q), 6).alias("per_qty"),
        F.round(num.safe_ratio(F.col("amt"), q, 0.0), 6).alias("per_qty_or_zero"),
    )


@query(
    "classify_first_match",
    fx.with_views("pos_tx")
    + f"""select category, {TX_COUNT} from (select amt, case
             when mcc_code in ('ECONOMY', 'STANDARD') and merchant like '%ring%' then 'jewelry'
             when mcc_code in ('ECONOMY', 'PROMO') and (merchant like '%rod%' or merchant like '%bolt%') then 'tools'
             when brand_code between 'Brand#2' and 'Brand#25' then 'brand'
             when mcc_code = 'LARGE' then 'large' else '' end as category from pos_tx) group by category""",
)
def classify_first_match(spark, sf):
    code, text = F.col("mcc_code"), F.col("merchant")
    rules = [
        ("jewelry", code.isin("ECONOMY", "STANDARD") & p.like_any(text, ["ring"])),
        ("tools", code.isin("ECONOMY", "PROMO") & p.like_any(text, ["rod", "bolt"])),
        ("brand", F.col("brand_code").between("Brand#2", "Brand#25")),
        ("large", code == "LARGE"),
    ]
    return totals(fx.pos_tx(spark, sf).withColumn("category", p.first_match(rules, "")), "category")


SPHERES = (
    {"label": "trips", "codes": ["ECONOMY", "PROMO"], "words": ["widget", "rod"]},
    {"label": "sport", "codes": ["STANDARD", "PROMO"], "words": ["gear", "rod"]},
    {"label": "health", "codes": ["SMALL"], "ranges": [("L", "LZ")], "words": ["gizmo", "new"]},
)


@query(
    "classify_code_and_keyword",
    fx.with_views("pos_tx")
    + f"""select sphere, {TX_COUNT} from (select amt, case
             when mcc_code in ('ECONOMY', 'PROMO') and (merchant like '%widget%' or merchant like '%rod%') then 'trips'
             when mcc_code in ('STANDARD', 'PROMO') and (merchant like '%gear%' or merchant like '%rod%') then 'sport'
             when (mcc_code = 'SMALL' or mcc_code between 'L' and 'LZ')
                  and (merchant like '%gizmo%' or merchant like '%new%') then 'health' end as sphere from pos_tx)
          where sphere is not null group by sphere""",
)
def classify_code_and_keyword(spark, sf):
    tx = fx.pos_tx(spark, sf)
    sphere = p.code_and_keyword(tx.mcc_code, tx.merchant, SPHERES)
    return totals(tx.withColumn("sphere", sphere).where("sphere is not null"), "sphere")


EIGHT = (
    *SPHERES,
    {"label": "home", "codes": ["MEDIUM"], "words": ["anvil", "bolt"]}, {"label": "cars", "codes": ["LARGE", "ECONOMY"], "words": ["gear", "blue"]},
    {"label": "pets", "codes": ["STANDARD", "SMALL"], "words": ["old", "red"]}, {"label": "books", "codes": ["MEDIUM", "LARGE"], "words": ["plate", "green"]},
    {"label": "games", "codes": ["ECONOMY", "PROMO", "MEDIUM"], "words": ["ring", "small"]},
)


def eight_sql() -> str:
    def hit(r):
        codes = ", ".join(f"'{c}'" for c in r["codes"])
        ranges = "".join(f" or mcc_code between '{a}' and '{b}'" for a, b in r.get("ranges", ()))
        return f"(mcc_code in ({codes}){ranges}) and (" + " or ".join(f"merchant like '%{w}%'" for w in r["words"]) + ")"

    return "case " + " ".join(f"when {hit(r)} then '{r['label']}'" for r in EIGHT) + " end"


@query(
    "classify_eight_lists",
    fx.with_views("pos_tx") + f"select sphere, {TX_COUNT} from (select amt, {eight_sql()} as sphere from pos_tx) where sphere is not null group by sphere",
)
def classify_eight_lists(spark, sf):
    """Eight spheres by code and keyword: one automaton over the distinct merchants labels all lists at once."""
    tx = kw.label_bits(fx.pos_tx(spark, sf), "merchant", {r["label"]: r["words"] for r in EIGHT})
    return totals(tx.withColumn("sphere", kw.code_and_label(F.col("mcc_code"), "labels", EIGHT)).where("sphere is not null"), "sphere")


@query(
    "map_simple_case",
    fx.with_views("pos_tx")
    + f"""select grp, {TX_COUNT} from (select amt, case mcc_code when 'ECONOMY' then 'low' when 'SMALL' then 'low'
             when 'PROMO' then 'mid' else 'general' end as grp from pos_tx) group by grp""",
)
def map_simple_case(spark, sf):
    groups = {"ECONOMY": "low", "SMALL": "low", "PROMO": "mid"}
    lookup = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    grp = F.coalesce(F.try_element_at(lookup, F.col("mcc_code")), F.lit("general"))
    return totals(fx.pos_tx(spark, sf).withColumn("grp", grp), "grp")


@query(
    "select_columns_by_pattern",
    "select l_suppkey as epk, l_extendedprice as dep_total_amt, l_tax as srv_total_amt from lineitem",
)
def select_columns_by_pattern(spark, sf):
    df = fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("epk"),
        F.col("l_quantity").alias("crd_spend_3m_qty"),
        F.col("l_extendedprice").alias("dep_total_amt"),
        F.col("l_discount").alias("dep_rate"),
        F.col("l_tax").alias("srv_total_amt"),
        F.col("l_shipdate").alias("crd_open_dt"),
        F.col("l_linenumber").alias("prd_qty"),
    )
    return df.select("epk", *cols.select_by_pattern(df.columns))


@query(
    "drop_columns_by_pattern",
    "select l_suppkey as epk_id, l_quantity as act_qty, l_tax as tax from lineitem",
)
def drop_columns_by_pattern(spark, sf):
    df = fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("epk_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("part_dk"),
        F.col("l_extendedprice").alias("pnl_oi_total_amt"),
        F.col("l_quantity").alias("act_qty"),
        F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("data_type"),
    )
    return cols.drop_by_pattern(df, also=["data_type", "absent"], keep=["epk_id"])


@query("normalize_column_names", "select n_nationkey as nation_key, n_name as nation_name from nation")
def normalize_column_names(spark, sf):
    df = fx.table(spark, sf, "nation")
    return cols.lower_names(df.select(df.n_nationkey.alias("Nation_KEY"), df.n_name.alias("NATION_name")))


@query(
    "cast_decimal_clamp_dates",
    fx.with_views("tags")
    + """select epk, nsi_id, count(*) as n, max(least(cast(row_actual_to_dt as date), date '2262-04-11')) as valid_dt,
                max(0.25::double) as fee from tags group by 1, 2""",
)
def cast_decimal_clamp_dates(spark, sf):
    df = fx.tags(spark, sf).select(
        "epk", "nsi_id", F.col("row_actual_to_dt").cast("date").alias("valid_dt"), F.lit("0.25").cast("decimal(10,2)").alias("fee")
    )
    return cols.fix_types(df).groupBy("epk", "nsi_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("valid_dt").alias("valid_dt"), F.max("fee").alias("fee")
    )


@query(
    "dates_to_days_before",
    """select o_orderkey as id, cast(date_diff('day', cast(o_orderdate as date), date '2001-12-31') as int) as open_dt,
              case when o_orderstatus = 'F'
                   then cast(date_diff('day', cast(o_orderdate as date) + 5, date '2001-12-31') as int) end as close_dt, o_totalprice as amt from orders""",
)
def dates_to_days_before(spark, sf):
    o = fx.table(spark, sf, "orders")
    day = o.o_orderdate.cast("date")
    df = o.select(
        o.o_orderkey.alias("id"),
        F.lit("2001-12-31").cast("date").alias("report_dt"),
        day.alias("open_dt"),
        F.when(o.o_orderstatus == "F", F.date_add(day, 5).cast("string")).otherwise("unknown").alias("close_dt"),
        o.o_totalprice.alias("amt"),
    )
    return cols.dates_to_days_before(df)


@query(
    "fill_missing_by_pattern",
    f"""select epk, coalesce(views, -999999) as views_qty, cast(coalesce(flg, -1) as int) as seen_flg,
               coalesce(acq, -999999) as acq_amt, cast(coalesce(acq, -999999) as double) as acq_rate,
               coalesce(name, 'UNKNOWN') as name, coalesce(acq, -999999) as plain, views as long_left
        from (select epk, views, acq, case when views > 0 then 1 end as flg,
                     case when acq > 0 then 'seen' end as name from ({LEFT_SUMS_SQL}))""",
)
def fill_missing_by_pattern(spark, sf):
    df = left_sums(spark, sf).select(
        "epk",
        F.col("views").alias("views_qty"),
        F.when(F.col("views") > 0, 1).alias("seen_flg"),
        F.col("acq").alias("acq_amt"),
        F.col("acq").alias("acq_rate"),
        F.when(F.col("acq") > 0, "seen").alias("name"),
        F.col("acq").alias("plain"),
        F.col("views").alias("long_left"),
    )
    return cols.fill_missing(df)


@query(
    "clip_outliers_to_null",
    """select c_custkey as epk, case when c_acctbal > -1 and c_acctbal < 9000 then c_acctbal end as balance
       from customer""",
)
def clip_outliers_to_null(spark, sf):
    c = fx.table(spark, sf, "customer")
    return c.select(c.c_custkey.alias("epk"), num.clip_to_null(c.c_acctbal, -1.0, 9000.0).alias("balance"))


@query(
    "literal_columns",
    """select c_custkey as epk, 'FREE' as payment_status, '' as primary_approval_criterion, 0 as stocks,
              1.5::double as npv_card from customer""",
)
def literal_columns(spark, sf):
    return fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("epk"),
        F.lit("FREE").alias("payment_status"),
        F.lit("").alias("primary_approval_criterion"),
        F.lit(0).alias("stocks"),
        F.lit(1.5).alias("npv_card"),
    )


@query(
    "zero_or_null_ladder",
    fx.with_views("daily_contacts")
    + """select epk, day, case when (error = 0 or error is null) and (signup = 0 or signup is null) then 1 else 0 end as no_contact,
                case when error > 0 or signup > 0 then 1 else 0 end as contact,
                case when error is not null or signup is not null then 1 else 0 end as present from daily_contacts""",
)
def zero_or_null_ladder(spark, sf):
    channels = ["error", "signup"]
    return fx.daily_contacts(spark, sf).select(
        "epk",
        "day",
        p.flag(p.none_of_counts(channels)).alias("no_contact"),
        p.flag(p.some_of_counts(channels)).alias("contact"),
        p.flag(p.some_of_counts(channels, strict=False)).alias("present"),
    )
