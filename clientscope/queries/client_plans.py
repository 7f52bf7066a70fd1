"""Tiers, benefits, core products and need products."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientscope.functions.numbers import null_safe_sum
from clientscope.functions.predicates import flag
from clientscope.plans import benefits, core_products, needs, tiers
from clientscope.plans.assembly import free_then_paid
from clientscope.queries.registry import query
from clientscope.queries.scans import LEVELS_SQL, levels
from clientscope.sources import fixtures as fx

A = fx.ANCHOR
CURRENT = "row_actual_to_dt = '9999-12-31' and is_deleted = 0"
LEVEL_TAGS = {6: ("purchase_1",), 5: ("view_2", "click_2"), 4: ("view_3",), 3: ("click_4", "signup_4"), 2: ("signup_5",), 1: ("view_6",)}
FREE_SQL = f"""free as (select epk, max(case when nsi_id = 'purchase_1' then 6 when nsi_id in ('view_2', 'click_2') then 5
        when nsi_id = 'view_3' then 4 when nsi_id in ('click_4', 'signup_4') then 3 when nsi_id = 'signup_5' then 2
        when nsi_id = 'view_6' then 1 else 0 end) as approval_level, 'FREE' as payment_status, max(nsi_id) as approval_criteria,
        '' as primary_approval_criterion from tags
    where {CURRENT} and nsi_id in ('purchase_1', 'view_2', 'click_2', 'view_3', 'click_4', 'signup_4', 'signup_5', 'view_6')
    group by epk)"""


@query("client_free_tier", fx.with_views("tags", FREE_SQL) + "select * from free")
def client_free_tier(spark, sf):
    return tiers.free_tier(fx.tags(spark, sf), LEVEL_TAGS)


PAID_SQL = """rec as (select c_custkey as epk, sum(amt) filter (mcc_code = 'ECONOMY') as dep, sum(amt) filter (mcc_code = 'PROMO') as inv,
        sum(amt) filter (mcc_code = 'SMALL') as insur, sum(amt) filter (mcc_code = 'LARGE') as pos_dc,
        sum(amt) filter (mcc_code = 'MEDIUM') as pos_cc
    from customer left join (select * from pos_tx where dt between date '1998-10-01' and date '1998-12-31') t on t.epk = c_custkey
    where c_acctbal > 0 and c_nationkey between 3 and 22 group by 1),
    mon as (select epk, sum(amt) as total, sum(amt) filter (status = 'F') as acq, sum(amt) filter (status = 'O') as z from acq_tx
            where dt between date '1998-12-01' and date '1998-12-31' group by 1),
    sc as (select epk, max(raw_score) as score from needs group by 1),
    calc as (select rec.epk, score, coalesce(dep, 0) + coalesce(inv, 0) + coalesce(insur, 0) + coalesce(total, 0) as x,
        coalesce(pos_dc, 0) + coalesce(pos_cc, 0) + coalesce(acq, 0) as y, coalesce(z, 0) as z
        from rec left join mon on mon.epk = rec.epk left join sc on sc.epk = rec.epk),
    lv as (select epk, case
        when score >= (select avg(score) from sc) and (x >= 300000 or y >= 150000 or z >= 300000)
             and (x <= 600000 or y <= 300000 or z <= 600000) then 3
        when score >= (select avg(score) from sc) and (x >= 150000 or y >= 80000 or z >= 200000)
             and (x <= 300000 or y <= 150000 or z <= 300000) then 2
        when score >= (select avg(score) from sc) and (x >= 50000 or y >= 30000 or z >= 100000)
             and (x <= 150000 or y <= 80000 or z <= 200000) then 1 else 0 end as approval_level from calc),
    paid as (select epk, approval_level, 'PAID' as payment_status, '' as approval_criteria, '' as primary_approval_criterion
             from lv where approval_level >= 1)"""
BANDS = {
    3: {"x": (300_000, 600_000), "y": (150_000, 300_000), "z": (300_000, 600_000)},
    2: {"x": (150_000, 300_000), "y": (80_000, 150_000), "z": (200_000, 300_000)},
    1: {"x": (50_000, 150_000), "y": (30_000, 80_000), "z": (100_000, 200_000)},
}


@query(
    "client_paid_tier",
    fx.with_views("tags pos_tx acq_tx needs", FREE_SQL, PAID_SQL)
    + "select * from paid where not exists (select 1 from free where free.epk = paid.epk) union all select * from free",
)
def client_paid_tier(spark, sf):
    c = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("epk"), F.lit(A).cast("date").alias("report_dt"), F.col("c_nationkey").alias("age"),
        flag(F.col("c_acctbal") <= 0).alias("dead"), F.lit(1).alias("active"),
    )
    money = {"dep": "ECONOMY", "inv": "PROMO", "insur": "SMALL", "pos_dc": "LARGE", "pos_cc": "MEDIUM"}
    spend = fx.pos_tx(spark, sf, *fx.QUARTER).groupBy("epk").agg(
        *[F.sum(F.when(F.col("mcc_code") == code, F.col("amt"))).alias(name) for name, code in money.items()]
    )
    base = tiers.active_base(c, A, (3, 22)).select("epk").join(spend, "epk", "left")
    acq = fx.acq_tx(spark, sf, "1998-12-01", A).select("epk", F.col("amt").alias("amount"), "dt", "status")
    score = fx.needs(spark, sf).groupBy("epk").agg(F.max("raw_score").alias("score"))
    paid = tiers.paid_tier(base, acq, acq.where("status = 'O'"), acq.where("status = 'F'"), score, A, BANDS)
    return tiers.all_tiers(tiers.free_tier(fx.tags(spark, sf), LEVEL_TAGS), paid)


BRANDS = range(1, 6)


def benefit_wide(spark, sf):
    """Wide benefits per client: four ruble parts and two bonus parts on levels 1-5, played by brands and types."""
    tx = fx.pos_tx(spark, sf, *fx.QUARTER)
    parts = {"transfer": "ECONOMY", "card": "PROMO", "deposit": "SMALL", "savings": "LARGE", "bonus": "MEDIUM", "grocery": "STANDARD"}
    cols = [
        F.sum(F.when((F.col("mcc_code") == code) & (F.col("brand_code").endswith(str(n))), F.col("amt"))).alias(f"{part}_{n}")
        for part, code in parts.items()
        for n in BRANDS
    ]
    return tx.groupBy("epk").agg(*cols)


BENEFIT_SQL = "ben as (select epk, " + ", ".join(
    f"sum(amt) filter (mcc_code = '{code}' and brand_code like '%{n}') as {part}_{n}"
    for part, code in {"transfer": "ECONOMY", "card": "PROMO", "deposit": "SMALL", "savings": "LARGE", "bonus": "MEDIUM", "grocery": "STANDARD"}.items()
    for n in BRANDS
) + " from pos_tx where dt between date '1998-10-01' and date '1998-12-31' group by epk)"


def rollup_sql():
    out = []
    for n in range(1, 7):
        k = min(n, 5)
        rubles = ["transfer", "card", "deposit"] + (["savings"] if k >= 2 else [])
        for kind, names in (("rubles", rubles), ("bonuses", ["bonus", "grocery"])):
            out.append("round(sum(" + " + ".join(f"coalesce({x}_{k}, 0)" for x in names) + f")) as sum_benefit_{kind}_lvl{n}")
    return ", ".join(out)


@query(
    "client_benefit_rollup",
    fx.with_views("tags pos_tx", FREE_SQL, BENEFIT_SQL, f"rows2 as (select * from ben union all select * from ben where epk % 5 = 0), sums as (select epk, {rollup_sql()} from rows2 group by epk)")
    + "select free.epk, approval_level, sums.* exclude (epk) from free left join sums on sums.epk = free.epk",
)
def client_benefit_rollup(spark, sf):
    """Every fifth client has two rows at the report date, which are summed."""
    one = benefit_wide(spark, sf)
    wide = one.unionByName(one.where("epk % 5 = 0")).withColumns({"report_dt": F.lit(A).cast("date"), "death_flag": F.lit(0)})
    clients = tiers.free_tier(fx.tags(spark, sf), LEVEL_TAGS).select("epk", "approval_level")
    kinds = {
        "rubles": ["transfer_{level}", "card_{level}", "deposit_{level}", "savings_{level}"],
        "bonuses": ["bonus_{level}", "grocery_{level}"],
    }
    return benefits.benefit_rollup(clients, wide, A, kinds, first_level={"savings_{level}": 2})


def typed_tx(spark, sf, start, end):
    return fx.pos_tx(spark, sf, start, end).withColumnRenamed("mcc_code", "trx_type")


@query(
    "flag_transfer",
    fx.with_views("pos_tx")
    + """select epk, case when coalesce(sum(amt) filter (mcc_code in ('ECONOMY', 'PROMO')), 0) > 0 then 1 else 0 end as transfer_flag
         from pos_tx where dt >= date '1998-11-01' and dt < date '1998-12-01' group by epk""",
)
def flag_transfer(spark, sf):
    return core_products.transfer_flag(typed_tx(spark, sf, "1998-11-01", "1998-11-30"), A, ("ECONOMY", "PROMO"))


FEES_SQL = """select coalesce(a.epk, b.epk) as epk, service_fee, notify_fee, cash_fee from
    (select epk, max(case when mcc_code = 'ECONOMY' then amt else 0 end) as service_fee,
            max(case when mcc_code in ('SMALL', 'LARGE') then amt else 0 end) as notify_fee from pos_tx
     where dt between date '1998-11-30' and date '1998-12-31' group by 1) a
    full join (select epk, round(sum(amt) filter (mcc_code in ('1-URGENT', '2-HIGH')), 2) as cash_fee from acq_tx
     where dt between date '1998-11-30' and date '1998-12-31' group by 1) b on a.epk = b.epk"""


@query("amounts_fees", fx.with_views("pos_tx acq_tx") + FEES_SQL)
def amounts_fees(spark, sf):
    monthly = fx.acq_tx(spark, sf, "1998-11-30", A).withColumnRenamed("mcc_code", "trx_type")
    out = core_products.fee_amounts(
        typed_tx(spark, sf, "1998-11-30", A), monthly, A, ("ECONOMY",), ("SMALL", "LARGE"), ("1-URGENT", "2-HIGH")
    )
    return out.withColumn("cash_fee", F.round("cash_fee", 2))


@query(
    "flag_subscription",
    fx.with_views("pos_tx")
    + """select epk, max(case when brand_code in ('Brand#1', 'Brand#2', 'Brand#3') then 1 else 0 end) as prime,
                max(case when brand_code in ('Brand#4', 'Brand#5') then 1 else 0 end) as prime_plus
         from pos_tx where mcc_code <> 'PROMO' and not (merchant like '%new%' or merchant like '%hot%') group by epk""",
)
def flag_subscription(spark, sf):
    packets = fx.pos_tx(spark, sf).select(
        "epk", F.col("brand_code").alias("category"), F.col("merchant").alias("name"),
        F.when(F.col("mcc_code") == "PROMO", "CLOSED").otherwise("ACTIVE").alias("state"),
    )
    plans = {"prime": ("Brand#1", "Brand#2", "Brand#3"), "prime_plus": ("Brand#4", "Brand#5")}
    return core_products.subscription_flags(packets, plans, ["new", "hot"])


def accounts(spark, sf):
    """Accounts at the anchor: the close date lies four months after the transaction."""
    return fx.pos_tx(spark, sf, *fx.QUARTER).select(
        "epk", F.col("merchant").alias("name"), F.col("mcc_code").alias("type"), F.add_months("dt", 4).alias("close_dt"),
        F.lit(A).cast("date").alias("report_dt"),
        F.when(F.col("brand_code") == "Brand#9", 2).otherwise(1).alias("state"),
    )


def term_sql(types, names, lines):
    flags = ", ".join(
        f"max(case when merchant like '%{w}%' and cast(dt + interval 4 month as date) > date '1999-02-28' then 1 else 0 end) as only_{k}"
        for k, w in lines.items()
    )
    return f"""select epk, {flags} from pos_tx where dt between date '1998-10-01' and date '1998-12-31' and brand_code <> 'Brand#9'
               and mcc_code in ({", ".join(repr(t) for t in types)}) and merchant in ({", ".join(repr(n) for n in names)}) group by epk"""


DEPOSIT = (("ECONOMY", "PROMO", "SMALL"), ("red ring", "blue ring", "old gear", "new gear", "hot rod", "cold rod"), {"first": "ring", "second": "gear", "third": "rod"})
SAVINGS = (("LARGE", "MEDIUM", "SMALL"), ("red bolt", "small plate", "large plate", "blue bolt"), {"first": "bolt", "second": "plate", "third": "large"})


@query("flag_deposit", fx.with_views("pos_tx") + term_sql(*DEPOSIT))
def flag_deposit(spark, sf):
    types, names, lines = DEPOSIT
    return core_products.term_flags(accounts(spark, sf), A, lines, names, types)


@query("flag_savings", fx.with_views("pos_tx") + term_sql(*SAVINGS))
def flag_savings(spark, sf):
    types, names, lines = SAVINGS
    return core_products.term_flags(accounts(spark, sf), A, lines, names, types)


@query(
    "flag_coin_purchase",
    fx.with_views("acq_tx")
    + """select epk, max(case when merchant like '%high%' then 1 else 0 end) as coins_flag from acq_tx
         where dt between date '1997-06-30' and date '1998-12-31' group by epk""",
)
def flag_coin_purchase(spark, sf):
    ops = fx.acq_tx(spark, sf, "1997-06-30", A).withColumnRenamed("merchant", "scenario")
    return core_products.coin_flag(ops, A, "high")


@query(
    "flag_card_design",
    fx.with_views("tags")
    + """select epk, max(case when nsi_id like '%view_1%' then 1 else 0 end) as sticker_flag,
                max(case when nsi_id like '%click_1%' then 1 else 0 end) as metal_flag from tags
         where row_actual_to_dt = '9999-12-31' and (nsi_id like '%view_1%' or nsi_id like '%click_1%') group by epk""",
)
def flag_card_design(spark, sf):
    cards = fx.tags(spark, sf).withColumnRenamed("nsi_id", "card_design")
    return core_products.design_flags(cards, {"sticker_flag": "view_1", "metal_flag": "click_1"})


@query(
    "avg_balance_3m",
    fx.with_views("snap_cust")
    + """select epk, round(avg(amt), 4) as avg_balance_3m, cast(sum(cnt) as bigint) as sum_sent_3m from snap_cust
         where report_dt between date '1998-10-31' and date '1998-12-31' group by epk""",
)
def avg_balance_3m(spark, sf):
    snap = fx.snap_cust(spark, sf, "1998-10-01", A).withColumnsRenamed({"amt": "balance", "cnt": "sent"})
    return core_products.balance_3m(snap, A).withColumn("avg_balance_3m", F.round("avg_balance_3m", 4))


@query(
    "flag_tag_interest",
    fx.with_views("tags")
    + f"""select epk, max(case when nsi_id = 'view_7' then 1 else 0 end) as tag_view_7,
                 max(case when nsi_id = 'click_8' then 1 else 0 end) as tag_click_8 from tags
          where {CURRENT} and nsi_id in ('view_7', 'click_8') group by epk""",
)
def flag_tag_interest(spark, sf):
    return core_products.tag_flags(fx.tags(spark, sf), ("view_7", "click_8"))


FLAG_NAMES = ("transfer_flag", "service_fee", "notify_fee", "cash_fee", "prime", "prime_plus", "coins_flag", "sticker_flag",
              "metal_flag", "avg_balance_3m", "sum_sent_3m", "tag_view_7", "tag_click_8")


def _flag_view(name):
    from clientscope.queries.registry import ORACLES

    return ORACLES[name]


def core_flags_sql():
    """The oracle joins the oracles of the single flags."""
    blocks = ("flag_transfer", "amounts_fees", "flag_subscription", "flag_coin_purchase", "flag_card_design", "avg_balance_3m", "flag_tag_interest")
    dep = term_sql(*DEPOSIT)
    sav = term_sql(*SAVINGS).replace("only_", "saves_")
    joins = " ".join(f"left join ({_flag_view(b)}) b{i} on b{i}.epk = c_custkey" for i, b in enumerate(blocks))
    cols = [f"coalesce({c}, 0) as {c}" for c in FLAG_NAMES]
    cols += [f"coalesce({p}_{x}, 0) as {p}_{x}" for p in ("only", "saves") for x in ("first", "second", "third")]
    return (
        fx.with_views("pos_tx")
        + f"select c_custkey as epk, {', '.join(cols)} from customer {joins} left join ({dep}) d on d.epk = c_custkey left join ({sav}) s on s.epk = c_custkey"
    )


def core_flags(spark, sf):
    savings = flag_savings(spark, sf)
    savings = savings.select("epk", *[F.col(c).alias(c.replace("only_", "saves_")) for c in savings.columns[1:]])
    blocks = [
        flag_transfer(spark, sf), amounts_fees(spark, sf), flag_subscription(spark, sf), flag_coin_purchase(spark, sf),
        flag_card_design(spark, sf), avg_balance_3m(spark, sf), flag_tag_interest(spark, sf), flag_deposit(spark, sf), savings,
    ]
    return core_products.all_flags(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("epk")), blocks)


@query("core_product_flags", core_flags_sql())
def core_product_flags(spark, sf):
    return core_flags(spark, sf)


VALUES = {"card": 1, "deposit": 2, "savings": 6, "metal_account": 9, "credit_card": 8, "loan": 10}


def score_frame_sql():
    b = " , ".join(
        f"coalesce({p}_{n}, 0) as {p}_{n}" for p in ("card", "deposit", "savings", "bonus", "transfer") for n in BRANDS
    )
    return (
        "sf as (select f.epk, transfer_flag as transfer, case when service_fee > 50000 then 1 else 0 end as service_fee, "
        "case when notify_fee > 50000 then 1 else 0 end as notify_fee, case when cash_fee > 100000 then 1 else 0 end as cash_fee, "
        "prime as subscription, prime_plus as subscription_plus, coins_flag as coins, sticker_flag as metal_account, metal_flag as metal_card, "
        "avg_balance_3m, sum_sent_3m, avg_balance_3m as avg_spend_3m, tag_view_7 as card, tag_click_8 as bonus, tag_view_7 as credit_card, "
        f"tag_click_8 as loan, only_first, only_second, only_third, saves_first, saves_second, saves_third, {b} "
        "from f left join ben on ben.epk = f.epk)"
    )


def level_sql(n, line, lending):
    fees = "(service_fee = 1 or notify_fee = 1 or cash_fee = 1)"
    paying = "(notify_fee = 1 or cash_fee = 1)"
    sub = "(subscription = 1 or subscription_plus = 1)"
    w = (0.6, 0.5) if n == 1 else (0.5, 0.6)
    none = "{0}_first = 0 and {0}_second = 0 and {0}_third = 0"
    no_deposit = none.format("only") if n == 1 else f"only_{line} = 0"
    no_savings = none.format("saves") if n == 1 else "saves_first = 0"
    out = [
        f"""case when card = 1 and (subscription = 0 or subscription_plus = 0 or {paying}) and card_{n} > 0 then card_{n}
            when card = 0 and {fees} then round(card_{n} * 0.4::double + 0.6::double * 1, 4) else 1.0 end as score_card_{n}""",
        f"""case when metal_card = 1 and {paying} and card_{n} > 0 then card_{n}
            when metal_card = 0 and {fees} then round(card_{n} * 0.4::double + 0.6::double * 1, 4) else 1.0 end as score_metal_card_{n}""",
        f"""case when only_{line} = 0 and deposit_{n} > 0 then deposit_{n} when {no_deposit} and (avg_balance_3m > 50000 or sum_sent_3m > 50000)
            then round(deposit_{n} * 0.4::double + 0.6::double * 2, 4) else 1.0 end as score_deposit_{n}""",
        f"""case when saves_{line} = 0 and savings_{n} > 0 then savings_{n} when {no_savings} and avg_balance_3m > 50000
            then round(savings_{n} * 0.4::double + 0.6::double * 6, 4) else 1.0 end as score_savings_{n}""",
        f"""case when metal_account = 1 then round({w[0]}::double * 9, 4) when coins = 1 then round({w[1]}::double * 9, 4)
            else 1.0 end as score_metal_account_{n}""",
        f"""case when bonus = 1 and {sub} and bonus_{n} > 0 then bonus_{n} when bonus = 0 and avg_spend_3m > 50000
            then round(0.5::double * bonus_{n}, 4) else 1.0 end as score_bonus_{n}""",
        f"""case when transfer = 1 and {sub} and transfer_{n} > 0 then transfer_{n} when transfer = 0
            then round(0.5::double * transfer_{n}, 4) else 1.0 end as score_transfer_{n}""",
    ]
    if lending:
        out += [
            "case when credit_card = 1 then round(0.1::double * 8) else round(0.2::double * 8) end" + f" as score_credit_card_{n}",
            f"case when loan = 1 then round(0.1::double * 10, 4) else round(0.2::double * 10, 4) end as score_loan_{n}",
        ]
    return out


@query(
    "core_product_scores",
    fx.with_views("pos_tx", f"f as ({core_flags_sql()})", BENEFIT_SQL, score_frame_sql())
    + "select epk, "
    + ", ".join(x for n in BRANDS for x in level_sql(n, "first" if n <= 3 else "second", n > 3))
    + " from sf",
)
def core_product_scores(spark, sf):
    c = F.col
    flags = core_flags(spark, sf).join(benefit_wide(spark, sf), "epk", "left")
    ready = flags.select(
        "epk", c("transfer_flag").alias("transfer"), flag(c("service_fee") > 50000).alias("service_fee"),
        flag(c("notify_fee") > 50000).alias("notify_fee"), flag(c("cash_fee") > 100000).alias("cash_fee"),
        c("prime").alias("subscription"), c("prime_plus").alias("subscription_plus"), c("coins_flag").alias("coins"),
        c("sticker_flag").alias("metal_account"), c("metal_flag").alias("metal_card"), "avg_balance_3m", "sum_sent_3m",
        c("avg_balance_3m").alias("avg_spend_3m"), c("tag_view_7").alias("card"), c("tag_click_8").alias("bonus"),
        c("tag_view_7").alias("credit_card"), c("tag_click_8").alias("loan"),
        *[c(f"only_{x}").alias(f"only_deposit_{x}") for x in ("first", "second", "third")],
        *[c(f"saves_{x}").alias(f"only_savings_{x}") for x in ("first", "second", "third")],
        *[null_safe_sum([f"{p}_{n}"]).alias(f"{p}_{n}") for p in ("card", "deposit", "savings", "bonus", "transfer") for n in BRANDS],
    )
    rules = [
        r
        for n in BRANDS
        for r in core_products.level_rules(n, "first" if n <= 3 else "second", VALUES, lending=n > 3)
    ]
    return core_products.product_scores(ready, rules)


# --- needs to products ---------------------------------------------------------------------------------------

PRODUCT_RULES = (
    ("grocery", tuple(f"Brand#{i}" for i in range(1, 9))),
    ("health", ("Brand#7", "Brand#8", "Brand#9", "Brand#10", "Brand#11")),
    ("travel", ("Brand#12", "Brand#13", "Brand#14")),
    ("concierge", ("Brand#14", "Brand#15", "Brand#16", "Brand#17", "Brand#18")),
    ("music", ("Brand#19", "Brand#20", "Brand#1")),
)
PRODUCT_SQL = "pn as (select * from (values " + ", ".join(f"('{n}', '{p}')" for p, ns in PRODUCT_RULES for n in ns) + ") v(need_id, product))"
LIMITS = {"concierge": (4, None), "travel": (None, 1)}
LV_SQL = "lvl as (select c_custkey as epk, cast(c_nationkey % 7 as int) as approval_level from customer)"
RANK_SQL = """p1 as (select n.epk, n.need_id, n.life_situation, n.raw_score, product, row_number() over (partition by n.epk, product
        order by raw_score desc, n.need_id desc) as r from needs n join pn on pn.need_id = n.need_id),
    p2 as (select *, row_number() over (partition by epk, life_situation order by raw_score desc, product desc) as s from p1 where r = 1),
    p3 as (select p2.epk, approval_level, product, need_id, life_situation, raw_score from p2 join lvl on lvl.epk = p2.epk
           where s = 1 and not (product = 'concierge' and approval_level < 4) and not (product = 'travel' and approval_level > 1)),
    ranked as (select * from (select *, cast(row_number() over (partition by epk order by raw_score desc, product) as int) as rank
               from p3) where rank <= 7)"""


def client_levels(spark, sf):
    return fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("epk"), (F.col("c_nationkey") % 7).alias("approval_level")
    )


def ranked_products(spark, sf, first_match=False):
    table = needs.product_table(spark, PRODUCT_RULES, first_match)
    return needs.product_ranking(fx.needs(spark, sf), client_levels(spark, sf), table, LIMITS)


TOP_SQL = ", ".join(
    f"""coalesce(max(case when rank = {i} then product end), 'plug') as top{i}_product, max(case when rank = {i} then need_id end) as top{i}_need_id,
        round(coalesce(max(case when rank = {i} then raw_score end), 0), 5) as top{i}_raw_score"""
    for i in range(1, 8)
)


def rounded_scores(df):
    return df.select(*[F.round(c, 5).alias(c) if c.endswith("raw_score") else F.col(c) for c in df.columns])


@query(
    "need_product_topn",
    fx.with_views("needs", PRODUCT_SQL, LV_SQL, RANK_SQL)
    + f"select c_custkey as epk, {TOP_SQL} from customer left join ranked on ranked.epk = c_custkey group by 1",
)
def need_product_topn(spark, sf):
    return rounded_scores(needs.wide_products(ranked_products(spark, sf), client_levels(spark, sf)))


@query(
    "need_product_topn_first_match",
    fx.with_views("needs", "pn as (select need_id, arg_min(product, o) as product from (values "
                  + ", ".join(f"('{n}', '{p}', {i})" for i, (p, ns) in enumerate(PRODUCT_RULES) for n in ns)
                  + ") v(need_id, product, o) group by 1)", LV_SQL, RANK_SQL)
    + f"select epk, {TOP_SQL} from ranked group by epk",
)
def need_product_topn_first_match(spark, sf):
    return rounded_scores(needs.wide_products(ranked_products(spark, sf, first_match=True)))


RULES = (
    ("grocery", None, None, ("Brand#1", "Brand#2", "Brand#3"), "sport", "default"),
    ("grocery", None, None, ("Brand#3", "Brand#4"), "kids", "small"),
    ("health", None, None, ("Brand#9",), "", "default"),
    ("travel", 1, 1, ("Brand#12", "Brand#13"), "trips", "level1"),
    ("concierge", 4, None, ("Brand#14", "Brand#15"), "auto", "repair"),
    ("concierge", 6, None, ("Brand#15", "Brand#16"), "auto", "owners"),
    ("music", None, None, ("Brand#19", "Brand#20", "Brand#1"), "fun", "concert"),
)
RULES_SQL = "rl as (select * from (values " + ", ".join(
    f"('{p}', '{n}', {i}, {'null' if lo is None else lo}::int, {'null' if hi is None else hi}::int, '{s}', '{u}')"
    for i, (p, lo, hi, ns, s, u) in enumerate(RULES) for n in ns
) + ") v(product, need_id, priority, low, high, situation, sub_situation))"


@query(
    "product_situation_map",
    fx.with_views("needs", PRODUCT_SQL, LV_SQL, RANK_SQL, RULES_SQL)
    + """select epk, rank, product, need_id, approval_level, coalesce(situation, '') as situation, coalesce(sub_situation, '') as sub_situation
         from (select r.*, rl.situation, rl.sub_situation, row_number() over (partition by r.epk, r.rank order by rl.priority) as k
               from ranked r left join rl on rl.product = r.product and rl.need_id = r.need_id
                    and r.approval_level >= coalesce(low, r.approval_level) and r.approval_level <= coalesce(high, r.approval_level)) where k = 1""",
)
def product_situation_map(spark, sf):
    found = needs.with_situation(ranked_products(spark, sf), needs.situation_table(spark, RULES))
    return found.select("epk", "rank", "product", "need_id", "approval_level", "situation", "sub_situation")


def benefit_case(kind, n):
    k = min(n, 5)
    pairs = {"rubles": (("music", "card"), ("health", "deposit")), "bonuses": (("grocery", "grocery"), ("travel", "bonus"))}[kind]
    return "case " + " ".join(f"when product = '{p}' then round(coalesce({c}_{k}, 0))" for p, c in pairs) + f" else 0.0 end as benefit_{kind}_lvl{n}"


@query(
    "product_benefit_by_level",
    fx.with_views("needs", PRODUCT_SQL, LV_SQL, RANK_SQL, BENEFIT_SQL)
    + "select ranked.epk, rank, product, "
    + ", ".join(f"{benefit_case(kind, n)}" for n in range(1, 7) for kind in ("rubles", "bonuses"))
    + " from ranked left join ben on ben.epk = ranked.epk",
)
def product_benefit_by_level(spark, sf):
    out = needs.with_benefit(
        ranked_products(spark, sf), benefit_wide(spark, sf),
        {"music": "card_{level}", "health": "deposit_{level}"}, {"grocery": "grocery_{level}", "travel": "bonus_{level}"},
    )
    return out.drop("need_id", "life_situation", "raw_score", "approval_level")


@query(
    "final_assembly",
    f"""with {LEVELS_SQL}, fin as (select distinct * from levels where payment_status = 'FREE' union all
        select distinct * from levels where payment_status = 'PAID' and epk not in (select epk from levels where payment_status = 'FREE'))
        select payment_status, count(epk) as n, count(distinct epk) as n_distinct from fin group by 1""",
)
def final_assembly(spark, sf):
    return tiers.key_check(free_then_paid(levels(spark, sf)), "epk", ["payment_status"])
