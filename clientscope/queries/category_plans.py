"""Category scoring: lifestyle, life situation and sub-situation, with their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientscope.functions import dates as d
from clientscope.functions.predicates import first_match, flag
from clientscope.plans import life_situation as ls
from clientscope.plans import lifestyle
from clientscope.plans import scoring as s
from clientscope.queries.registry import query
from clientscope.sources import fixtures as fx

A = fx.ANCHOR
CATEGORIES = ("concerts", "event", "excursion", "spa", "training")
CATEGORY_CODES = (
    ("excursion", ("ECONOMY", "STANDARD")),
    ("spa", ("PROMO", "STANDARD")),
    ("training", ("SMALL",)),
    ("concerts", ("MEDIUM",)),
)
CURRENT_SQL = "select distinct epk, nsi_id from tags where row_actual_to_dt = '9999-12-31' and is_deleted = 0"


def tag_prefix(pairs):
    return first_match([(label, F.col("nsi_id").startswith(f"{prefix}_")) for label, prefix in pairs])


def tag_count_sql(name, pairs):
    case = " ".join(f"when nsi_id like '{prefix}\\_%' escape '\\' then '{label}'" for label, prefix in pairs)
    return f"{name} as (select epk, case {case} end as category, count(distinct nsi_id) as tags from ({CURRENT_SQL}) group by 1, 2)"


LIFE_TAGS = (("excursion", "view"), ("spa", "click"), ("event", "purchase"), ("training", "signup"))
LIFE_SQL = f"""cat as (select epk, amt, dt, case when mcc_code in ('ECONOMY', 'STANDARD') then 'excursion'
        when mcc_code in ('PROMO', 'STANDARD') then 'spa' when mcc_code = 'SMALL' then 'training'
        when mcc_code = 'MEDIUM' then 'concerts' end as category from pos_tx where dt between date '1998-10-01' and date '1998-12-31'),
    tot as (select epk, count(*) as all_cnt, sum(amt) as all_amt,
        case when count(distinct case when amt > 0 then month(dt) end) >= 2 then 1 else 0 end as regular
        from cat where category is not null group by epk),
    per as (select epk, category, count(*) as cnt, sum(amt) as amt from cat where category is not null group by 1, 2),
    base as (select t.epk, c.category, round(coalesce(p.amt / nullif(t.all_amt, 0), 0) * 0.5::double
            + coalesce(p.cnt / nullif(t.all_cnt, 0), 0) * 0.3::double + t.regular * 0.2::double, 9) as score
        from tot t cross join (values {", ".join(f"('{c}')" for c in CATEGORIES)}) c(category)
        left join per p on p.epk = t.epk and p.category = c.category),
    rb as (select *, row_number() over (partition by epk order by score desc, category) as rn from base),
    top as (select epk, max(score) filter (rn = 1) as t1, max(score) filter (rn = 2) as t2 from rb group by epk),
    {tag_count_sql("tc", LIFE_TAGS)},
    fin as (select b.epk, b.category, round(b.score + case when t1 = 0 or (t1 - t2) * 100.0::double / nullif(t1, 0) < 10
            then least(coalesce(tags, 0) * 0.05::double, 0.3::double * case when b.score > 0 then b.score when t1 > 0 then t1 else 1 end)
            else 0 end, 9) as final from base b join top on top.epk = b.epk left join tc on tc.epk = b.epk and tc.category = b.category),
    rf as (select *, row_number() over (partition by epk order by final desc, category) as rn from fin)"""


def quarter_category():
    return first_match([(c, F.col("mcc_code").isin(list(codes))) for c, codes in CATEGORY_CODES])


@query("lifestyle_top_category", fx.with_views("pos_tx tags", LIFE_SQL) + "select epk, category as top_category from rf where rn = 1")
def lifestyle_top_category(spark, sf):
    return lifestyle.top_category(
        fx.pos_tx(spark, sf, *fx.QUARTER), fx.tags(spark, sf), A, quarter_category(), CATEGORIES, tag_prefix(LIFE_TAGS)
    )


@query("lifestyle_base_scores", fx.with_views("pos_tx tags", LIFE_SQL) + "select epk, category, score, rn from rb")
def lifestyle_base_scores(spark, sf):
    spend = lifestyle.category_spend(fx.pos_tx(spark, sf, *fx.QUARTER), A, quarter_category(), CATEGORIES)
    long = lifestyle.base_scores(spend, CATEGORIES).select("epk", F.posexplode("ranked").alias("p", "x"))
    return long.select("epk", "x.category", "x.score", (F.col("p") + 1).cast("bigint").alias("rn"))


@query(
    "perk_eligibility_flags",
    fx.with_views("pos_tx")
    + """select epk, max(case when mcc_code in ('ECONOMY', 'LARGE') then 1 else 0 end) as lounge,
                max(case when mcc_code in ('SMALL', 'MEDIUM', 'PROMO') then 1 else 0 end) as taxi
         from pos_tx where dt between date '1998-11-30' and date '1998-12-31' group by epk""",
)
def perk_eligibility_flags(spark, sf):
    tx = fx.pos_tx(spark, sf, "1998-11-30", A)
    return lifestyle.perk_flags(tx, A, {"lounge": ("ECONOMY", "LARGE"), "taxi": ("SMALL", "MEDIUM", "PROMO")})


SPHERES = (
    {"label": "trips", "codes": ("ECONOMY", "PROMO", "1-URGENT"), "words": ("ring", "rod", "gear", "urgent")},
    {"label": "sport", "codes": ("STANDARD", "PROMO", "2-HIGH"), "words": ("b_lt", "rod", "anvil", "high", "plate")},
    {"label": "health", "codes": ("SMALL",), "ranges": (("L", "LZ"), ("3-A", "3-Z")), "words": ("gizmo", "widget", "new", "medium")},
    {"label": "auto", "codes": ("MEDIUM", "5-LOW"), "words": ("old", "red", "hot", "low")},
)
LABELS = [r["label"] for r in SPHERES]
MINIMUM = {"sport": (2, 60_000.0), "health": (1, 20_000.0), "trips": (3, 120_000.0)}
GATED = ("sport", "health", "trips")
SPHERE_TAGS = (("trips", "view"), ("sport", "click"), ("health", "purchase"), ("auto", "signup"))
SPHERE_NEEDS = (
    ("trips", tuple(f"Brand#{i}" for i in range(1, 6))),
    ("sport", tuple(f"Brand#{i}" for i in range(6, 11))),
    ("health", tuple(f"Brand#{i}" for i in range(11, 15))),
)
NEEDS = [n for _, ns in SPHERE_NEEDS for n in ns]


def quoted(xs):
    return ", ".join(f"'{x}'" for x in xs)


def hit_sql(r):
    code = " or ".join([f"mcc_code in ({quoted(r['codes'])})", *[f"mcc_code between '{a}' and '{b}'" for a, b in r.get("ranges", ())]])
    return f"(({code}) and ({' or '.join(f'''merchant like '%{w}%' ''' for w in r['words'])}))"


def case_sql(rules):
    return "case " + " ".join(f"when {hit_sql(r)} then '{r['label']}'" for r in rules) + " end"


TX_SQL = """tx as (select epk, amt, mcc_code, merchant, dt from pos_tx where dt between date '1998-09-30' and date '1998-12-31'
    union all select epk, amt, mcc_code, merchant, dt from acq_tx where status = 'F' and dt between date '1998-09-30' and date '1998-12-31')"""
SPHERE_SQL = f"""sph as (select epk, amt, dt, {case_sql(SPHERES)} as sphere,
        case when dt > date '1998-11-30' then 1 when dt > date '1998-10-31' then 2 when dt > date '1998-09-30' then 3 end as m from tx),
    tot as (select epk, count(*) as all_cnt, sum(amt) as all_amt from sph where sphere is not null group by 1),
    per as (select epk, sphere, count(*) as cnt, sum(amt) as amt,
        case when count(distinct case when amt > 0 then m end) >= 2 then 1 else 0 end as regular from sph where sphere is not null group by 1, 2)"""
GATE = " or ".join(
    f"coalesce(max(cnt) filter (sphere = '{k}'), 0) >= {n} {'and' if k == 'health' else 'or'} coalesce(max(amt) filter (sphere = '{k}'), 0) >= {a}"
    if k != "health"
    else f"(coalesce(max(cnt) filter (sphere = '{k}'), 0) >= {n} and coalesce(max(amt) filter (sphere = '{k}'), 0) >= {a})"
    for k, (n, a) in MINIMUM.items()
)
GATE_SQL = f"gate as (select epk, {GATE} as eligible from per group by epk)"


def situation_sql(mode):
    prop = (
        "select epk, sphere, raw_score from prop" if mode == "correct" else
        "select a.epk, c.sphere, max(raw_score) as raw_score from prop a cross join (values "
        + ", ".join(f"('{x}')" for x in LABELS) + ") c(sphere) group by 1, 2"
    )
    label = " ".join(f"when need_id in ({quoted(ns)}) then '{x}'" for x, ns in SPHERE_NEEDS)
    return f"""{GATE_SQL}, {tag_count_sql("tc", SPHERE_TAGS)},
    base as (select t.epk, c.sphere, round(coalesce(p.amt / nullif(t.all_amt, 0), 0) * 0.5::double
            + coalesce(p.cnt / nullif(t.all_cnt, 0), 0) * 0.3::double + coalesce(p.regular, 0) * 0.2::double, 9) as score
        from tot t cross join (values {", ".join(f"('{x}')" for x in LABELS)}) c(sphere) left join per p on p.epk = t.epk and p.sphere = c.sphere),
    two as (select * from (select *, row_number() over (partition by epk order by score desc, sphere) as rn from base) where rn <= 2),
    prop as (select epk, case {label} end as sphere, max(raw_score) as raw_score from needs
        where need_id in ({quoted(NEEDS)}) and raw_score >= 70 and scoring_dt between date '1998-10-31' and date '1998-12-31' group by 1, 2),
    pr as ({prop}),
    bon as (select two.epk, two.sphere, score, rn, least(coalesce(tags, 0) * 0.05::double, score * 0.3::double) as tag,
            coalesce(pr.raw_score, 0) * 0.1::double as prop
        from two left join tc on tc.epk = two.epk and tc.category = two.sphere left join pr on pr.epk = two.epk and pr.sphere = two.sphere),
    w as (select *, max(score) filter (rn = 1) over (partition by epk) as s1, max(score) filter (rn = 2) over (partition by epk) as s2,
            max(score + tag) filter (rn = 1) over (partition by epk) as g1, max(score + tag) filter (rn = 2) over (partition by epk) as g2 from bon),
    fin as (select epk, sphere, round(score + case when (s1 - s2) * 100.0::double / nullif(s1, 0) < 10 then tag else 0 end
            + case when (s1 - s2) * 100.0::double / nullif(s1, 0) < 10 and abs(g1 - g2) * 100.0::double / nullif(g1, 0) < 10 then prop else 0 end, 9) as final
        from w),
    won as (select epk, sphere from (select *, row_number() over (partition by epk order by final desc, sphere) as k from fin) where k = 1),
    sit as (select c_custkey as epk, coalesce(case when won.sphere in ({quoted(GATED)}) and not eligible then 'general' else won.sphere end, 'general')
            as lifestyle_situation from customer left join won on won.epk = c_custkey left join gate on gate.epk = c_custkey)"""


def both(spark, sf):
    start = "1998-09-30"
    return ls.both_sources(fx.pos_tx(spark, sf, start, A), fx.acq_tx(spark, sf, start, A), A, paid="F")


def sphere_scores(spark, sf):
    wanted = fx.needs(spark, sf).where(F.col("need_id").isin(NEEDS))
    label = s.tag_label(F.col("need_id"), SPHERE_NEEDS)
    return ls.propensity(wanted, None, d.shift_month_end(A, -2), d.day(A), label=label, labels=LABELS)


def situations(spark, sf, mode="correct"):
    spend = ls.sphere_spend(both(spark, sf), A, SPHERES)
    found = ls.situation(
        spend, fx.tags(spark, sf), sphere_scores(spark, sf), LABELS, tag_prefix(SPHERE_TAGS), MINIMUM, GATED, mode
    )
    return ls.attach_situation(fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("epk")), found)


VIEWS = "pos_tx acq_tx tags needs"


@query("life_situation_top", fx.with_views(VIEWS, TX_SQL, SPHERE_SQL, situation_sql("correct")) + "select * from sit")
def life_situation_top(spark, sf):
    return situations(spark, sf)


@query("life_situation_top_compat", fx.with_views(VIEWS, TX_SQL, SPHERE_SQL, situation_sql("compat")) + "select * from sit")
def life_situation_top_compat(spark, sf):
    return situations(spark, sf, "compat")


@query(
    "minimum_activity_gate",
    fx.with_views("pos_tx acq_tx", TX_SQL, SPHERE_SQL, GATE_SQL) + "select epk, case when eligible then 1 else 0 end as eligible from gate",
)
def minimum_activity_gate(spark, sf):
    spend = ls.sphere_spend(both(spark, sf), A, SPHERES)
    return spend.select("epk", flag(ls.has_minimum(MINIMUM)).alias("eligible"))


SUBS = (
    {"label": "ski", "sphere": "trips", "codes": ("PROMO",), "words": ("rod",)},
    {"label": "family", "sphere": "trips", "codes": ("ECONOMY", "PROMO"), "words": ("ring", "gear")},
    {"label": "beauty", "sphere": "sport", "codes": ("STANDARD", "PROMO"), "words": ("anvil", "b_lt")},
    {"label": "fitness", "sphere": "sport", "codes": ("STANDARD", "2-HIGH"), "words": ("plate", "rod", "high")},
    {"label": "medical", "sphere": "health", "codes": ("SMALL",), "words": ("gizmo", "widget", "new")},
    {"label": "laboratory", "sphere": "health", "codes": ("LARGE", "3-MEDIUM", "MEDIUM"), "words": ("gizmo", "widget", "new", "medium")},
)
SUB_TAGS = (("ski", "view"), ("family", "click"), ("beauty", "purchase"), ("medical", "signup"))
SUB_SQL = f"""sub as (select epk, amt, {case_sql(SUBS)} as sub from tx where mcc_code <> 'MEDIUM'),
    st as (select epk, count(*) as all_cnt, sum(amt) as all_amt from sub where sub is not null group by 1),
    sp as (select epk, sub, count(*) as cnt, sum(amt) as amt from sub where sub is not null group by 1, 2),
    sphere_of as (select * from (values {", ".join(f"('{r['label']}', '{r['sphere']}')" for r in SUBS)}) v(sub, sphere)),
    sb as (select sp.epk, sp.sub, round(coalesce(sp.amt / nullif(all_amt, 0), 0) * 0.5::double + sp.cnt / all_cnt * 0.3::double + 0 * 0.2::double, 9) as score
        from sp join st on st.epk = sp.epk join sphere_of o on o.sub = sp.sub join sit on sit.epk = sp.epk and sit.lifestyle_situation = o.sphere),
    s2 as (select * from (select *, row_number() over (partition by epk order by score desc, sub) as rn,
            lead(score) over (partition by epk order by score desc, sub) as nxt from sb) where rn <= 2),
    sc as (select epk, max(score) filter (rn = 1) as a, coalesce(max(score) filter (rn = 2), 0) as b from s2 group by 1),
    {tag_count_sql("stc", SUB_TAGS)},
    pm as (select epk, max(raw_score) as p from needs where need_id in ({quoted(NEEDS)}) and raw_score >= 70
           and scoring_dt between date '1998-11-30' and date '1998-12-31' group by 1),
    sfin as (select s2.epk, s2.sub, round(score + case when (a - b) * 100.0::double / nullif(a, 0) < 10
            then least(coalesce(tags, 0) * 0.05::double, score * 0.3::double) + coalesce(p, 0) * 0.1::double else 0 end, 9) as final
        from s2 join sc on sc.epk = s2.epk left join stc on stc.epk = s2.epk and stc.category = s2.sub left join pm on pm.epk = s2.epk),
    sw as (select epk, sub from (select *, row_number() over (partition by epk order by final desc, sub) as k from sfin) where k = 1)"""


def recent_propensity(spark, sf, base=None):
    wanted = fx.needs(spark, sf).where(F.col("need_id").isin(NEEDS))
    return ls.propensity(wanted, base, d.shift_month_end(A, -1), d.day(A))


@query(
    "life_sub_situation",
    fx.with_views(VIEWS, TX_SQL, SPHERE_SQL, situation_sql("correct"), SUB_SQL)
    + """select sit.epk, lifestyle_situation, case when lifestyle_situation = 'auto' then '' else coalesce(sub, 'general') end as lifestyle_sub_situation
         from sit left join sw on sw.epk = sit.epk""",
)
def life_sub_situation(spark, sf):
    codes = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "LARGE", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return ls.sub_situation(
        situations(spark, sf), both(spark, sf), fx.tags(spark, sf), recent_propensity(spark, sf), tag_prefix(SUB_TAGS),
        SUBS, codes, ("auto",),
    )


@query(
    "propensity_max",
    fx.with_views("needs")
    + f"""select c_custkey as epk, round(coalesce(max(raw_score), 0), 5) as propensity from customer
          left join (select * from needs where need_id in ({quoted(NEEDS)}) and raw_score >= 70
                     and scoring_dt between date '1998-11-30' and date '1998-12-31') n on n.epk = c_custkey group by 1""",
)
def propensity_max(spark, sf):
    base = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("epk"))
    return recent_propensity(spark, sf, base).withColumn("propensity", F.round("propensity", 5))


@query(
    "tag_bonus",
    fx.with_views("tags snap_cust", tag_count_sql("tc", SPHERE_TAGS[:2]))
    + """select a.epk, round(least(coalesce(t.tags, 0) * 0.05::double, a.score * 0.3::double), 9) as trips_bonus,
                round(least(coalesce(p.tags, 0) * 0.05::double, a.score * 0.3::double), 9) as sport_bonus
         from (select epk, sum(cnt) / 12.0::double as score from snap_cust group by 1) a
         left join tc t on t.epk = a.epk and t.category = 'trips' left join tc p on p.epk = a.epk and p.category = 'sport'""",
)
def tag_bonus(spark, sf):
    score = fx.snap_cust(spark, sf).groupBy("epk").agg((F.sum("cnt") / 12.0).alias("score"))
    counts = s.tag_counts(fx.tags(spark, sf), tag_prefix(SPHERE_TAGS[:2]), ["trips", "sport"])
    return score.join(counts, "epk", "left").select(
        "epk",
        *[
            F.round(s.bonus(s.count_of(F.col("tag_counts"), F.lit(x)), F.col("score")), 9).alias(f"{x}_bonus")
            for x in ("trips", "sport")
        ],
    )


