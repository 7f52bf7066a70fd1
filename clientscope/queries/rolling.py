"""Rolling windows and feature blocks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from clientscope.functions import dates as d
from clientscope.functions.columns import fix_types
from clientscope.operators import prefix_state as ps
from clientscope.operators.rolling import rolling_windows
from clientscope.plans import features as ft
from clientscope.queries.registry import query
from clientscope.session import new_path
from clientscope.sources import fixtures as fx
from clientscope.sources.blocks import BlockStore, stored_blocks
from clientscope.sources.periods import PeriodTable
from clientscope.sources.sinks import stored

WS = (3, 6, 9, 12)
HISTORY = ("1997-11-01", fx.ANCHOR)


def start_sql(w):
    return f"last_day(cast(t.report_dt - interval {w - 1} month as date))"


def in_window_sql(w):
    return f"filter (s.report_dt >= {start_sql(w)})"


TARGET_SUP = """t as (select distinct epk, report_dt from snap_sup
                     where report_dt in (date '1998-10-31', date '1998-11-30', date '1998-12-31'))"""
TARGET_CUST = """t as (select c_custkey as epk, unnest([date '1998-11-30', date '1998-12-31']) as report_dt from customer
                      where c_mktsegment in ('BUILDING', 'MACHINERY'))"""


def target_sup(spark, sf):
    return fx.snap_sup(spark, sf, "1998-10-01", fx.ANCHOR).select("epk", "report_dt")


def target_cust(spark, sf):
    c = fx.table(spark, sf, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')")
    return c.select(
        F.col("c_custkey").alias("epk"),
        F.explode(F.array(F.lit("1998-11-30").cast("date"), F.lit("1998-12-31").cast("date"))).alias("report_dt"),
    )


def rounded(df, digits=6):
    return df.select(
        *[(F.round(c, 2 if "_sum_" in c and c.endswith("m") else digits).alias(c) if k == "double" else F.col(c)) for c, k in df.dtypes]
    )


def rolling_sql(cols, windows=WS, aggs=("sum", "avg"), ratios=True, values=True, skip_ratio=()):
    """Single-pass oracle of the correct mode."""
    out = ["t.epk", "t.report_dt"]
    for c in cols:
        def agg(kind, w, c=c):
            s = f"cast(sum(s.{c}) {in_window_sql(w)} as double)"
            return s if kind == "sum" else f"{s} / nullif(count(s.epk) {in_window_sql(w)}, 0)"

        for kind in aggs:
            if values:
                out += [f"round({agg(kind, w)}, {2 if kind == 'sum' else 6}) as {c}_{kind}_{w}m" for w in windows]
            if ratios:
                out += [
                    f"round({agg(kind, a)} / nullif({agg(kind, b)}, 0), 6) as {c}_{kind}_{a}_{b}"
                    for a, b in combinations(windows, 2)
                    if a not in skip_ratio
                ]
    return "select " + ",\n".join(out)


JOIN_SUP = f" from t left join snap_sup s on s.epk = t.epk and s.report_dt between {start_sql(12)} and t.report_dt group by 1, 2"
JOIN_CUST = JOIN_SUP.replace("snap_sup", "snap_cust")


def compat_sql(table, cols, windows=WS, aggs=("sum", "avg"), values=True, first=None, skip_ratio=()):
    """The literal form: the history joined once per window on the client alone."""
    out = ["t.epk", "t.report_dt"]
    for c in cols:
        for kind in aggs:
            if values:
                out += [f"round(cast({kind}(a{w}.{c}) as double), {2 if kind == 'sum' else 6}) as {c}_{kind}_{w}m" for w in windows]
            out += [
                f"round(cast({kind}(a{a}.{c}) as double) / nullif({kind}(a{b}.{c}), 0), 6) as {c}_{kind}_{a}_{b}"
                for a, b in combinations(windows, 2)
                if a not in skip_ratio
            ]
    joins = "".join(f" join {table} a{w} on a{w}.epk = t.epk and a{w}.report_dt between {start_sql(w)} and t.report_dt" for w in windows)
    return "select " + ",\n".join(out) + " from t" + joins + " group by 1, 2"


@query("feat_rolling_windows", fx.with_views("snap_sup", TARGET_SUP) + rolling_sql(["amt", "qty", "cnt"]) + JOIN_SUP)
def feat_rolling_windows(spark, sf):
    return rounded(rolling_windows(target_sup(spark, sf), fx.snap_sup(spark, sf, *HISTORY), ["amt", "qty", "cnt"], prune=False))


@query("feat_rolling_windows_sparse", fx.with_views("snap_cust", TARGET_CUST) + rolling_sql(["amt"]) + JOIN_CUST)
def feat_rolling_windows_sparse(spark, sf):
    """The whole history is given; the operator cuts it to what the targets can reach."""
    return rounded(rolling_windows(target_cust(spark, sf), fx.snap_cust(spark, sf), ["amt"]))


@query("feat_rolling_windows_compat", fx.with_views("snap_cust", TARGET_CUST) + compat_sql("snap_cust", ["amt", "cnt"]))
def feat_rolling_windows_compat(spark, sf):
    out = rolling_windows(target_cust(spark, sf), fx.snap_cust(spark, sf, *HISTORY), ["amt", "cnt"], mode="compat", prune=False)
    return rounded(out)


@query("feat_prefix_windows", fx.with_views("snap_sup", TARGET_SUP) + rolling_sql(["amt", "qty", "cnt"]) + JOIN_SUP)
def feat_prefix_windows(spark, sf):
    """The same windows from running totals: the state up to November is stored by month, December is added to it from
    its own facts and the month before, and each window is the difference of two months."""
    cols, history = ["amt", "qty", "cnt"], fx.snap_sup(spark, sf)
    table = PeriodTable(spark, new_path(spark, "running-totals"))
    table.replace(ps.build_state(history, cols, "1998-11-30"))
    last = history.where("report_dt = date'1998-12-31'")
    table.replace(ps.next_month(table.read(["1998-11-30"]), last, cols, "1998-12-31"))
    return rounded(ps.windows(target_sup(spark, sf), table.read(), cols))


@query(
    "feat_snapshot",
    fx.with_views("snap_sup", TARGET_SUP)
    + "select t.epk, t.report_dt, round(s.amt, 2) as amt, s.qty, s.cnt from t join snap_sup s using (epk, report_dt)",
)
def feat_snapshot(spark, sf):
    snap = fx.snap_sup(spark, sf, *HISTORY)
    return ft.snapshot(target_sup(spark, sf), snap).withColumn("amt", F.round("amt", 2))


ARREST_SQL = """h as (select o_custkey as epk, last_day(cast(o_orderdate as date)) as report_dt, sum(v) as sum_val_arrests,
                             count(case when v > 0 then v end) as qty_val_arrests
                      from (select *, o_totalprice - 200000 as v from orders) group by 1, 2)"""


def arrest_facts(spark, sf):
    return fx.acq_tx(spark, sf, *HISTORY).select("epk", "dt", (F.col("amt") - 200000).alias("v"))


@query(
    "feat_arrests_rolling",
    fx.with_views("", TARGET_CUST, ARREST_SQL)
    + rolling_sql(["sum_val_arrests", "qty_val_arrests"], (1, *WS), skip_ratio=(1,))
    + JOIN_CUST.replace("snap_cust", "h"),
)
def feat_arrests_rolling(spark, sf):
    return rounded(ft.arrests(target_cust(spark, sf), arrest_facts(spark, sf), "v", prune=("1998-11-30", fx.ANCHOR)))


@query(
    "feat_arrests_rolling_compat",
    fx.with_views("", TARGET_CUST, ARREST_SQL)
    + compat_sql("h", ["sum_val_arrests", "qty_val_arrests"], (1, *WS), skip_ratio=(1,)),
)
def feat_arrests_rolling_compat(spark, sf):
    return rounded(ft.arrests(target_cust(spark, sf), arrest_facts(spark, sf), "v", mode="compat", prune=False))


FEEDBACK_SQL = """select t.epk, t.report_dt, cast(coalesce(sum(s.cnt), 0) as bigint) as pfm_cnt_12m, round(coalesce(sum(s.amt), 0), 2) as pfm_amt_12m,
                cast(coalesce(sum(s.cnt) filter (s.report_dt >= cast(t.report_dt - interval 2 month as date)), 0) as bigint) as pfm_cnt_3m,
                round(coalesce(sum(s.amt) filter (s.report_dt >= cast(t.report_dt - interval 2 month as date)), 0), 2) as pfm_amt_3m
         from t left join snap_cust s on s.epk = t.epk and s.report_dt <= t.report_dt
              and s.report_dt >= cast(t.report_dt - interval 11 month as date) group by 1, 2"""


@query(
    "feat_feedback_windows",
    fx.with_views("snap_cust", TARGET_CUST) + FEEDBACK_SQL,
)
def feat_feedback_windows(spark, sf):
    return feedbacks(spark, sf, target_cust(spark, sf))


def feedbacks(spark, sf, target):
    out = ft.counter_windows(target, fx.snap_cust(spark, sf, *HISTORY), ["cnt", "amt"])
    return out.select(*[F.round(c, 2).alias(c) if "amt" in c else F.col(c) for c in out.columns])


VISITS_SQL = """select epk, report_dt, count(*) filter (dt >= cast(report_dt - interval 3 month as date)) as visits_3m,
                       count(*) as visits_12m
                from acq_tx join d on dt between cast(report_dt - interval 12 month as date) and report_dt group by 1, 2"""
DATES_SQL = "d as (select unnest([date '1998-10-31', date '1998-11-30', date '1998-12-31']) as report_dt)"


@query("feat_visit_counts", fx.with_views("acq_tx", DATES_SQL) + VISITS_SQL)
def feat_visit_counts(spark, sf):
    return visits(spark, sf, every_client(spark, sf))


def every_client(spark, sf):
    dates = F.explode(F.array(*[F.lit(x).cast("date") for x in fx.REPORT_MONTHS])).alias("report_dt")
    return fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("epk"), dates)


def visits(spark, sf, target):
    return ft.visit_counts(target, fx.acq_tx(spark, sf).select("epk", "dt"))


FLOW_SQL = """f as (select epk, report_dt, amt, qty, amt / nullif(qty - 30, 0) as per_qty, cnt / nullif(qty, 0) as cnt_share,
                           coalesce(amt, 0) + coalesce(qty, 0) as tot_bal_with_invest from snap_sup)"""
FLOW_OUT = "select t.epk, t.report_dt, " + ", ".join(
    f"round(avg(s.{c}), 6) as {c}_12m" for c in ("amt", "qty", "per_qty", "cnt_share", "tot_bal_with_invest")
) + f", round(avg(s.tot_bal_with_invest) {in_window_sql(3)}, 6) as tot_bal_with_invest_3m"


@query("feat_flow_ratios", fx.with_views("snap_sup", TARGET_SUP, FLOW_SQL) + FLOW_OUT + JOIN_SUP.replace("snap_sup", "f"))
def feat_flow_ratios(spark, sf):
    return flows(spark, sf, target_sup(spark, sf))


def flows(spark, sf, target):
    source = fx.snap_sup(spark, sf, *HISTORY).withColumn("base", F.col("qty") - 30)
    out = ft.flow_ratios(
        target, source, ["amt", "qty"], {"per_qty": ("amt", "base"), "cnt_share": ("cnt", "qty")}, ["amt", "qty"],
        prune=False,
    )
    return rounded(out)


def pos_snapshot(spark, sf):
    """Monthly spending by brand half and part type, as debit and credit columns."""
    tx = fx.pos_tx(spark, sf, *HISTORY)
    even = F.col("brand_code").isin(*[f"Brand#{i}" for i in range(2, 26, 2)])
    cols = []
    for name, code in (("auto", "ECONOMY"), ("leisure", "PROMO"), ("utilities_rub_amt", "SMALL")):
        for kind, side in (("dc", even), ("cc", ~even)):
            cols.append(F.sum(F.when(side & (F.col("mcc_code") == code), F.col("amt"))).alias(f"crd_{kind}_pos_{name}"))
    return tx.groupBy("epk", F.last_day("dt").alias("report_dt")).agg(
        *cols, F.sum(F.when(F.col("mcc_code") == "LARGE", F.col("amt"))).alias("srv_pmt_utl_amt")
    )


POS_SNAP_SQL = """snap_pos as (select epk, last_day(dt) as report_dt,
    coalesce(sum(amt) filter (mcc_code = 'ECONOMY'), 0) as pos_auto, coalesce(sum(amt) filter (mcc_code = 'PROMO'), 0) as pos_leisure,
    coalesce(sum(amt) filter (mcc_code = 'SMALL'), 0) as pos_utilities_rub_amt,
    coalesce(sum(amt) filter (mcc_code = 'LARGE'), 0) as paid_utilities_rub_amt,
    coalesce(sum(amt) filter (mcc_code in ('SMALL', 'LARGE')), 0) as total_utilities_rub_amt from pos_tx group by 1, 2)"""
POS_COLS = ["pos_auto", "pos_leisure", "pos_utilities_rub_amt", "paid_utilities_rub_amt", "total_utilities_rub_amt"]


@query(
    "feat_pos_dynamics",
    fx.with_views("pos_tx", POS_SNAP_SQL, TARGET_CUST)
    + rolling_sql(POS_COLS, values=False)
    + JOIN_CUST.replace("snap_cust", "snap_pos"),
)
def feat_pos_dynamics(spark, sf):
    sums = ft.pos_sums(pos_snapshot(spark, sf), ["auto", "leisure", "utilities_rub_amt"])
    return rounded(ft.pos_dynamics(target_cust(spark, sf), sums, prune=False))


def named_snapshot(spark, sf, *bounds):
    return fx.snap_sup(spark, sf, *(bounds or HISTORY)).select(
        "epk", "report_dt", F.col("amt").alias("crd_total_amt"), F.col("qty").alias("dep_total_qty"),
        F.col("cnt").alias("srv_open_dt_cnt"), F.col("cnt").alias("prd_cnt"), F.col("qty").alias("dep_rate"),
    )


NAMED_SQL = "n as (select epk, report_dt, amt as crd_total_amt, qty as dep_total_qty from snap_sup)"


@query(
    "feat_dynamics_by_schema",
    fx.with_views("snap_sup", TARGET_SUP, NAMED_SQL)
    + rolling_sql(["crd_total_amt", "dep_total_qty"], aggs=("sum",))
    + JOIN_SUP.replace("snap_sup", "n"),
)
def feat_dynamics_by_schema(spark, sf):
    return rounded(ft.dynamics_by_schema(target_sup(spark, sf), named_snapshot(spark, sf), prune=False))


def dated_embeddings(spark, sf):
    """Embeddings of suppliers, dated by the month end after (even ids) or in (odd ids) December 1998."""
    e = fx.table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("epk"),
        F.when(e.vec_id % 2 == 0, F.lit("1999-01-31")).otherwise(F.lit("1998-12-31")).cast("date").alias("report_dt"),
        *[F.col("embedding")[k].cast("double").alias(f"emb{k}") for k in range(64)],
    )


EMB_COLS = ", ".join(f"cast(embedding[{k + 1}] as double) as emb{k}" for k in range(64))


@query(
    "feat_embeddings_lagged",
    fx.with_views("snap_sup", TARGET_SUP)
    + f"""select t.epk, t.report_dt, {EMB_COLS} from t join embeddings on vec_id = t.epk
          where t.report_dt = case when vec_id % 2 = 0 then date '1998-12-31' else date '1998-11-30' end""",
)
def feat_embeddings_lagged(spark, sf):
    return ft.lagged_embeddings(target_sup(spark, sf), dated_embeddings(spark, sf))


@query(
    "feat_embeddings_month",
    fx.with_views("snap_sup", TARGET_SUP)
    + f"select t.epk, t.report_dt, {EMB_COLS} from t join embeddings on vec_id = t.epk where vec_id % 2 = 1 and t.report_dt = date '1998-12-31'",
)
def feat_embeddings_month(spark, sf):
    return ft.monthly_embeddings(target_sup(spark, sf), dated_embeddings(spark, sf).withColumnRenamed("report_dt", "mon"))


ASSEMBLE_SQL = (
    fx.with_views("snap_sup acq_tx", TARGET_SUP, FLOW_SQL, DATES_SQL, f"v as ({VISITS_SQL})", f"fl as ({FLOW_OUT}{JOIN_SUP.replace('snap_sup', 'f')})")
    + """select t.epk, t.report_dt, round(s.amt, 2) as amt, s.qty, s.cnt, fl.amt_12m, fl.qty_12m, fl.per_qty_12m, fl.cnt_share_12m,
                fl.tot_bal_with_invest_12m, fl.tot_bal_with_invest_3m, v.visits_3m, v.visits_12m
         from t left join snap_sup s using (epk, report_dt) left join fl using (epk, report_dt) left join v using (epk, report_dt)"""
)


def feature_blocks(spark, sf):
    snap = fx.snap_sup(spark, sf, *HISTORY)
    return {
        "snapshot": lambda t: ft.snapshot(t, snap).withColumn("amt", F.round("amt", 2)),
        "flows": lambda t: flows(spark, sf, t),
        "visits": lambda t: visits(spark, sf, t),
    }


@query("feat_assemble", ASSEMBLE_SQL)
def feat_assemble(spark, sf):
    return ft.all_features(target_sup(spark, sf), feature_blocks(spark, sf))[0]


@query("feat_assemble_buckets", ASSEMBLE_SQL)
def feat_assemble_buckets(spark, sf):
    """The same blocks, each stored in buckets of its keys: they are joined without an exchange."""
    store = BlockStore(spark, 8, folder=new_path(spark, "blocks"))
    return fix_types(stored_blocks(store, target_sup(spark, sf), feature_blocks(spark, sf)))


FULL_SQL = {
    "snapshot": "select epk, report_dt, round(amt, 2) as amt, qty, cnt from snap_sup",
    "arrests": rolling_sql(["sum_val_arrests", "qty_val_arrests"], (1, *WS), skip_ratio=(1,)) + JOIN_CUST.replace("snap_cust", "h"),
    "feedbacks": FEEDBACK_SQL,
    "visits": VISITS_SQL,
    "flows": FLOW_OUT + JOIN_SUP.replace("snap_sup", "f"),
    "pos_dynamics": rolling_sql(POS_COLS, values=False) + JOIN_CUST.replace("snap_cust", "snap_pos"),
    "embeddings": f"""select vec_id as epk, case when vec_id % 2 = 0 then date '1998-12-31' else date '1998-11-30' end as report_dt, {EMB_COLS}
                      from embeddings""",
    "month_embeddings": "select vec_id as epk, date '1998-12-31' as report_dt, "
    + ", ".join(f"cast(embedding[{k + 1}] as double) as month_emb{k}" for k in range(64))
    + " from embeddings where vec_id % 2 = 1",
    "dynamics": rolling_sql(["crd_total_amt", "dep_total_qty"], aggs=("sum",)) + JOIN_SUP.replace("snap_sup", "n"),
}


@query(
    "feat_full_set",
    fx.with_views(
        "snap_sup snap_cust acq_tx pos_tx", TARGET_SUP, ARREST_SQL, FLOW_SQL, DATES_SQL, POS_SNAP_SQL, NAMED_SQL,
        *[f"b_{name} as ({sql})" for name, sql in FULL_SQL.items()],
    )
    + "select t.epk, t.report_dt, "
    + ", ".join(f"b_{name}.* exclude (epk, report_dt)" for name in FULL_SQL)
    + " from t "
    + " ".join(f"left join b_{x} on b_{x}.epk = t.epk and b_{x}.report_dt = t.report_dt" for x in FULL_SQL),
)
def feat_full_set(spark, sf):
    """All kinds of blocks on one target; each reads only what the target can reach."""
    dated = dated_embeddings(spark, sf)
    monthly = dated.withColumnsRenamed({f"emb{k}": f"month_emb{k}" for k in range(64)} | {"report_dt": "mon"})
    sums = ft.pos_sums(pos_snapshot(spark, sf), ["auto", "leisure", "utilities_rub_amt"])
    blocks = feature_blocks(spark, sf) | {
        "arrests": lambda t: rounded(ft.arrests(t, arrest_facts(spark, sf), "v")),
        "feedbacks": lambda t: feedbacks(spark, sf, t),
        "pos_dynamics": lambda t: rounded(ft.pos_dynamics(t, sums)),
        "embeddings": lambda t: ft.lagged_embeddings(t, dated),
        "month_embeddings": lambda t: ft.monthly_embeddings(t, monthly),
        "dynamics": lambda t: rounded(ft.dynamics_by_schema(t, named_snapshot(spark, sf), columns_per_pass=100)),
    }
    # Every block asks for the target's rows and dates, so they are stored once.
    return ft.all_features(stored(target_sup(spark, sf), "target"), blocks)[0]


@query(
    "feat_train_oot_split",
    fx.with_views("snap_sup", TARGET_SUP)
    + "select epk, report_dt, case when report_dt = date '1998-12-31' then 'oot' else 'train' end as part from t",
)
def feat_train_oot_split(spark, sf):
    train, oot = ft.train_and_oot(target_sup(spark, sf), fx.ANCHOR)
    return train.withColumn("part", F.lit("train")).unionByName(oot.withColumn("part", F.lit("oot")))


PAIRS_SQL = (
    fx.with_views("features_wide", "long as (unpivot (select * exclude (target) from features_wide) on * exclude (epk) into name c value v)")
    + """select x.c as a, y.c as b, round(corr(x.v, y.v), 6) as r from long x join long y on x.epk = y.epk
         and cast(substr(x.c, 2) as int) < cast(substr(y.c, 2) as int) group by 1, 2 having abs(corr(x.v, y.v)) > 0.15"""
)


@query("feat_correlated_pairs", PAIRS_SQL)
def feat_correlated_pairs(spark, sf):
    wide = fx.features_wide(spark, sf)
    return ft.correlated_pairs(wide, [f"f{k}" for k in range(64)], 0.15).withColumn("r", F.round("r", 6))


GREEDY = 0.15


@query("feat_drop_correlated_greedy")
def feat_drop_correlated_greedy(spark, sf):
    return ft.drop_correlated_greedy(fx.features_wide(spark, sf), GREEDY, ("epk", "target"))


@query("feat_drop_correlated_groups")
def feat_drop_correlated_groups(spark, sf):
    return ft.drop_correlated_groups(fx.features_wide(spark, sf), GREEDY, ("epk", "target"))


CORR_SQL = (
    fx.with_views("features_wide", "long as (unpivot (select * exclude (target) from features_wide) on * exclude (epk) into name c value v)")
    .replace("with ", "with recursive ", 1)
    + """, r as (select cast(substr(x.c, 2) as int) as i, cast(substr(y.c, 2) as int) as j, abs(corr(x.v, y.v)) as r
                 from long x join long y on x.epk = y.epk group by 1, 2)"""
)


@query(
    "feat_kept_greedy",
    CORR_SQL
    + f""", against as (select j as c, coalesce(list(i) filter (i < j and r > {GREEDY}), []) as others from r group by j),
           step as (select -1 as c, []::int[] as kept union all
                    select a.c, case when list_has_any(s.kept, a.others) then s.kept else list_append(s.kept, a.c) end
                    from step s join against a on a.c = s.c + 1)
         select 'f' || unnest(kept) as feature from step where c = 63""",
)
def feat_kept_greedy(spark, sf):
    """Names of the columns that the greedy filter keeps."""
    return names(spark, ft.uncorrelated_greedy(fx.features_wide(spark, sf), [f"f{k}" for k in range(64)], GREEDY))


@query(
    "feat_kept_groups",
    CORR_SQL
    + f""", reach as (select distinct i, i as j from r union select e.i, r.j from reach e join r on r.i = e.j and r.r > {GREEDY} and r.i <> r.j),
           grp as (select i, min(j) as g from reach group by i), weight as (select i, round(sum(r), 9) as w from r group by i)
         select 'f' || i as feature from (select i, row_number() over (partition by g order by w desc, i) as rn from grp join weight using (i)) where rn = 1""",
)
def feat_kept_groups(spark, sf):
    """Names of the columns that the group filter keeps."""
    return names(spark, ft.uncorrelated_groups(fx.features_wide(spark, sf), [f"f{k}" for k in range(64)], GREEDY))


def names(spark, kept):
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@query(
    "feat_scoring_subset",
    fx.with_views("snap_sup", TARGET_SUP, NAMED_SQL)
    + f"""select t.epk, t.report_dt, round(sum(s.dep_total_qty) {in_window_sql(6)}, 2) as dep_total_qty_sum_6m,
                 round(sum(s.dep_total_qty) {in_window_sql(3)} / nullif(sum(s.dep_total_qty) {in_window_sql(12)}, 0), 6)
                   as dep_total_qty_sum_3_12"""
    + JOIN_SUP.replace("snap_sup", "n"),
)
def feat_scoring_subset(spark, sf):
    wanted = ["dep_total_qty_sum_6m", "dep_total_qty_sum_3_12", "prl_income_amt"]
    return rounded(ft.dynamics_by_schema(target_sup(spark, sf), named_snapshot(spark, sf), wanted))


@query(
    "feat_oot_inline",
    fx.with_views("snap_sup", TARGET_SUP, FLOW_SQL, f"fl as ({FLOW_OUT}{JOIN_SUP.replace('snap_sup', 'f')})")
    + """select s.epk, s.report_dt, round(s.amt, 2) as amt, s.qty, s.cnt, fl.amt_12m, fl.tot_bal_with_invest_12m,
                fl.tot_bal_with_invest_3m from snap_sup s join t using (epk, report_dt) left join fl using (epk, report_dt)
         where s.report_dt = date '1998-12-31'""",
)
def feat_oot_inline(spark, sf):
    """The same blocks on a target of one month; there is no second code path for it."""
    target = target_sup(spark, sf).where(F.col("report_dt") == d.day(fx.ANCHOR))
    blocks = {k: v for k, v in feature_blocks(spark, sf).items() if k != "visits"}
    out = ft.all_features(target, blocks)[0]
    return out.select("epk", "report_dt", "amt", "qty", "cnt", "amt_12m", "tot_bal_with_invest_12m", "tot_bal_with_invest_3m")
