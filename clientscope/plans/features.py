"""Feature blocks keyed by (epk, report_dt), and their assembly."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientscope.functions.columns import fix_types, select_by_pattern
from clientscope.functions.dates import day, shift_month_end
from clientscope.functions.numbers import null_safe_sum, safe_ratio
from clientscope.operators.correlation import correlations, kept_greedy, kept_of_groups
from clientscope.operators.joins import assemble, left_chain
from clientscope.operators.ranking import present
from clientscope.operators.rolling import rolling_windows

KEYS = ("epk", "report_dt")

# Spending categories of the monthly snapshot; each has a debit and a credit column
# crd_dc_pos_<name>, crd_cc_pos_<name>, and the sum is called pos_<name>.
POS_CATEGORIES = (
    "auto_rub_amt", "beuaty_rub_amt", "clear_amt", "clothes_rub_amt", "eat_out_rub_amt", "groceries_rub_amt",
    "healthcare_rub_amt", "home_repair_rub_amt", "leisure_rub_amt", "othr_rub_amt", "money_trf_rub_amt",
    "dept_stores_rub_amt", "special_rub_amt", "pc_it_rub_amt", "telecom_rub_amt", "tourism_rub_amt",
    "utilities_rub_amt",
)
# Flow columns averaged over twelve months.
FLOW_COLUMNS = (
    "crd_inf_total_rub_amt", "crd_inf_total_qty", "crd_dc_tot_bal_rub_amt", "crd_otf_pos_spend_rub_amt",
    "crd_otf_pos_spend_qty", "crd_otf_total_rub_amt", "crd_otf_total_qty", "dep_inf_income_rub_amt",
    "dep_otf_total_rub_amt", "dep_otf_total_qty", "pnl_oi_ca_amt", "pnl_oi_cc_amt", "pnl_oi_dc_amt",
    "pnl_oi_ml_amt", "pnl_oi_othr_amt", "pnl_oi_pl_amt", "pnl_oi_td_amt", "pnl_oi_total_amt",
    "srv_m2m_inf_other_bank_amt", "srv_m2m_inf_other_bank_qty", "srv_pmt_all_amt", "srv_pmt_all_qty",
    "crd_dc_m2m_other_bank_amt", "crd_inf_cash_adv_rub_amt", "crd_dc_p2p_other_bank_amt",
    "crd_dc_p2p_other_bank_qty", "dep_acct_dep_td_bal_rub_amt", "dep_tot_exp_2m_bal_rub_amt",
    "dep_tot_exp_3m_bal_rub_amt", "prd_da_active_nflag", "dep_acct_dep_tot_bal_rub_amt", "dep_acct_dep_tot_qty",
)
# Ratio name -> (numerator, denominator).
FLOW_RATIOS = {
    "in_payroll_share": ("dep_inf_income_rub_amt", "crd_inf_total_rub_amt"),
    "out_cash_share": ("crd_otf_cash_rub_amt", "crd_inf_total_rub_amt"),
    "out_pos_share": ("crd_otf_pos_spend_rub_amt", "crd_inf_total_rub_amt"),
    "out_pos_to_balance_share": ("crd_otf_pos_spend_rub_amt", "crd_dc_tot_bal_rub_amt"),
    "out_pos_to_spends_share": ("crd_otf_pos_spend_rub_amt", "dep_otf_total_rub_amt"),
    "m2m_to_income_share": ("crd_dc_m2m_other_bank_amt", "crd_inf_total_rub_amt"),
    "m2m_to_spends_share": ("crd_dc_m2m_other_bank_amt", "dep_otf_total_rub_amt"),
    "in_cash_to_income_share": ("crd_inf_cash_adv_rub_amt", "crd_inf_total_rub_amt"),
    "out_p2p_to_income_share": ("crd_dc_p2p_other_bank_amt", "crd_inf_total_rub_amt"),
    "out_p2p_to_spends_share": ("crd_dc_p2p_other_bank_amt", "dep_otf_total_rub_amt"),
    "in_payroll_share_qty": ("dep_inf_income_qty", "crd_inf_total_qty"),
    "out_cash_share_qty": ("crd_otf_cash_qty", "crd_inf_total_qty"),
    "out_pos_share_qty": ("crd_otf_pos_spend_qty", "crd_inf_total_qty"),
    "out_pos_to_spends_share_qty": ("crd_otf_pos_spend_qty", "dep_otf_total_qty"),
    "m2m_to_income_share_qty": ("crd_dc_m2m_other_bank_qty", "crd_inf_total_qty"),
    "m2m_to_spends_share_qty": ("crd_dc_m2m_other_bank_qty", "dep_otf_total_qty"),
    "in_cash_to_income_share_qty": ("crd_inf_cash_adv_qty", "crd_inf_total_qty"),
    "out_p2p_to_income_share_qty": ("crd_dc_p2p_other_bank_qty", "crd_inf_total_qty"),
    "out_p2p_to_spends_share_qty": ("crd_dc_p2p_other_bank_qty", "dep_otf_total_qty"),
}
# Parts of the total balance with investments.
INVEST_PARTS = (
    "dep_tot_bal_rub_amt", "inv_mf_agrmnt_bal_rub_amt", "inv_tm_agrmnt_bal_rub_amt",
    "inv_bo_agrmnt_bal_tot_rub_amt", "bal_invest_insur_life_amt", "bal_nakop_insur_life_amt",
)


def month_end_rollup(facts: DataFrame, value: str, name: str, dt: str = "dt") -> DataFrame:
    """Facts to month ends: ``sum_<name>`` of all values and ``qty_<name>`` of the positive ones."""
    return facts.groupBy("epk", F.last_day(dt).alias("report_dt")).agg(
        F.sum(value).alias(f"sum_{name}"), F.count(F.when(F.col(value) > 0, 1)).alias(f"qty_{name}")
    )


def _within_reach(df: DataFrame, target: DataFrame, months_back: int = 0) -> DataFrame:
    """Rows dated between the first target date, less some months, and the last: scalar subqueries that prune partitions."""
    reach = target.agg(F.min("report_dt").alias("lo"), F.max("report_dt").alias("hi"))
    first = reach.select(F.add_months("lo", -months_back)).scalar()
    return df.where(F.col("report_dt").between(first, reach.select("hi").scalar()))


def _days_within_reach(
    df: DataFrame, col: str, target: DataFrame, first: Callable[[Column], Column], last: Callable[[Column], Column] = lambda x: x
) -> DataFrame:
    """Rows whose stored date lies between a bound from the first target date and one from the last."""
    reach = target.agg(F.min("report_dt").alias("lo"), F.max("report_dt").alias("hi"))
    lo, hi = reach.select(first(F.col("lo"))).scalar(), reach.select(last(F.col("hi"))).scalar()
    return df.where(F.col(col).between(lo, hi))


def snapshot(target: DataFrame, source: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Snapshot rows at the target month ends. Only months within the target's are read, whichever join is chosen."""
    t = target.select(*KEYS).distinct()
    df = source.select(*KEYS, *cols) if cols else source
    dated = df.withColumn("report_dt", F.col("report_dt").cast("date"))
    return _within_reach(dated, target).join(t, list(KEYS))


def arrests(
    target: DataFrame, facts: DataFrame, value: str, mode: str = "correct", prune: bool | tuple[str, str] = True
) -> DataFrame:
    """Rolling sums, averages and their ratios of amount and count over 1, 3, 6, 9 and 12 months.

    Ratios exist between the windows from three months on. In ``compat`` mode a target needs a row in its own month.
    """
    name = "val_arrests"
    if prune is True:
        facts = _days_within_reach(facts, "dt", target, lambda x: F.trunc(F.add_months(x, -11), "MM"), F.last_day)
    hist = month_end_rollup(facts, value, name)
    cols = [f"sum_{name}", f"qty_{name}"]
    out = rolling_windows(target, hist, cols, windows=(1, 3, 6, 9, 12), mode=mode, prune=prune)
    return out.select([c for c in out.columns if not any(f"_{a}_1_" in c for a in ("sum", "avg"))])


def counter_windows(
    target: DataFrame, history: DataFrame, counters: Sequence[str], windows: Sequence[int] = (12, 3), prefix: str = "pfm_"
) -> DataFrame:
    """Sums of counters over the last months, zero where a client has no rows. One join serves all windows.

    The window starts at the same day of the month, ``add_months(report_dt, -(w - 1))``, not at a month end.
    """
    t = target.select(*KEYS).distinct()
    widest = max(windows)
    reachable = _within_reach(history, target, widest - 1)
    h = reachable.select(F.col("epk").alias("__k"), F.col("report_dt").alias("__dt"), *counters)

    def start(w: int) -> Column:
        return F.add_months(F.col("report_dt"), -(w - 1))

    joined = t.join(
        h, (F.col("epk") == F.col("__k")) & F.col("__dt").between(start(widest), F.col("report_dt")), "left"
    )
    sums = [
        F.coalesce(F.sum(F.when(F.col("__dt") >= start(w), F.col(c))), F.lit(0)).alias(f"{prefix}{c}_{w}m")
        for w in windows
        for c in counters
    ]
    return joined.groupBy(*KEYS).agg(*sums)


def visit_counts(target: DataFrame, visits: DataFrame, windows: Sequence[int] = (3, 12)) -> DataFrame:
    """Visits in the last months before each target date, for targets that have any.

    Visits are counted per client and day before they meet the target, and only days a target can reach are read.
    """
    t = target.select(*KEYS).distinct()
    widest = max(windows)
    reachable = _days_within_reach(visits, "dt", target, lambda first: F.add_months(first, -widest))
    days = reachable.groupBy(F.col("epk").alias("__k"), F.col("dt").alias("__dt")).agg(F.count(F.lit(1)).alias("__n"))

    def since(w: int) -> Column:
        return F.col("__dt") >= F.add_months("report_dt", -w)

    joined = t.join(days, (F.col("epk") == F.col("__k")) & since(widest) & (F.col("__dt") <= F.col("report_dt")))
    return joined.groupBy(*KEYS).agg(
        *[F.coalesce(F.sum(F.when(since(w), F.col("__n"))), F.lit(0)).alias(f"visits_{w}m") for w in windows]
    )


def flow_ratios(
    target: DataFrame,
    source: DataFrame,
    columns: Sequence[str] = FLOW_COLUMNS,
    ratios: Mapping[str, tuple[str, str]] = FLOW_RATIOS,
    parts: Sequence[str] = INVEST_PARTS,
    mode: str = "correct",
    prune: bool | tuple[str, str] = True,
) -> DataFrame:
    """Twelve-month averages of flows and of their monthly ratios, and the balance with investments also over three."""
    total = "tot_bal_with_invest"
    flows = source.select(
        *KEYS,
        *columns,
        *[safe_ratio(F.col(a), F.col(b)).alias(n) for n, (a, b) in ratios.items()],
        null_safe_sum(list(parts)).alias(total),
    )
    names = [*columns, *ratios, total]
    out = rolling_windows(
        target, flows, names, windows=(3, 12), aggs=("avg",), ratios=False, mode=mode, null_as_zero=False, prune=prune
    )
    return out.select(*KEYS, *[F.col(f"{c}_avg_12m").alias(f"{c}_12m") for c in names], F.col(f"{total}_avg_3m").alias(f"{total}_3m"))


def pos_sums(source: DataFrame, categories: Sequence[str] = POS_CATEGORIES, payments: str | None = "srv_pmt_utl_amt") -> DataFrame:
    """Debit plus credit spending per category and month; utilities also with payments outside the cards."""
    cols = [null_safe_sum([f"crd_dc_pos_{c}", f"crd_cc_pos_{c}"]).alias(f"pos_{c}") for c in categories]
    if payments:
        paid = F.coalesce(F.col(payments), F.lit(0.0))
        cols.append(paid.alias("paid_utilities_rub_amt"))
        cols.append(
            null_safe_sum(["crd_dc_pos_utilities_rub_amt", "crd_cc_pos_utilities_rub_amt", paid]).alias("total_utilities_rub_amt")
        )
    return source.select(*KEYS, *cols)


def pos_dynamics(
    target: DataFrame, sums: DataFrame, mode: str = "correct", prune: bool | tuple[str, str] = True
) -> DataFrame:
    """Six ratios of averages and six of sums per spending category."""
    cols = [c for c in sums.columns if c not in KEYS]
    return rolling_windows(target, sums, cols, mode=mode, keep_values=False, prune=prune)


def dynamics_by_schema(
    target: DataFrame,
    source: DataFrame,
    wanted: Sequence[str] | None = None,
    mode: str = "correct",
    columns_per_pass: int = 200,
    prune: bool | tuple[str, str] = True,
) -> DataFrame:
    """Four rolling sums and six ratios of every column whose name passes the pattern.

    ``wanted`` are feature names a model needs: only the columns behind them are read and aggregated.
    ``columns_per_pass`` splits thousands of columns into several aggregations, each small enough to be compiled;
    the parts are joined on the keys they are already partitioned by.
    """
    cols = select_by_pattern(source.columns)
    if wanted is not None:
        stems = {w.rsplit("_sum_", 1)[0] for w in wanted if "_sum_" in w}
        cols = [c for c in cols if c in stems]
    step = columns_per_pass
    passes = [
        rolling_windows(target, source.select(*KEYS, *part), part, aggs=("sum",), mode=mode, prune=prune)
        for part in (cols[i : i + step] for i in range(0, len(cols), step))
    ]
    out = left_chain(passes[0], passes[1:], list(KEYS))
    return out if wanted is None else out.select(*KEYS, *[c for c in out.columns if c in set(wanted)])


def lagged_embeddings(target: DataFrame, source: DataFrame, months: int = 1) -> DataFrame:
    """Embeddings moved to the month end before their date and joined to the target; only dates that can match are read."""
    reachable = _days_within_reach(
        source, "report_dt", target, lambda x: F.trunc(F.add_months(x, months), "MM"), lambda x: F.last_day(F.add_months(x, months))
    )
    moved = reachable.withColumn("report_dt", shift_month_end(F.col("report_dt"), -months))
    return target.select(*KEYS).distinct().join(moved, list(KEYS))


def monthly_embeddings(target: DataFrame, source: DataFrame, month: str = "mon") -> DataFrame:
    """Embeddings dated by month end; rows with another day in the month match no target and dates out of reach are not read."""
    reachable = _days_within_reach(source, month, target, lambda x: x)
    moved = reachable.withColumn("report_dt", F.to_date(month)).where(F.col("report_dt") == F.last_day("report_dt"))
    return target.select(*KEYS).distinct().join(moved.drop(month), list(KEYS))


def train_and_oot(df: DataFrame, oot_month: str | None) -> tuple[DataFrame, DataFrame | None]:
    """Hold one month out."""
    if oot_month is None:
        return df, None
    held = F.col("report_dt") == day(oot_month)
    return df.where(~held), df.where(held)


def all_features(
    target: DataFrame,
    blocks: Mapping[str, Callable[[DataFrame], DataFrame]],
    oot_month: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Build every block for the target, assemble them, fix types and split off the out-of-time month.

    Blocks are lazy; Spark plans them as one job. Use ``stage_if_absent`` around a block to persist it.
    """
    built = [build(target) for build in blocks.values()]
    return train_and_oot(fix_types(assemble(target, built)), oot_month)


# --- correlation filters -------------------------------------------------------------------------------------


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    kinds = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in skip]


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson matrix of a moderate number of columns, on the driver; NaN where a column does not vary."""
    out = np.full((len(cols), len(cols)), np.nan)
    for i, j, r in correlations(df, cols, -1.0).where("j >= 0").collect():
        out[i, j] = out[j, i] = r
    varies = df.agg(*[F.coalesce(F.stddev(F.when(present(c), F.col(c).cast("double"))) > 0, F.lit(False)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    np.fill_diagonal(out, [1.0 if v else np.nan for v in varies])
    return out


def correlated_pairs(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """(a, b, r) for column pairs with abs(r) above the threshold, a before b in column order."""
    names = F.array(*[F.lit(c) for c in cols])
    found = correlations(df, cols, threshold).where("j >= 0")
    return found.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "r")


def uncorrelated_greedy(df: DataFrame, cols: Sequence[str], threshold: float) -> list[str]:
    """The columns without those that correlate above the threshold with an earlier one that stays."""
    pairs = [(r.i, r.j) for r in correlations(df, cols, threshold).where("j >= 0").collect()]
    return [cols[i] for i in kept_greedy(len(cols), pairs)]


def uncorrelated_groups(df: DataFrame, cols: Sequence[str], threshold: float) -> list[str]:
    """One column of every group linked by correlations above the threshold: the one most correlated over all."""
    rows = correlations(df, cols, threshold).collect()
    weight = {r.i: round(r.r, 9) for r in rows if r.j < 0}
    kept = kept_of_groups(len(cols), [(r.i, r.j) for r in rows if r.j >= 0], [weight.get(i, 0.0) for i in range(len(cols))])
    return [cols[i] for i in kept]


def drop_correlated_greedy(df: DataFrame, threshold: float, skip: Sequence[str] = KEYS) -> DataFrame:
    """Drop every later column that correlates above the threshold with a kept one."""
    cols = numeric_columns(df, skip)
    kept = set(uncorrelated_greedy(df, cols, threshold)) if len(cols) > 1 else set(cols)
    return df.drop(*[c for c in cols if c not in kept])


def drop_correlated_groups(df: DataFrame, threshold: float, skip: Sequence[str] = KEYS) -> DataFrame:
    """Of every group of columns linked by a correlation above the threshold keep the most correlated one."""
    cols = numeric_columns(df, skip)
    kept = set(uncorrelated_groups(df, cols, threshold)) if len(cols) > 1 else set(cols)
    return df.drop(*[c for c in cols if c not in kept])
