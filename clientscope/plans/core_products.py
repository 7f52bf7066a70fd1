"""Flags and scores of core products: what a client has, pays and could gain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientscope.functions.dates import day, in_lookback, in_previous_month, shift_month_end
from clientscope.functions.predicates import flag, is_current, like_any
from clientscope.operators.aggregate import max_flags
from clientscope.operators.joins import left_chain

# Operation types of outgoing transfers, card service, notifications and cash withdrawal.
TRANSFER_TYPES = ("4060", "4062", "4061", "4050", "4052", "4051", "4071")
SERVICE_TYPES = ("1000025", "3001", "3030", "3800", "3801")
NOTIFY_TYPES = ("320", "3200", "1000026")
CASH_TYPES = ("4000", "4001", "4010", "4011", "4020", "4021", "4100", "4110", "4200", "4210", "4500")
INTEREST_TAGS = ("2770", "41227")


def transfer_flag(tx: DataFrame, anchor: str, types: Sequence[str] = TRANSFER_TYPES) -> DataFrame:
    """1 if the client sent money by a listed operation type last month. ``tx``: epk, dt, trx_type, amt."""
    month = tx.where(in_previous_month(F.col("dt"), anchor))
    sent = F.sum(F.when(F.col("trx_type").isin(list(types)), F.col("amt")))
    return month.groupBy("epk").agg(flag(F.coalesce(sent, F.lit(0.0)) > 0).alias("transfer_flag"))


def fee_amounts(
    daily: DataFrame,
    monthly: DataFrame,
    anchor: str,
    service: Sequence[str] = SERVICE_TYPES,
    notify: Sequence[str] = NOTIFY_TYPES,
    cash: Sequence[str] = CASH_TYPES,
) -> DataFrame:
    """Largest card service and notification fee, and cash withdrawal fees since the last month end but one."""

    def of(types: Sequence[str]) -> Column:
        return F.when(F.col("trx_type").isin(list(types)), F.col("amt"))

    recent = in_lookback(F.col("dt"), anchor, 1)
    a = daily.where(recent).groupBy("epk").agg(
        F.max(F.coalesce(of(service), F.lit(0.0))).alias("service_fee"),
        F.max(F.coalesce(of(notify), F.lit(0.0))).alias("notify_fee"),
    )
    b = monthly.where(recent).groupBy("epk").agg(F.sum(of(cash)).alias("cash_fee"))
    return a.join(b, "epk", "full")


def subscription_flags(packets: DataFrame, tiers: Mapping[str, Sequence[str]], trial_words: Sequence[str]) -> DataFrame:
    """Highest flag per subscription tier over active packets that are no trial. ``packets``: epk, category, name, state."""
    paid = packets.where((F.col("state") == "ACTIVE") & ~like_any(F.col("name"), trial_words))
    return paid.groupBy("epk").agg(
        *[F.max(flag(F.col("category").isin(list(names)))).alias(tier) for tier, names in tiers.items()]
    )


def term_flags(
    accounts: DataFrame, anchor: str, lines: Mapping[str, str], names: Sequence[str], types: Sequence[str],
    closed_state: int = 2, months_ahead: int = 2,
) -> DataFrame:
    """Per product line 1 if an open account with the line's keyword ends later than ``months_ahead`` month ends ahead.

    ``accounts``: epk, name, type, close_dt, report_dt, state. Used for deposits and for savings accounts.
    """
    kept = accounts.where(
        (F.col("report_dt") == day(anchor))
        & (F.col("state") != closed_state)
        & F.col("type").isin(list(types))
        & F.col("name").isin(list(names))
    )
    late = F.col("close_dt") > shift_month_end(anchor, months_ahead)
    return kept.groupBy("epk").agg(
        *[F.max(flag(like_any(F.col("name"), [word]) & late)).alias(f"only_{line}") for line, word in lines.items()]
    )


def coin_flag(operations: DataFrame, anchor: str, word: str, months: int = 18) -> DataFrame:
    """1 if a coin was bought in the last months. ``operations``: epk, scenario, dt."""
    recent = operations.where(in_lookback(F.col("dt"), anchor, months) & F.col("epk").isNotNull())
    return recent.groupBy("epk").agg(F.max(flag(like_any(F.col("scenario"), [word]))).alias("coins_flag"))


def design_flags(cards: DataFrame, designs: Mapping[str, str]) -> DataFrame:
    """Per design 1 if an open card carries it. ``cards``: epk, card_design, row_actual_to_dt."""
    hit = {name: F.col("card_design").contains(part) for name, part in designs.items()}
    open_cards = cards.where(F.col("row_actual_to_dt") == "9999-12-31")
    any_hit = F.greatest(*[flag(c) for c in hit.values()]) if len(hit) > 1 else flag(next(iter(hit.values())))
    return open_cards.where(any_hit == 1).groupBy("epk").agg(*[F.max(flag(c)).alias(n) for n, c in hit.items()])


def balance_3m(snapshot: DataFrame, anchor: str) -> DataFrame:
    """Average balance and sum of outgoing transfers over three month ends. ``snapshot``: epk, report_dt, balance, sent."""
    window = F.col("report_dt").between(shift_month_end(anchor, -2), day(anchor))
    return snapshot.where(window).groupBy("epk").agg(
        F.avg("balance").alias("avg_balance_3m"), F.sum("sent").alias("sum_sent_3m")
    )


def tag_flags(tags: DataFrame, wanted: Sequence[str] = INTEREST_TAGS) -> DataFrame:
    """Per tag 1 if the client currently has it; clients with none are absent."""
    return (
        tags.where(is_current() & F.col("nsi_id").isin(list(wanted)))
        .groupBy("epk")
        .agg(*[F.max(flag(F.col("nsi_id") == t)).alias(f"tag_{t}") for t in wanted])
    )


def all_flags(base: DataFrame, blocks: Sequence[DataFrame]) -> DataFrame:
    """Base clients with every block, one row per client, null as zero. Blocks hold one row per client already."""
    joined = left_chain(base.select("epk").distinct(), blocks, "epk")
    return max_flags(joined, "epk", [c for c in joined.columns if c != "epk"])


@dataclass(frozen=True)
class ScoreRule:
    """Score of one product: the benefit itself, a blend of benefit and value, or ``default``.

    ``direct`` and ``blended`` are conditions; ``benefit`` is what the client would gain; ``value`` is what the
    product is worth to the bank.
    """

    name: str
    direct: Column
    benefit: Column
    blended: Column
    value: Column | None = None
    benefit_weight: float = 0.4
    value_weight: float = 0.6
    default: float = 1.0
    digits: int = 4

    def column(self) -> Column:
        blend = self.benefit * F.lit(self.benefit_weight)
        if self.value is not None:
            blend = blend + self.value * F.lit(self.value_weight)
        return (
            F.when(self.direct, self.benefit.cast("double"))
            .when(self.blended, F.round(blend, self.digits).cast("double"))
            .otherwise(F.lit(self.default))
            .alias(self.name)
        )


def level_rules(
    level: int,
    line: str,
    values: Mapping[str, float],
    min_balance: float = 50_000.0,
    min_sent: float = 50_000.0,
    min_spend: float = 50_000.0,
    first_line_level: int = 1,
    lending: bool = False,
    lines: Sequence[str] = ("first", "second", "third"),
) -> list[ScoreRule]:
    """The product rules of one level.

    Reads the flags ``card metal_card subscription subscription_plus service_fee notify_fee cash_fee transfer bonus
    metal_account coins only_deposit_<line> only_savings_<line> credit_card loan``, the amounts ``avg_balance_3m
    sum_sent_3m avg_spend_3m`` and the benefits ``card_<n> deposit_<n> savings_<n> bonus_<n> transfer_<n>``. Fees are
    compared with one, as the flags they are. Lending rules exist on the upper line only.

    On the first level a deposit or savings account is blended only if the client has none on any of the ``lines``.
    On all further levels the blended savings score looks at the first line, whatever line the level belongs to. The
    credit card's score is a whole number.
    """
    c = F.col
    on = lambda name: c(name) == 1
    off = lambda name: c(name) == 0
    fees = on("service_fee") | on("notify_fee") | on("cash_fee")
    paying = on("notify_fee") | on("cash_fee")
    subscribed = on("subscription") | on("subscription_plus")
    card, deposit, savings = c(f"card_{level}"), c(f"deposit_{level}"), c(f"savings_{level}")
    bonus, transfer = c(f"bonus_{level}"), c(f"transfer_{level}")
    rich = (c("avg_balance_3m") > min_balance) | (c("sum_sent_3m") > min_sent)
    owns, saves = f"only_deposit_{line}", f"only_savings_{line}"

    def without(product: str, of: str) -> Column:
        held = lines if level == first_line_level else (of,)
        return reduce(Column.__and__, [off(f"only_{product}_{x}") for x in held])

    def value(product: str) -> Column:
        return F.lit(float(values[product]))

    zero = F.lit(0.0)
    metal_weights = (0.6, 0.5) if level == first_line_level else (0.5, 0.6)
    rules = [
        ScoreRule(
            f"score_card_{level}",
            on("card") & (off("subscription") | off("subscription_plus") | paying) & (card > 0),
            card,
            off("card") & fees,
            value("card"),
        ),
        ScoreRule(f"score_metal_card_{level}", on("metal_card") & paying & (card > 0), card, off("metal_card") & fees, value("card")),
        ScoreRule(f"score_deposit_{level}", off(owns) & (deposit > 0), deposit, without("deposit", line) & rich, value("deposit")),
        ScoreRule(
            f"score_savings_{level}", off(saves) & (savings > 0), savings,
            without("savings", lines[0]) & (c("avg_balance_3m") > min_balance), value("savings"),
        ),
        ScoreRule(
            f"score_metal_account_{level}", F.lit(False), zero, on("metal_account") | on("coins"),
            value("metal_account") * F.when(on("metal_account"), metal_weights[0]).otherwise(metal_weights[1]), value_weight=1.0,
        ),
        ScoreRule(
            f"score_bonus_{level}", on("bonus") & subscribed & (bonus > 0), bonus,
            off("bonus") & (c("avg_spend_3m") > min_spend), benefit_weight=0.5,
        ),
        ScoreRule(
            f"score_transfer_{level}", on("transfer") & subscribed & (transfer > 0), transfer, off("transfer"), benefit_weight=0.5
        ),
    ]
    if lending:
        for product, digits in (("credit_card", 0), ("loan", 4)):
            share = F.when(on(product), 0.1).when(off(product), 0.2)
            rules.append(ScoreRule(f"score_{product}_{level}", F.lit(False), zero, share.isNotNull(), value(product) * share, value_weight=1.0, digits=digits))
    return rules


def product_scores(flags: DataFrame, rules: Sequence[ScoreRule], keep: Sequence[str] = ("epk",)) -> DataFrame:
    """All scores in one projection."""
    return flags.select(*keep, *[r.column() for r in rules])

