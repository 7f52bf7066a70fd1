"""Evaluation of scores against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientscope.ml import evaluate as ev
from clientscope.operators.aggregate import masked_means
from clientscope.queries.registry import query
from clientscope.sources import fixtures as fx

TIED_SQL = "tied as (select id, y, floor(score / 500) as score from binary_scored)"
CLASSES = {k: f"s{k}" for k in range(10)}
LONG_SQL = "long as (" + " union all ".join(
    f"select id, '{k}' as cls, s{k} as score, case when y = {k} then 1 else 0 end as y from multi_scored" for k in range(10)
) + ")"


def tied(spark, sf):
    return fx.binary_scored(spark, sf).select("id", "y", F.floor(F.col("score") / 500).cast("double").alias("score"))


@query(
    "eval_roc_auc",
    fx.with_views("binary_scored", TIED_SQL)
    + """, r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from tied)
         select round((sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0)
                      / (count(*) filter (y = 1) * count(*) filter (y = 0)), 9) as auc,
                count(*) filter (y = 1) as positives, count(*) filter (y = 0) as negatives from r""",
)
def eval_roc_auc(spark, sf):
    return ev.roc_auc(tied(spark, sf), F.col("y") == 1, "score")


AUC_SQL = """select {name} as name, round((sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0)
    / (count(*) filter (y = 1) * count(*) filter (y = 0)), 9) as auc, count(*) filter (y = 1) as support from {source} {group}"""


@query(
    "eval_auc_ovr",
    fx.with_views("multi_scored", LONG_SQL)
    + """, r as (select cls, y, rank() over (partition by cls order by score) + (count(*) over (partition by cls, score) - 1) / 2.0 as rk from long),
           p as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from long), per as ("""
    + AUC_SQL.format(name="cls", source="r", group="group by cls")
    + ") select * from per union all select 'macro', round(avg(auc), 9), cast(sum(support) as bigint) from per union all "
    "select 'weighted', round(sum(auc * support) / sum(support), 9), cast(sum(support) as bigint) from per union all "
    + AUC_SQL.format(name="'micro'", source="p", group=""),
)
def eval_auc_ovr(spark, sf):
    return ev.auc_one_vs_rest(fx.multi_scored(spark, sf), "y", CLASSES)


BINARY_HAT = "select y, case when score >= 2 then 1 else 0 end as predicted from tied"


def binary_hat(spark, sf):
    return tied(spark, sf).select("y", F.when(F.col("score") >= 2, 1).otherwise(0).alias("predicted"))


MULTI_HAT = """select m.y, p.predicted from multi_scored m join (select id, cast(arg_max(cls, (score, -cast(cls as int))) as int) as predicted
    from long group by id) p on p.id = m.id"""


def multi_hat(spark, sf):
    """Class with the largest score, decided inside the row."""
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("s"), F.lit(-k).alias("k")) for k, c in CLASSES.items()]))
    return fx.multi_scored(spark, sf).select("y", (-best["k"]).alias("predicted"))


@query(
    "eval_confusion",
    fx.with_views("binary_scored", TIED_SQL) + f"select y, predicted, count(*) as n from ({BINARY_HAT}) group by 1, 2",
)
def eval_confusion(spark, sf):
    return ev.confusion(binary_hat(spark, sf), "y", "predicted")


REPORT_SQL = """names as (select distinct y as c from hat union select distinct predicted from hat),
    per as (select cast(c as varchar) as name, coalesce(count(*) filter (y = c and predicted = c) / nullif(count(*) filter (predicted = c), 0), 0) as p,
                   coalesce(count(*) filter (y = c and predicted = c) / nullif(count(*) filter (y = c), 0), 0) as r,
                   count(*) filter (y = c) as support from names cross join hat group by c),
    f as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f1 from per)
    select name, round(p, 9) as precision, round(r, 9) as recall, round(f1, 9) as f1, support from f
    union all select 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9), cast(sum(support) as bigint) from f
    union all select 'weighted avg', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9),
                     round(sum(f1 * support) / sum(support), 9), cast(sum(support) as bigint) from f"""


@query("eval_class_report", fx.with_views("binary_scored", TIED_SQL, f"hat as ({BINARY_HAT})") + ", " + REPORT_SQL)
def eval_class_report(spark, sf):
    return ev.class_report(ev.confusion(binary_hat(spark, sf), "y", "predicted"))


@query("eval_class_report_multi", fx.with_views("multi_scored", LONG_SQL, f"hat as ({MULTI_HAT})") + ", " + REPORT_SQL)
def eval_class_report_multi(spark, sf):
    return ev.class_report(ev.confusion(multi_hat(spark, sf), "y", "predicted"))


def lift_sql(source, by, floor_one):
    shares = ", ".join(f"({p}::double)" for p in ev.SHARES)
    size = "greatest(1, floor(n * share))" if floor_one else "floor(n * share)"
    group = "cls, " if by else ""
    part = "partition by cls" if by else ""
    return f"""ranked as (select *, row_number() over ({part} order by score desc, id) as rank, count(*) over ({part}) as n,
        sum(y) over ({part}) as p from {source})
    select {group}share, count(*) filter (rank <= {size}) as size,
        round(count(*) filter (rank <= {size} and y = 1) / nullif(count(*) filter (rank <= {size}), 0), 9) as precision,
        round(count(*) filter (rank <= {size} and y = 1) / max(p), 9) as recall,
        round(2 * count(*) filter (rank <= {size} and y = 1) / (count(*) filter (rank <= {size}) + max(p)), 9) as f1,
        min(score) filter (rank <= {size}) as min_score,
        round(count(*) filter (rank <= {size} and y = 1) / nullif(count(*) filter (rank <= {size}), 0) / (max(p) / max(n)), 9) as lift
    from ranked cross join (values {shares}) v(share) group by {group}share"""


@query("eval_lift_table", fx.with_views("binary_scored", TIED_SQL) + ", " + lift_sql("tied", False, False))
def eval_lift_table(spark, sf):
    return ev.lift_table(tied(spark, sf), F.col("y") == 1, "score", "id")


@query("eval_lift_table_multi", fx.with_views("multi_scored", LONG_SQL) + ", " + lift_sql("long", True, True))
def eval_lift_table_multi(spark, sf):
    return ev.class_lift_table(fx.multi_scored(spark, sf), "y", CLASSES, "id")


@query(
    "eval_best_fbeta",
    fx.with_views("binary_scored", TIED_SQL)
    + """, g as (select score, sum(y) as pos, count(*) as n from tied group by 1),
           c as (select score, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as k,
                        (select sum(y) from tied) as p from g),
           m as (select score as threshold, round(tp / k, 9) as precision, round(tp / p, 9) as recall,
                        round(coalesce(5 * (tp / k) * (tp / p) / nullif(4 * (tp / k) + tp / p, 0), 0), 9) as fbeta, 2.0::double as beta from c)
         select * from m order by fbeta desc, threshold desc limit 1""",
)
def eval_best_fbeta(spark, sf):
    return ev.best_fbeta(tied(spark, sf), F.col("y") == 1, "score", beta=2.0)


@query(
    "eval_feature_class_means",
    fx.with_views("features_wide")
    + "select target, " + ", ".join(f"round(avg(case when f{k} > -1 and f{k} < 100000000 then f{k} end), 6) as f{k}" for k in range(64))
    + " from features_wide group by target",
)
def eval_feature_class_means(spark, sf):
    names = [f"f{k}" for k in range(64)]
    means = masked_means(fx.features_wide(spark, sf), "target", names)
    return means.select("target", *[F.round(c, 6).alias(c) for c in names])


HIST_SQL = " union all ".join(f"select target, 'f{k}' as feature, f{k} as value from features_wide" for k in range(64))


@query(
    "eval_class_histogram",
    fx.with_views("features_wide", f"lg as ({HIST_SQL})")
    + """, b as (select feature, target, case when value < -0.5 then 0 when value >= 0.5 then 21 else floor((value + 0.5) * 20)::bigint + 1 end as bin from lg)
         select feature, target, bin::bigint as bin, count(*) as n, round(count(*) / sum(count(*)) over (partition by feature, target), 9) as share
         from b group by 1, 2, 3""",
)
def eval_class_histogram(spark, sf):
    return ev.class_histogram(fx.features_wide(spark, sf), "target", [f"f{k}" for k in range(64)], -0.5, 0.5, 20)


@query(
    "eval_class_density",
    fx.with_views("features_wide", f"lg as ({HIST_SQL})")
    + """, s as (select feature, target, count(*) as n, stddev_samp(value) * pow(count(*), -0.2) as h from lg group by 1, 2),
           g as (select unnest(range(41)) as point),
           v as (select feature, target, (value + 0.5) / 0.025 as pt, least(floor((value + 0.5) / 0.025), 39) as lo from lg where value between -0.5 and 0.5),
           k as (select s.feature, s.target, g.point, sum((1 - pt + lo) * exp(-pow((g.point - lo) * 0.025 / h, 2) / 2)
                                                          + (pt - lo) * exp(-pow((g.point - lo - 1) * 0.025 / h, 2) / 2)) as total
                 from v join s on v.feature = s.feature and v.target = s.target cross join g group by all)
         select s.feature, s.target, g.point::int as point, round(-0.5 + g.point * 0.025, 9)::double as x,
                round(coalesce(total, 0) / (n * h * sqrt(2 * pi())), 6) as density
         from s cross join g left join k on k.feature = s.feature and k.target = s.target and k.point = g.point""",
)
def eval_class_density(spark, sf):
    return ev.class_density(fx.features_wide(spark, sf), "target", [f"f{k}" for k in range(64)], -0.5, 0.5, 41)


@query(
    "eval_score_describe",
    fx.with_views("binary_scored")
    + """select count(*) as count, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, min(score) as min,
                round(quantile_cont(score, 0.25), 6) as q25, round(quantile_cont(score, 0.5), 6) as q50,
                round(quantile_cont(score, 0.75), 6) as q75, max(score) as max from binary_scored""",
)
def eval_score_describe(spark, sf):
    return ev.describe_scores(fx.binary_scored(spark, sf), "score")
