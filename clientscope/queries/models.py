"""Splits, encoding, training and scoring. Fits have the functions' default size; boosting fits share one binned matrix a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientscope.ml import boosting as bo
from clientscope.ml import evaluate as ev
from clientscope.ml import models as m
from clientscope.ml import search as se
from clientscope.ml.binned import build_matrix
from clientscope.ml.split import assign_parts
from clientscope.queries.registry import query
from clientscope.sources import fixtures as fx
from clientscope.sources.sinks import stored

BUCKET_SQL = "(('0x' || substr(md5({k} || '|0'), 1, 8))::ubigint % 100)"
PART_SQL = f"case when {BUCKET_SQL} < 60 then 'train' when {BUCKET_SQL} < 80 then 'val' else 'test' end"


@query("ml_split_60_20_20", f"select o_orderkey as id, {PART_SQL.format(k='o_orderkey')} as part from orders")
def ml_split_60_20_20(spark, sf):
    return assign_parts(fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id")


@query(
    "ml_ordinal_encode",
    f"""with s as (select p_partkey, p_type, p_brand, {PART_SQL.format(k="p_partkey")} as part from part where p_type <> 'PROMO' or
                   {PART_SQL.format(k="p_partkey")} <> 'train'),
        t as (select p_type, dense_rank() over (order by p_type) - 1 as c from (select distinct p_type from s where part = 'train')),
        b as (select p_brand, dense_rank() over (order by p_brand) - 1 as c from (select distinct p_brand from s where part = 'train'))
        select p_partkey as id, cast(coalesce(t.c, -1) as int) as p_type, cast(coalesce(b.c, -1) as int) as p_brand
        from s left join t on t.p_type = s.p_type left join b on b.p_brand = s.p_brand where part = 'test'""",
)
def ml_ordinal_encode(spark, sf):
    """One type is kept out of the training part, so it is unseen in the test part."""
    parts = assign_parts(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_brand"), "id")
    train = parts.where("part = 'train' and p_type <> 'PROMO'")
    (test,) = m.ordinal_encode(train, [parts.where("part = 'test'")], ["p_type", "p_brand"])
    return test.drop("part")


BINARY = ["n_chars", "n_words", "n_lines", "lang", "source"]


def documents(spark, sf):
    """Labelled documents with whole-text counts and two category columns."""
    d = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("epk"), F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"), "lang", "source",
    )
    y = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("epk"), F.col("quality").alias("target"))
    return d.join(y, "epk")


def binary_parts(spark, sf):
    parts = assign_parts(documents(spark, sf), "epk")
    frames = [parts.where(F.col("part") == p).drop("part") for p in ("train", "val", "test")]
    return m.ordinal_encode(frames[0], frames, ["lang", "source"])


def aucs(spark, model, parts, features):
    rows = [(name, m.binary_auc(model, df, features, "target"), len(features)) for name, df in zip(("train", "val", "test"), parts)]
    return m.rows_to_frame(spark, rows, "part string, auc double, features int")


@query("ml_forest_binary")
def ml_forest_binary(spark, sf):
    """Fit, cut by importance, refit."""
    parts = binary_parts(spark, sf)
    first = m.fit(m.forest(), parts[0], BINARY, "target")
    kept = m.top_features(first, BINARY, cut=0.02)
    return aucs(spark, m.fit(m.forest(), parts[0], kept, "target"), parts, kept)


@query("ml_boosting_binary")
def ml_boosting_binary(spark, sf):
    parts = binary_parts(spark, sf)
    model = m.fit(m.boosting(), parts[0], BINARY, "target", val=parts[1])
    return aucs(spark, model, parts, BINARY)


MULTI = [f"f{k}" for k in range(64)]


def multi_parts(spark, sf):
    parts = assign_parts(fx.features_wide(spark, sf), "epk")
    return [parts.where(F.col("part") == p).drop("part") for p in ("train", "val", "test")]


def multi_forest(spark, sf, features=MULTI):
    train = multi_parts(spark, sf)[0]
    return m.fit(m.forest(), train, features, "target")


def split_documents(spark, sf):
    """All labelled documents with their part, category columns encoded on the training part. The texts are counted in one
    pass: encoding, borders, counts and blocks read the stored columns."""
    parts = stored(assign_parts(documents(spark, sf), "epk"), "counted")
    (coded,) = m.ordinal_encode(parts.where("part = 'train'"), [parts], ["lang", "source"])
    return coded


def split_embeddings(spark, sf):
    return assign_parts(fx.features_wide(spark, sf), "epk")


@query(
    "ml_binned_matrix",
    f"""with p as (select {PART_SQL.format(k="vec_id")} as part, label from embeddings)
        select part, label as class, count(*) as n, 64::bigint as features from p group by 1, 2""",
)
def ml_binned_matrix(spark, sf):
    """Rows of each part and class, read back from the blocks of the matrix."""
    matrix = build_matrix(split_embeddings(spark, sf), MULTI, "target")
    cells = matrix.table.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(
            F.conv(F.hex(F.substring("p", i, F.lit(1))), 16, 10).cast("int").alias("p"), F.conv(F.hex(F.substring("y", i, F.lit(1))), 16, 10).cast("int").alias("y")))).alias("c"),
        F.expr("octet_length(bins) div n").cast("bigint").alias("features"),
    )
    names = [F.element_at(F.array(*[F.lit(v) for v in values]), F.col(f"c.{c}") + 1).alias(name) for values, c, name in ((matrix.parts, "p", "part"), (matrix.classes, "y", "class"))]
    return cells.select(*names, "features").groupBy("part", "class", "features").agg(F.count(F.lit(1)).alias("n"))


def softmax_model(spark, sf):
    """All 64 columns, trees of depth 5, early stopping on the validation part."""
    parts = split_embeddings(spark, sf)
    return parts, bo.fit_softmax(build_matrix(parts, MULTI, "target"))


@query("ml_boosting_multiclass")
def ml_boosting_multiclass(spark, sf):
    """Softmax boosting of all classes at once; the report is that of the test part."""
    parts, model = softmax_model(spark, sf)
    scored = bo.predict(model, parts.where("part = 'test'"), "target")
    return ev.class_report(ev.confusion(scored.select(F.col("target").alias("y"), bo.predicted_class(model).alias("predicted")), "y", "predicted"))


@query(
    "ml_softmax_scores",
    f"select vec_id as epk, {PART_SQL.format(k='vec_id')} as part, label as target, 10::int as classes, 1.0::double as total, true as inside from embeddings",
)
def ml_softmax_scores(spark, sf):
    """Every row scored: as many probabilities as classes, all inside (0, 1), adding up to one."""
    parts, model = softmax_model(spark, sf)
    total = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
    return bo.predict(model, parts, "epk", "part", "target").select(
        "epk", "part", "target", F.size("proba").alias("classes"), F.round(total, 6).alias("total"), F.forall("proba", lambda x: (x > 0) & (x < 1)).alias("inside")
    )


#: A fit for each step: a larger rate and less patience, so that a fit takes tens of rounds; all rows, columns and levels.
QUICK = bo.Params(rate=0.3, patience=5)
STEPS = "features int, dropped string, auc double, rounds int"


@query("ml_feature_elimination")
def ml_feature_elimination(spark, sf):
    """Binary: importance cut, then the weakest column goes, fit after fit, all on one matrix."""
    matrix = build_matrix(split_documents(spark, sf), BINARY, "target")
    return m.rows_to_frame(spark, se.eliminate(matrix, QUICK), STEPS)


@query("ml_feature_elimination_multiclass")
def ml_feature_elimination_multiclass(spark, sf):
    """Ten classes: from all 64 columns to 50 in five steps."""
    matrix = build_matrix(split_embeddings(spark, sf), MULTI, "target")
    return m.rows_to_frame(spark, se.eliminate(matrix, QUICK, least=50, steps=5), STEPS)


def searched(spark, matrix, gap):
    trials = se.halving(matrix, gap=gap)
    rows = [(t.number, ", ".join(f"{k}={v}" for k, v in sorted(t.params.items())), t.rounds, t.rung, t.train_auc, t.val_auc, t.objective) for t in trials]
    return m.rows_to_frame(spark, rows, "trial int, params string, rounds int, rung int, train_auc double, val_auc double, objective double")


@query("ml_param_search")
def ml_param_search(spark, sf):
    """Binary: 150 trials by successive halving; a training AUC more than 0.01 above the validation AUC ends a trial."""
    return searched(spark, build_matrix(split_documents(spark, sf), BINARY, "target"), m.BINARY_GAP)


@query("ml_param_search_multiclass")
def ml_param_search_multiclass(spark, sf):
    """Ten classes: the same with a gap of 0.02."""
    return searched(spark, build_matrix(split_embeddings(spark, sf), MULTI, "target"), m.MULTICLASS_GAP)


def dated_features(spark, sf):
    """Features spread over three month ends by key."""
    month = F.element_at(F.array(*[F.lit(x).cast("date") for x in fx.REPORT_MONTHS]), (F.col("epk") % 3 + 1).cast("int"))
    return fx.features_wide(spark, sf).withColumn("report_dt", month)


@query(
    "ml_time_folds",
    """with c as (select count(*) filter (vec_id % 3 = 0) as a, count(*) filter (vec_id % 3 = 1) as b, count(*) filter (vec_id % 3 = 2) as c from embeddings)
       select 'm1_to_m2' as fold, a as train_n, b as valid_n from c union all select 'm1_to_m3', a, c from c
       union all select 'm1_m2_to_m3', a + b, c from c""",
)
def ml_time_folds(spark, sf):
    return m.fold_sizes(dated_features(spark, sf), fx.REPORT_MONTHS)


@query("ml_time_fold_fits")
def ml_time_fold_fits(spark, sf):
    """One fit per fold, all grown side by side; only the metrics are kept."""
    rows = se.fold_fits(dated_features(spark, sf), fx.REPORT_MONTHS, MULTI, "target")
    return m.rows_to_frame(spark, rows, "fold string, train_n int, valid_n int, train_auc double, valid_auc double, rounds int")


@query("topk_by_importance")
def topk_by_importance(spark, sf):
    ranked = m.importances(multi_forest(spark, sf), MULTI)[:20]
    return m.rows_to_frame(spark, [(i + 1, f, v) for i, (f, v) in enumerate(ranked)], "rank int, feature string, importance double")


@query("score_batch_binary")
def score_batch_binary(spark, sf):
    train, val, test = binary_parts(spark, sf)
    model = m.fit(m.forest(), train, BINARY, "target")
    return m.score_binary(model, train.unionByName(val).unionByName(test), BINARY, fx.ANCHOR)


@query("score_batch_multiclass")
def score_batch_multiclass(spark, sf):
    model = multi_forest(spark, sf)
    return m.score_multiclass(model, fx.features_wide(spark, sf), MULTI, list(range(1, 11)), fx.ANCHOR)


@query("score_batch_binary_keys", f"select distinct doc_id as epk, '{fx.ANCHOR}' as report_dt from labels join documents using (doc_id)")
def score_batch_binary_keys(spark, sf):
    """Every labelled document has one score from 0 to 1 under its key and date."""
    return score_batch_binary(spark, sf).where("score between 0 and 1").select("epk", "report_dt")


@query("score_batch_multiclass_keys", f"select vec_id as epk, 10::int as scores, '{fx.ANCHOR}' as report_dt from embeddings")
def score_batch_multiclass_keys(spark, sf):
    """Every row has a score of each class, and they add up to one."""
    scored = score_batch_multiclass(spark, sf)
    names = [c for c in scored.columns if c.startswith("cluster_")]
    total = F.aggregate(F.array(*names), F.lit(0.0), lambda a, x: a + x)
    return scored.where(F.abs(total - 1) < 1e-5).select("epk", F.lit(len(names)).alias("scores"), "report_dt")


WEIGHTS = [round(0.5 - k / 64, 4) for k in range(64)]


@query(
    "score_linear_vectorized",
    fx.with_views("features_wide")
    + "select epk, round(" + " + ".join(f"f{k} * ({w})::double" for k, w in enumerate(WEIGHTS)) + " + 0.25::double, 6) as score, "
    "'1998-12-31' as report_dt from features_wide",
)
def score_linear_vectorized(spark, sf):
    out = m.score_with(fx.features_wide(spark, sf), MULTI, m.linear_scorer(WEIGHTS, 0.25), fx.ANCHOR)
    return out.withColumn("score", F.round("score", 6))
