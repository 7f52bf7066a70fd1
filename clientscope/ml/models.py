"""Training and batch scoring with MLlib. Only models, importances and metrics come to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientscope.ml.evaluate import auc_one_vs_rest, roc_auc
from clientscope.ml.split import month_folds
from clientscope.operators.ranking import present

# Trial rejected when training AUC exceeds validation AUC by more than this.
BINARY_GAP, MULTICLASS_GAP = 0.01, 0.02


def ordinal_encode(train: DataFrame, frames: Sequence[DataFrame], cols: Sequence[str]) -> list[DataFrame]:
    """Replace category columns by codes in alphabetical order, fitted on ``train``; unseen and null become -1.

    Meant for category columns: their labels form the fitted model and are held by it.
    """
    outs = [f"__{c}" for c in cols]
    fitted = StringIndexer(
        inputCols=list(cols), outputCols=outs, stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(train)
    sizes = dict(zip(cols, (len(labels) for labels in fitted.labelsArray)))

    def encoded(df: DataFrame) -> DataFrame:
        t = fitted.transform(df)
        codes = {
            c: F.when(F.col(o) < sizes[c], F.col(o)).otherwise(-1.0).cast("int").alias(c) for c, o in zip(cols, outs)
        }
        return t.select([codes.get(c, F.col(c)) for c in df.columns])

    return [encoded(f) for f in frames]


#: Missing values stand below all others, so that a tree can set them apart by one split.
MISSING = -1e30


def assembled(df: DataFrame, features: Sequence[str], label: str, *keep: str) -> DataFrame:
    """Feature vectors; a null or NaN feature becomes MISSING."""
    whole = df.withColumns({f: F.when(present(f), F.col(f).cast("double")).otherwise(MISSING) for f in features})
    vectors = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(whole)
    return vectors.select("features", F.col(label).cast("double").alias("label"), *keep)


def forest(trees: int = 500, depth: int = 5, seed: int = 0) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64)


def boosting(rounds: int = 100, depth: int = 5, step: float = 0.1, seed: int = 0) -> GBTClassifier:
    """Boosted trees; rounds stop early when the rows marked ``is_val`` no longer improve."""
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, validationIndicatorCol="is_val", maxBins=64)


def fit(estimator: Estimator, train: DataFrame, features: Sequence[str], label: str, val: DataFrame | None = None) -> Model:
    """Fit on ``train``; with ``val`` and an early-stopping estimator its rows decide when to stop.

    The assembled rows are read once per tree level, so they are persisted while fitting.
    """
    data = train.withColumn("is_val", F.lit(False))
    if val is not None:
        data = data.unionByName(val.withColumn("is_val", F.lit(True)))
    data = assembled(data, features, label, "is_val").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()


def importances(model: Model, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance), largest first; one number per feature."""
    return sorted(zip(features, (float(x) for x in model.featureImportances.toArray())), key=lambda p: (-p[1], p[0]))


def top_features(model: Model, features: Sequence[str], k: int | None = None, cut: float | None = None) -> list[str]:
    ranked = importances(model, features)
    if cut is not None:
        ranked = [p for p in ranked if p[1] > cut] or ranked[:1]
    return [f for f, _ in (ranked[:k] if k else ranked)]


def predict(model: Model, df: DataFrame, features: Sequence[str], label: str, *keep: str) -> DataFrame:
    """keep..., label and ``proba`` as an array with one probability per class."""
    out = model.transform(assembled(df, features, label, *keep))
    return out.select(*keep, "label", vector_to_array("probability").alias("proba"))


def binary_auc(model: Model, df: DataFrame, features: Sequence[str], label: str) -> float:
    scored = predict(model, df, features, label).select("label", F.col("proba")[1].alias("score"))
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)  # read twice; a lost block is predicted again
    try:
        return roc_auc(scored, F.col("label") == 1, "score").head()["auc"]
    finally:
        scored.unpersist()


def multiclass_auc(model: Model, df: DataFrame, features: Sequence[str], label: str, classes: int) -> float:
    scored = predict(model, df, features, label)
    wide = scored.select(F.col("label").cast("int").alias("y"), *[F.col("proba")[k].alias(f"p{k}") for k in range(classes)])
    wide = wide.persist(StorageLevel.MEMORY_AND_DISK)  # read several times; a lost block is predicted again
    try:
        return auc_one_vs_rest(wide, "y", {k: f"p{k}" for k in range(classes)}).where("name = 'macro'").head()["auc"]
    finally:
        wide.unpersist()


def one_vs_rest(rounds: int = 20, depth: int = 3, parallelism: int = 4) -> OneVsRest:
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, seed=0), parallelism=parallelism)


def eliminate(
    make: Callable[[], Estimator],
    train: DataFrame,
    val: DataFrame,
    features: Sequence[str],
    label: str,
    score: Callable[[Model, DataFrame, Sequence[str]], float],
    cut: float = 0.0,
    least: int = 1,
) -> list[tuple[int, str, float]]:
    """Importance cut, then drop the weakest feature one by one: (feature count, dropped feature, validation metric)."""
    current = top_features(fit(make(), train, features, label), features, cut=cut)
    steps, dropped = [], ""
    while True:
        model = fit(make(), train, current, label)
        steps.append((len(current), dropped, float(score(model, val, current))))
        if len(current) <= least:
            return steps
        ranked = importances(model, current)
        dropped = ranked[-1][0]
        current = [f for f in current if f != dropped]


def search(
    make: Callable[[Mapping[str, object]], Estimator],
    grid: Sequence[Mapping[str, object]],
    train: DataFrame,
    val: DataFrame,
    features: Sequence[str],
    label: str,
    score: Callable[[Model, DataFrame], float],
    gap: float = BINARY_GAP,
    parallelism: int = 4,
) -> list[tuple[int, str, float, float, float]]:
    """Trials (number, parameters, train metric, validation metric, objective); the objective of an overfit trial is 0.

    Trials run at the same time as separate Spark jobs on the same persisted rows.
    """
    train, val = (d.persist(StorageLevel.MEMORY_AND_DISK) for d in (train, val))

    def trial(item: tuple[int, Mapping[str, object]]):
        i, params = item
        model = fit(make(params), train, features, label)
        a, b = score(model, train), score(model, val)
        text = ", ".join(f"{k}={v}" for k, v in sorted(params.items()))
        return i, text, a, b, 0.0 if a - b > gap else b

    try:
        with ThreadPool(parallelism) as pool:
            return pool.map(trial, list(enumerate(grid)))
    finally:
        train.unpersist()
        val.unpersist()


def fold_frames(df: DataFrame, dates: Sequence, dt: str = "report_dt") -> Iterator[tuple[str, DataFrame, DataFrame]]:
    for name, a, b in month_folds(list(dates)):
        yield name, df.where(F.col(dt).isin(a)), df.where(F.col(dt).isin(b))


def fold_sizes(df: DataFrame, dates: Sequence, dt: str = "report_dt") -> DataFrame:
    """fold, train_n, valid_n for all folds in one pass."""
    folds = month_folds(list(dates))
    counts = df.agg(
        *[F.count(F.when(F.col(dt).isin(list(part)), 1)).alias(f"{side}{i}") for i, (_, a, b) in enumerate(folds) for side, part in (("t", a), ("v", b))]
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("fold"), F.col(f"t{i}").alias("train_n"), F.col(f"v{i}").alias("valid_n")) for i, (n, _, _) in enumerate(folds)]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


# --- batch scoring -------------------------------------------------------------------------------------------


def score_binary(model: Model, df: DataFrame, features: Sequence[str], report_dt: str, key: str = "epk") -> DataFrame:
    """key, score (float), report_dt. The model runs inside the JVM."""
    scored = predict(model, df.withColumn("__none", F.lit(0)), features, "__none", key)
    return scored.select(
        F.col(key).cast("bigint").alias(key), F.col("proba")[1].cast("float").alias("score"), F.lit(report_dt).alias("report_dt")
    )


def score_multiclass(
    model: Model, df: DataFrame, features: Sequence[str], classes: Sequence[int], report_dt: str, key: str = "epk"
) -> DataFrame:
    """key, cluster_<k>_score per class in the order given, report_dt."""
    scored = predict(model, df.withColumn("__none", F.lit(0)), features, "__none", key)
    return scored.select(
        F.col(key).cast("bigint").alias(key),
        *[F.col("proba")[i].cast("float").alias(f"cluster_{k}_score") for i, k in enumerate(classes)],
        F.lit(report_dt).alias("report_dt"),
    )


def score_with(
    df: DataFrame, features: Sequence[str], scorer: Callable[[pd.DataFrame], pd.Series], report_dt: str, key: str = "epk"
) -> DataFrame:
    """Score with any Python model over Arrow batches. ``scorer`` is shipped with the tasks and sees only its features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "score": scorer(b[list(features)]).astype("float64"), "report_dt": report_dt})

    return df.select(key, *features).mapInPandas(run, f"{key} bigint, score double, report_dt string")


def rows_to_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Metrics as a frame: one row per model or trial."""
    return spark.createDataFrame(list(rows), schema)


def linear_scorer(weights: Sequence[float], bias: float = 0.0) -> Callable[[pd.DataFrame], pd.Series]:
    w = list(weights)

    def scorer(x: pd.DataFrame) -> pd.Series:
        return pd.Series(x.to_numpy() @ w + bias)

    return scorer

