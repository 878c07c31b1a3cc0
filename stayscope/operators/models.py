"""Training, comparing and applying the three classifiers: Spark ML's linear model and forest, and boosted trees."""

from __future__ import annotations

import logging
import math
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from stayscope.operators.boosting import BoostedTrees, BoostedTreesClassifier, fit_together
from stayscope.operators.metrics import evaluate, metrics_table, roc_auc, roc_curve
from stayscope.operators.oversample import smote
from stayscope.operators.split import class_weights, stratified_folds
from stayscope.session import materialise, shared_dir

log = logging.getLogger(__name__)

LOGISTIC, FOREST, BOOSTED = "Logistic Regression", "Random Forest", "Gradient Boosted Trees"
SEED = 42


@dataclass(frozen=True)
class Settings:
    """Model sizes. The defaults are the full configuration; smaller ones suit smoke runs."""

    inverse_penalty: float = 0.1
    logistic_iterations: int = 1000
    logistic_tolerance: float = 1e-10
    forest_trees: int = 200
    forest_depth: int = 8
    forest_leaf_rows: int = 5
    boosted_rounds: int = 300
    boosted_depth: int = 5
    boosted_step: float = 0.05
    boosted_sample: float = 0.8
    boosted_columns: float = 0.8
    boosted_positive_weight: float = 3.0
    folds: int = 5
    #: Models and folds that train at the same time.
    parallel: int = 6
    names: tuple[str, ...] = (LOGISTIC, FOREST, BOOSTED)


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def estimator(name: str, total_weight: float, settings: Settings = Settings()):
    """The classifier for a name. Expects columns ``features``, ``label``, ``weight``."""
    shared = dict(featuresCol="features", labelCol="label", weightCol="weight")
    if name == LOGISTIC:
        # A penalty of 1/C on the summed loss is 1/(C * total weight) on Spark's mean loss.
        return LogisticRegression(
            regParam=1.0 / (settings.inverse_penalty * total_weight), elasticNetParam=0.0,
            standardization=False, maxIter=settings.logistic_iterations, tol=settings.logistic_tolerance, **shared,
        )
    if name == FOREST:
        return RandomForestClassifier(
            numTrees=settings.forest_trees, maxDepth=settings.forest_depth,
            minInstancesPerNode=settings.forest_leaf_rows, featureSubsetStrategy="sqrt", seed=SEED, **shared,
        )
    if name == BOOSTED:
        return BoostedTreesClassifier(
            settings.boosted_rounds, settings.boosted_depth, settings.boosted_step, settings.boosted_sample,
            settings.boosted_columns, seed=SEED,
        )
    raise KeyError(name)


def weighted(df: DataFrame, name: str, settings: Settings = Settings()) -> DataFrame:
    """Balanced weights, or the fixed positive weight of the boosted trees."""
    if name == BOOSTED:
        return df.withColumn(
            "weight", F.when(F.col("label") == 1, F.lit(settings.boosted_positive_weight)).otherwise(F.lit(1.0))
        )
    return class_weights(df)


def _ready(df: DataFrame, name: str, settings: Settings) -> tuple:
    """The estimator of an assembled table and its weighted rows."""
    ready = weighted(df, name, settings).select("features", "label", "weight")
    total = ready.agg(F.sum("weight")).first()[0]
    shared_dir(df.sparkSession)
    return estimator(name, total, settings), ready


def fit_model(df: DataFrame, name: str, settings: Settings = Settings()) -> Model | BoostedTrees:
    """Fit one classifier on an assembled table."""
    chosen, ready = _ready(df, name, settings)
    return chosen.fit(ready)


def score(model: Model, df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Add ``score`` = P(class 1) and ``prediction`` to every row of a table; map-only."""
    ready = df if "features" in df.columns else assemble(df, features or [])
    out = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("prediction", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "features")


def logistic_gradient(model: LogisticRegressionModel, df: DataFrame, settings: Settings = Settings()) -> float:
    """The length of the penalised mean loss's gradient at the model's parameters; 0 at the optimum.

    One pass over an assembled, weighted table (features, label, weight); sums per coefficient are combined in the tasks.
    """
    p = vector_to_array("probability")[1]
    residual = model.transform(df).select(
        "weight", (F.col("weight") * (p - F.col("label"))).alias("r"), vector_to_array("features").alias("x")
    )
    sums = residual.select("r", "weight", F.posexplode(F.concat(F.array(F.lit(1.0)), "x")).alias("at", "v")).groupBy("at").agg(
        F.sum(F.col("r") * F.col("v")).alias("slope"), F.sum("weight").alias("total")
    ).collect()
    total = sums[0]["total"]
    pull = [0.0, *(b / (settings.inverse_penalty * total) for b in model.coefficients)]  # the intercept is free
    return math.sqrt(sum((row["slope"] / total + pull[row["at"]]) ** 2 for row in sums))


def side_by_side(spark: SparkSession, work: dict[tuple[str, object], Callable[[], object]], parallel: int) -> tuple[dict, dict[str, Exception]]:
    """Run named pieces of work in driver threads, at most ``parallel`` at a time; their jobs share the cluster.

    Keys are (group, piece). Threads inherit the caller's job properties. When a piece fails, the other jobs of its
    group are cancelled by their tag, pieces of the group that have not begun are left out, and other groups go on. Returns
    the results by key and the first error by group.
    """
    context, run_id = spark.sparkContext, uuid.uuid4().hex
    results: dict[tuple[str, object], object] = {}
    errors: dict[str, Exception] = {}
    lock = threading.Lock()

    def run(key: tuple[str, object]) -> None:
        group, tag = key[0], f"{run_id}-{key[0].replace(',', ' ')}"
        with lock:
            if group in errors:
                return
        context.addJobTag(tag)
        try:
            results[key] = work[key]()
        except Exception as problem:  # reported by group
            with lock:
                first = errors.setdefault(group, problem) is problem
            if first:
                log.error("%s failed: %s", group, problem)
                context.cancelJobsWithTag(tag)
        finally:
            context.removeJobTag(tag)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for future in [pool.submit(inheritable_thread_target(spark)(run), key) for key in work]:
            future.result()
    return {key: value for key, value in results.items() if key[0] not in errors}, errors


def folded_table(df: DataFrame, settings: Settings = Settings(), key: str = "row_id") -> DataFrame:
    return materialise(stratified_folds(df, settings.folds, key=key, seed=SEED), "folded")


def score_fold(folded: DataFrame, fold: int, name: str, settings: Settings = Settings(), key: str = "row_id") -> DataFrame:
    """Written scores of one fold by a model that was fitted on the others."""
    return _fold_scores(fit_model(folded.where(F.col("fold") != fold), name, settings), folded, fold, name, key)


def _fold_scores(model: Model | BoostedTrees, folded: DataFrame, fold: int, name: str, key: str) -> DataFrame:
    scored = score(model, folded.where(F.col("fold") == fold)).select(F.lit(name).alias("model"), key, "fold", "label", "score")
    return materialise(scored, "fold-scores")


def score_folds_together(
    folded: DataFrame, settings: Settings = Settings(), key: str = "row_id", also: DataFrame | None = None
) -> dict[object, object]:
    """Written scores of every fold by boosted trees that share their passes; "model" is fitted on ``also``, if given, beside them."""
    rows: dict[object, DataFrame] = {fold: folded.where(F.col("fold") != fold) for fold in range(settings.folds)}
    if also is not None:
        rows["model"] = also
    fits = dict(zip(rows, fit_together([_ready(df, BOOSTED, settings) for df in rows.values()])))
    return {piece: model if piece == "model" else _fold_scores(model, folded, piece, BOOSTED, key) for piece, model in fits.items()}


def fold_aucs(scored: DataFrame) -> DataFrame:
    """(model, fold, roc_auc) of written fold scores."""
    return roc_auc(scored, ["model", "fold"])


def cross_validate(
    df: DataFrame, name: str, settings: Settings = Settings(), key: str = "row_id"
) -> tuple[float, float]:
    """Mean and population deviation of the AUC over stratified folds of an assembled table. Folds train side by side."""
    folded = folded_table(df, settings, key)
    if name == BOOSTED:
        scored = score_folds_together(folded, settings, key)
    else:
        work = {(name, fold): partial(score_fold, folded, fold, name, settings, key) for fold in range(settings.folds)}
        scored, errors = side_by_side(df.sparkSession, work, settings.parallel)
        if errors:
            raise errors[name]
    aucs = fold_aucs(materialise(reduce(DataFrame.unionByName, scored.values()), "folds"))
    row = aucs.agg(F.avg("roc_auc"), F.stddev_pop("roc_auc")).first()
    return row[0], row[1]


@dataclass
class Trained:
    """Fitted models with their results, best first in ``metrics``."""

    features: list[str]
    models: dict[str, Model]
    scored: DataFrame
    evaluated: DataFrame
    metrics: DataFrame
    fold_scores: DataFrame
    failures: dict[str, str] = field(default_factory=dict)
    best_name: str | None = None

    @property
    def best(self) -> Model:
        if self.best_name is None:
            raise RuntimeError("no model has been trained")
        return self.models[self.best_name]

    def roc(self) -> DataFrame:
        return roc_curve(self.scored, ["model"])


def train_all(
    train: DataFrame, test: DataFrame, features: list[str], settings: Settings = Settings(),
    use_smote: bool = True, key: str = "row_id",
) -> Trained:
    """Fit every classifier on the (balanced) training rows and compare them on the test rows.

    Models and folds train side by side, those of boosted trees in shared passes. Cross-validation uses the training rows as they are. A model that fails
    is logged and left out, its other jobs are cancelled; if all fail, one of the errors is raised.
    """
    plain = assemble(materialise(train.select(key, "label", *features), "train"), features)
    balanced = plain
    if use_smote:
        balanced = assemble(materialise(smote(plain.drop("features"), features, key=key, seed=SEED), "balanced"), features)
    held_out = assemble(test, features)
    folded = folded_table(plain, settings, key)
    work: dict[tuple[str, object], Callable[[], object]] = {}
    # the slowest first, so that the others fill the gaps
    for name in reversed(settings.names):
        if name == BOOSTED:
            work[name, "together"] = partial(score_folds_together, folded, settings, key, balanced)
            continue
        work[name, "model"] = partial(fit_model, balanced, name, settings)
        work |= {(name, fold): partial(score_fold, folded, fold, name, settings, key) for fold in range(settings.folds)}
    results, errors = side_by_side(train.sparkSession, work, settings.parallel)
    results |= {(BOOSTED, piece): made for piece, made in results.pop((BOOSTED, "together"), {}).items()}
    failures, error = {name: str(problem) for name, problem in errors.items()}, next(iter(errors.values()), None)
    models = {name: results[name, "model"] for name in settings.names if name not in errors}
    scored = [
        score(model, held_out).select(key, "label", "score", "prediction").withColumn("model", F.lit(name)) for name, model in models.items()
    ]
    if not models:
        raise RuntimeError("every model failed to train") from error
    all_scored = materialise(reduce(DataFrame.unionByName, scored), "scored")
    by_fold = materialise(reduce(DataFrame.unionByName, [results[name, fold] for name in models for fold in range(settings.folds)]), "folds")
    folds = materialise(
        fold_aucs(by_fold).groupBy("model").agg(F.avg("roc_auc").alias("cv_auc_mean"), F.stddev_pop("roc_auc").alias("cv_auc_std")), "fold-aucs"
    )
    evaluated = evaluate(all_scored, ["model"]).join(folds, "model")
    rows = evaluated.collect()
    evaluated = train.sparkSession.createDataFrame(rows, evaluated.schema)
    best = max(sorted(rows, key=lambda r: settings.names.index(r["model"])), key=lambda r: r["roc_auc"])
    return Trained(features, models, all_scored, evaluated, metrics_table(evaluated), by_fold, failures, best["model"])


def feature_importance(model: Model, features: list[str], spark: SparkSession) -> DataFrame:
    """Tree importances or absolute coefficients, greatest first; empty for other models."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        values = abs(model.coefficients.toArray())
    else:
        values = []
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def top_importance(importance: DataFrame, n: int = 15) -> DataFrame:
    """The n most important features, least important first (plot order)."""
    top = importance.orderBy(F.col("importance").desc(), "feature").limit(n)
    return top.orderBy(F.col("importance").asc(), F.col("feature").desc())


MODEL_CLASSES = {LOGISTIC: LogisticRegressionModel, FOREST: RandomForestClassificationModel}


def _model_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name.replace(' ', '_').lower()}"


def save_models(models: dict[str, Model | BoostedTrees], folder: str) -> None:
    for name, model in models.items():
        if isinstance(model, BoostedTrees):
            model.save(SparkSession.active(), _model_path(folder, name))
        else:
            model.write().overwrite().save(_model_path(folder, name))


def load_model(folder: str, name: str) -> Model | BoostedTrees:
    path = _model_path(folder, name)
    return BoostedTrees.load(SparkSession.active(), path) if name == BOOSTED else MODEL_CLASSES[name].load(path)
