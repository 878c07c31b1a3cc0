"""Classifier quality from a scored table: any ``by`` columns, ``label``, ``score``, ``prediction``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stayscope.functions.expr import nearest_decimal
from stayscope.functions.ranges import SINGLE_RANGE_ROWS, null_safe_join, range_cuts, running_totals
from stayscope.session import lookup_table

QUALITY = ("Accuracy", "Precision", "Recall", "F1-Score", "ROC-AUC")


def _cells(actual: int, predicted: int):
    return F.count_if((F.col("label") == actual) & (F.col("prediction") == predicted))


def confusion_matrix(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All four cells per group, absent ones as 0: ``by``, ``actual``, ``predicted``, ``n``."""
    wide = scored.groupBy(*by).agg(
        *[_cells(a, p).alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)]
    )
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("n"))
        for a in (0, 1) for p in (0, 1)
    ]
    return wide.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")


def threshold_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class, 0 on an empty denominator."""
    counts = scored.groupBy(*by).agg(
        _cells(1, 1).alias("tp"), _cells(0, 1).alias("fp"), _cells(1, 0).alias("fn"), _cells(0, 0).alias("tn")
    )

    def share(top, bottom):
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by,
        share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _by_score(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = (), rows_per_range: int = SINGLE_RANGE_ROWS) -> DataFrame:
    """Exact area under the curve with ties counted half: ``by``, ``roc_auc``.

    Rows are combined per score; negatives below each score come from ranged running totals.
    """
    by = list(by)
    below = running_totals(
        _by_score(scored, by), "score", {"neg_below": "neg"}, by, range_cuts(scored, "score", rows_per_range)
    )
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_below").cast("double") + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return below.groupBy(*by).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def roc_curve(scored: DataFrame, by: Sequence[str] = (), rows_per_range: int = SINGLE_RANGE_ROWS) -> DataFrame:
    """``by``, ``threshold``, ``fpr``, ``tpr``: one point per distinct score and the (0, 0) start."""
    by = list(by)
    points = _by_score(scored, by).withColumn("_down", -F.col("score"))
    cuts = sorted(-c for c in range_cuts(scored, "score", rows_per_range))
    above = running_totals(points, "_down", {"pos_above": "pos", "neg_above": "neg"}, by, cuts)
    totals = scored.groupBy(*by).agg(
        F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n")
    )
    if by:
        joined = null_safe_join(above, lookup_table(totals), by)
    else:
        p, n = totals.first()
        joined = above.withColumns({"_p": F.lit(p), "_n": F.lit(n)})
    curve = joined.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide((F.col("neg_above") + F.col("neg")).cast("double"), F.col("_n").cast("double")).alias("fpr"),
        F.try_divide((F.col("pos_above") + F.col("pos")).cast("double"), F.col("_p").cast("double")).alias("tpr"),
    )
    start = totals.select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(curve)


def evaluate(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Threshold metrics and exact AUC per group."""
    return null_safe_join(threshold_metrics(scored, by), roc_auc(scored, by), list(by))


def metrics_table(evaluated: DataFrame) -> DataFrame:
    """The comparison table: 4 decimals, best AUC first."""
    have = set(evaluated.columns)

    def shown(name: str):
        return nearest_decimal(F.col(name) if name in have else F.lit(0.0), 4)

    return evaluated.select(
        F.col("model").alias("Model"),
        shown("accuracy").alias("Accuracy"),
        shown("precision").alias("Precision"),
        shown("recall").alias("Recall"),
        shown("f1").alias("F1-Score"),
        shown("roc_auc").alias("ROC-AUC"),
        shown("cv_auc_mean").alias("CV AUC (mean)"),
        shown("cv_auc_std").alias("CV AUC (std)"),
    ).orderBy(F.col("ROC-AUC").desc(), "Model")


def radar_table(metrics: DataFrame, names: Sequence[str] = QUALITY) -> DataFrame:
    """One row per (model, metric)."""
    return metrics.unpivot(["Model"], list(names), "metric", "value")


def best_flags(metrics: DataFrame, names: Sequence[str] = QUALITY) -> DataFrame:
    """Radar rows with ``is_best`` set on the greatest value of each metric."""
    long = radar_table(metrics, names)
    best = long.groupBy("metric").agg(F.max("value").alias("best"))
    return long.join(best, "metric").select(
        "Model", "metric", "value", (F.col("value") == F.col("best")).alias("is_best")
    )


def best_model(metrics: DataFrame) -> str | None:
    row = metrics.orderBy(F.col("ROC-AUC").desc(), "Model").first()
    return row["Model"] if row else None
