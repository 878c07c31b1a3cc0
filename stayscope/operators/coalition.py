"""Scores of coalitions of features, all of a row's at once.

In a coalition some features hold the row's value and the others a background point's. For a tree, a leaf is reached
by the coalitions that hold every feature of its path which only the row meets, and none which only the
background point meets. So a leaf pays into one cell of a cube with three states a feature (free, held, left out), and halving the
cube along each feature gives every coalition's score, without making and scoring the mixed points one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import SparkSession

from stayscope.operators.boosting import BoostedTrees
from stayscope.operators.treeshap import LeafGroup, tree_tables

#: Features up to which a row's cube is held: 3^11 cells.
CUBE_FEATURES = 11
CUBE_CELLS, LEAF_CELLS = 1 << 20, 1 << 16

Scores = Callable[[np.ndarray], np.ndarray]


def coalition_scores(model: Model | BoostedTrees, spark: SparkSession, masks: np.ndarray, ground: np.ndarray) -> Scores | None:
    """From rows (n x features) to P(class 1) per coalition (n x coalitions), the mean over the points of ``ground``.

    Given for the linear model, and for forests and boosted trees on few features; None for other models.
    """
    if isinstance(model, LogisticRegressionModel) and model.numClasses == 2:
        weights, intercept = model.coefficients.toArray(), float(model.intercept)

        def linear(x: np.ndarray) -> np.ndarray:
            margins = ((weights * (x - point)) @ masks.T + (intercept + weights @ point) for point in ground)
            return sum(1 / (1 + np.exp(-m)) for m in margins) / len(ground)

        return linear
    boosted = isinstance(model, BoostedTrees)
    if masks.shape[1] > CUBE_FEATURES or not (boosted or isinstance(model, RandomForestClassificationModel) and model.numClasses == 2):
        return None
    tables = tree_tables(model, spark)
    groups = _joined(tables.groups)
    at = (masks @ (1 << np.arange(masks.shape[1]))).astype(np.int64)

    def trees(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(masks)))
        step = max(1, CUBE_CELLS // 3 ** x.shape[1])
        for start in range(0, len(x), step):
            for point in ground:
                total = tables.constant + _paid(groups, x[start: start + step], point)[:, at]
                out[start: start + step] += 1 / (1 + np.exp(-total)) if boosted else total
        return out / len(ground)

    return trees


def _joined(groups: list[LeafGroup]) -> list[LeafGroup]:
    """The leaves of all trees by number of features on their path."""
    parts: dict[int, list[LeafGroup]] = {}
    for group in groups:
        parts.setdefault(group.features.shape[1], []).append(group)
    return [
        LeafGroup(*[np.concatenate([getattr(part, c) for part in same]) for c in ("features", "low", "high", "share", "value")])
        for same in parts.values()
    ]


def _paid(groups: list[LeafGroup], x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """What the leaves pay by row and coalition; bit f of a coalition's number says whether it holds feature f."""
    n, width = x.shape
    side, columns, start = 3 ** width, np.ascontiguousarray(x.T), np.arange(n) * 3 ** width
    cells, pays = [], []
    for group in groups:
        step = max(1, LEAF_CELLS // n)
        for first in range(0, len(group.value), step):
            some = slice(first, first + step)
            cell, alive = np.tile(start, (len(group.value[some]), 1)), True
            for used, low, high in zip(group.features[some].T, group.low[some].T, group.high[some].T):
                seen = columns[used]
                met = (seen > low[:, None]) & (seen <= high[:, None])
                other, held = (point[used] > low) & (point[used] <= high), 3 ** used
                cell += np.where(met, np.where(other, 0, held)[:, None], 2 * held[:, None])
                alive = alive & (met | other[:, None])
            cells.append(cell[alive])
            pays.append(np.broadcast_to(group.value[some, None], cell.shape)[alive])
    paid = np.bincount(np.concatenate(cells), np.concatenate(pays), n * side) if cells else np.zeros(n * side)
    cube = paid.reshape((n,) + (3,) * width)  # the last axis is feature 0
    for axis in range(1, width + 1):
        free, held, out = (cube.take(state, axis) for state in range(3))
        cube = np.stack([free + out, free + held], axis)
    return cube.reshape(n, -1)
