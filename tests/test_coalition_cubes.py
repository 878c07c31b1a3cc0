"""Scores of coalitions against plain computations, and that no points are exploded."""

import numpy as np
import pytest

from stayscope.operators import explain as X, models as ML
from test_training import NAMES, table


@pytest.fixture(scope="module")
def data(spark):
    return table(spark)


@pytest.mark.parametrize("name", [ML.LOGISTIC, ML.FOREST, ML.BOOSTED])
def test_coalitions_are_scored_in_the_task(data, name, monkeypatch):
    """Equal to the model's own scores of all mixed points, without transforming any of them."""
    x, _, df = data
    model = ML.fit_model(df, name, ML.Settings(forest_trees=9, forest_depth=6, boosted_rounds=9, boosted_depth=4))
    ground, plan = x[:3], X.shapley_shares(6)
    mixed = [(i, float(g), *map(float, m * x[i] + (1 - m) * ground[g])) for i in range(8) for m in plan.masks for g in range(3)]
    points = df.sparkSession.createDataFrame(mixed, "row_id long, g double, " + ", ".join(f"{c} double" for c in NAMES))
    scored = np.array([r.score for r in ML.score(model, points, NAMES).select("score").collect()]).reshape(8, len(plan.masks), 3).mean(axis=2)
    if name != ML.BOOSTED:
        monkeypatch.setattr(type(model), "transform", None)
    got = {r.row_id: r for r in X.kernel_attribution(df.where("row_id < 8"), model, NAMES, ground).collect()}
    for i in range(8):
        assert got[i].base_value == pytest.approx(scored[i, 0])
        assert np.allclose([c["shap"] for c in got[i].contributions], plan.shares.T @ scored[i], atol=1e-9)
