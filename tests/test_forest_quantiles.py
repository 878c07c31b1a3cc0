"""Neighbours by a projection forest, and quantiles of many columns from brackets, against plain numpy."""

import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayscope.functions.ranges import column_quantiles
from stayscope.operators import forest
from stayscope.operators.neighbours import _squared
from stayscope.operators.oversample import smote
from stayscope.plans.queries import QUERIES
from stayscope.session import materialise

DIMS = 28


def cloud(spark, n, seed=1, dims=DIMS):
    draw = np.random.default_rng(seed)
    vecs = np.unique(draw.integers(0, 30, (n, dims)), axis=0).astype(float)
    rows = [(i, v.tolist(), 1 + i % 3) for i, v in enumerate(vecs)]
    return vecs, materialise(spark.createDataFrame(rows, "row_id long, vec array<double>, weight long").repartition(4), "cloud")


def exact(vecs, k):
    d2 = ((vecs[:, None, :] - vecs[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    return np.sort(d2, axis=1)[:, :k], d2


def test_one_leaf_is_exact(spark):
    vecs, points = cloud(spark, 300)
    want, _ = exact(vecs, 5)
    for row in forest.forest_candidates(points, "row_id", 5).collect():
        assert [b["d2"] for b in row["best"]] == want[row["row_id"]].tolist()


@pytest.mark.parametrize("leaf_rows", [200, 400])
def test_recall_reaches_its_goal_over_all_points(spark, leaf_rows):
    vecs, points = cloud(spark, 1500)
    want, d2 = exact(vecs, 5)
    best = forest.forest_candidates(points, "row_id", 5, leaf_rows=leaf_rows, recall=0.93).collect()
    assert len(best) == len(vecs)
    hits = 0
    for row in best:
        found = {b["other"] for b in row["best"]}
        assert len(found) == 5 and row["row_id"] not in found
        assert [b["d2"] for b in row["best"]] == sorted(d2[row["row_id"], b["other"]] for b in row["best"])
        hits += sum(b["d2"] <= want[row["row_id"], -1] for b in row["best"])
    assert hits / (5 * len(vecs)) > 0.9  # the goal holds for the sampled probes


def test_leaves_are_bounded_and_whole(spark):
    """Every point is in one leaf of each tree, and nodes that need several rounds are cut further."""
    _, points = cloud(spark, 1200)
    placed = forest.leaves(points, "row_id", leaf_rows=10, trees=range(2, 4))
    assert placed.groupBy("tree").agg(F.countDistinct("row_id").alias("n"), F.count("*").alias("m")).collect() == [
        (r.tree, 1200, 1200) for r in placed.select("tree").distinct().collect()
    ]
    assert placed.groupBy("tree", "node").count().agg(F.max("count")).first()[0] <= 10 * forest.SPARE


def test_a_goal_out_of_reach_warns(spark):
    _, points = cloud(spark, 800)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        forest.forest_candidates(points, "row_id", 5, leaf_rows=20, recall=1.01, trees=1, most_trees=2)
    assert any("2 trees reach a recall of" in str(w.message) for w in said)


def test_copies_come_first(spark):
    rows = [(0, [0.0, 0.0], 3), (1, [1.0, 0.0], 2), (2, [5.0, 0.0], 1), (3, [9.0, 0.0], 1)]
    points = materialise(spark.createDataFrame(rows, "row_id long, vec array<double>, weight long"), "few")
    got = {r.row_id: [v[0] for v in r.neighbours] for r in forest.nearest_by_forest(points, "row_id", 4).collect()}
    assert got == {0: [0, 0, 1, 1], 1: [1, 0, 0, 0], 2: [1, 1, 9, 0], 3: [5, 1, 1, 0]}


def test_written_rows_grow_in_proportion(spark):
    """Candidates of a point do not depend on how many points there are."""
    sizes = []
    for n in (500, 2000):
        _, points = cloud(spark, n)
        placed = forest.leaves(points, "row_id", leaf_rows=100, trees=range(3))
        met = placed.groupBy("tree", "node").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
        sizes.append(met / n)
    assert sizes[1] < 1.5 * sizes[0]


def test_smote_in_many_dimensions(spark):
    draw = np.random.default_rng(4)
    names = [f"f{i}" for i in range(DIMS)]
    rows = [(i, float(i % 6 == 0), *map(float, draw.normal(i % 6 == 0, 1, DIMS))) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, label double, " + ", ".join(f"{c} double" for c in names))
    out = smote(df, names).toPandas()
    assert (out.label == 1).sum() == (out.label == 0).sum() == 500
    x = df.where("label = 1").toPandas()[names].to_numpy()
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, 1:6]
    ends = np.array([(i, j) for i in range(len(x)) for j in near[i]])
    for p in out[out.synthetic][names].to_numpy()[::17]:
        u, v = x[ends[:, 0]], x[ends[:, 1]]
        gaps = np.linalg.norm(p - u, axis=1) + np.linalg.norm(p - v, axis=1) - np.linalg.norm(u - v, axis=1)
        assert gaps.min() < 1e-9


# ---- quantiles


def numbers(spark, n=6000):
    draw = np.random.default_rng(9)
    columns = {
        "wide": draw.normal(0, 1e6, n), "ties": draw.integers(0, 5, n).astype(float), "hot": np.where(draw.random(n) < 0.4, 7.0, draw.random(n)),
        "gaps": np.where(draw.random(n) < 0.3, np.nan, draw.random(n)), "one": np.full(n, 3.5), "few": np.where(np.arange(n) < 3, np.arange(n), np.nan),
        "none": np.full(n, np.nan), "grid": np.arange(n).astype(float),
    }
    rows = list(zip(*[[None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(c)] for c in columns.values()]))
    return columns, materialise(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5), "numbers")


@pytest.mark.parametrize("accuracy, rows_per_range", [(10_000, 10**6), (50, 10**6), (20, 25), (400, 7)])
def test_column_quantiles_equal_numpy(spark, accuracy, rows_per_range):
    columns, df = numbers(spark)
    probs = [0.5, 0.01, 0.99, 0.25, 0.251, 0.0, 1.0]
    got = column_quantiles(df, list(columns), probs, rows_per_range, accuracy)
    for name, values in columns.items():
        values = values[~np.isnan(values)]
        assert got[name] == (pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12) if len(values) else None), name


def test_quantiles_read_the_table_twice(spark):
    """Whatever the number of columns; counted by the rows that pass."""
    _, df = numbers(spark, 500)
    for columns in (["wide"], ["wide", "ties", "hot", "gaps", "grid"]):
        seen = spark.sparkContext.accumulator(0)

        def count(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        column_quantiles(df.mapInArrow(count, df.schema), columns, [0.5, 0.9])
        assert seen.value == 2 * 500


def test_quantiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert column_quantiles(df, ["a", "b"], [0.5]) == {"a": None, "b": None}
    assert column_quantiles(df, [], [0.5]) == {}


def test_leaves_of_the_registered_recall_do_not_grow_with_the_table(spark, monkeypatch):
    """Leaves that are a share of the table make the work quadratic."""

    class Asked(Exception):
        pass

    def candidates(points, key, k, leaf_rows):
        raise Asked(leaf_rows)

    monkeypatch.setattr(forest, "LEAF_ROWS", 40)
    monkeypatch.setattr(forest, "forest_candidates", candidates)
    with pytest.raises(Asked) as found:
        QUERIES["m2_neighbour_recall"](spark, "/root/testdata/sf0.001")
    assert found.value.args == (40,)


@pytest.mark.parametrize("shape", ["ties", "far", "large", "few", "odd"])
def test_nearest_in_a_leaf_equals_all_distances(shape):
    """The matrix product rules out nothing that belongs to the nearest, whatever the size of the numbers."""
    rng = np.random.default_rng(3)
    vecs = {
        "ties": rng.integers(0, 3, (600, 4)).astype(float), "far": 1e8 + rng.normal(size=(500, 5)), "large": 1e160 * rng.normal(size=(40, 3)),
        "few": rng.normal(size=(4, 2)), "odd": np.where(rng.random((300, 3)) < 0.01, np.nan, rng.normal(size=(300, 3))),
    }[shape]
    keys = rng.permutation(len(vecs))
    got = forest._nearest_in_leaf(pd.DataFrame({"k": keys, "vec": list(vecs)}), "k", 5)
    with np.errstate(over="ignore"):
        d2 = _squared(vecs, vecs)[np.argsort(keys)][:, np.argsort(keys)]
    np.fill_diagonal(d2, np.inf)
    for at, (near, others) in enumerate(zip(got["d2"], got["others"])):
        finite = np.flatnonzero(np.isfinite(d2[at]))
        best = finite[np.argsort(d2[at][finite], kind="stable")][:5]
        if len(finite) >= 5 or len(vecs) <= 5:
            assert others.tolist() == best.tolist() and np.array_equal(near, d2[at][best])
