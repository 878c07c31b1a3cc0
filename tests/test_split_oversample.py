import numpy as np
import pytest
from pyspark.sql import functions as F

from stayscope.operators.neighbours import nearest
from stayscope.operators.oversample import smote
from stayscope.operators.split import class_weights, hash_cuts, stratified_folds, stratified_split


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(1003).select(F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("double").alias("label"))


def test_split_sizes_are_exact(labelled):
    train, test = stratified_split(labelled)
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    for label, n in counts.items():
        assert train.where(F.col("label") == label).count() == int(0.8 * n + 0.5)
    assert train.count() + test.count() == 1003 and train.join(test, "row_id").count() == 0


def test_split_is_repeatable(labelled):
    a = {r["row_id"] for r in stratified_split(labelled)[1].collect()}
    b = {r["row_id"] for r in stratified_split(labelled.repartition(11))[1].collect()}
    c = {r["row_id"] for r in stratified_split(labelled, seed=7)[1].collect()}
    assert a == b and a != c


def test_split_edges(labelled):
    whole = hash_cuts(labelled, "row_id", 1, "label", shares=[1.0]).part()
    assert labelled.where(whole == 0).count() == 1003
    none = hash_cuts(labelled, "row_id", 1, "label", shares=[0.0]).part()
    assert labelled.where(none == 1).count() == 1003
    some = hash_cuts(labelled, "row_id", 1, counts=[17]).part()
    assert labelled.where(some == 0).count() == 17


def test_split_with_null_and_text_labels(spark):
    df = spark.range(200).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("row_id"),
        F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.lit("x")).alias("label"),
    )
    train, test = stratified_split(df)
    assert train.where("label is null").count() == 40 and test.where("label = 'x'").count() == 30


def test_folds_are_even(labelled):
    sizes = stratified_folds(labelled).groupBy("label", "fold").count().collect()
    for label in (0.0, 1.0):
        n = [r["count"] for r in sizes if r["label"] == label]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_weights_balance(labelled):
    totals = class_weights(labelled).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert totals[0]["w"] == pytest.approx(totals[1]["w"])


def points(spark, n, dims, seed, copies=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.integers(0, 12, dims)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(copies - 1)]
    return spark.createDataFrame(rows, "row_id long, vec array<double>"), rows


def brute(rows, k):
    """The k nearest squared distances of every row, copies included, itself not."""
    x = np.array([v for _, v in rows])
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    return {rows[i][0]: sorted(d2[i])[:k] for i in range(len(rows))}


@pytest.mark.parametrize(("n", "dims", "copies", "block_rows"), [(60, 3, 1, 4096), (400, 4, 30, 40), (300, 2, 200, 25)])
def test_nearest_equals_brute_force(spark, n, dims, copies, block_rows):
    df, rows = points(spark, n, dims, 5, copies)
    distinct = df.groupBy("vec").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("weight"))
    want = brute(rows, 5)
    got = nearest(distinct, "row_id", 5, block_rows).collect()
    for r in got:
        own = np.array(r["vec"])
        d2 = sorted(((np.array(v) - own) ** 2).sum() for v in r["neighbours"])
        assert d2 == pytest.approx(want[r["row_id"]])
    assert len(got) == distinct.count()


def imbalanced(spark, minority, majority, same=0):
    rng = np.random.default_rng(3)
    rows = [(i, 1.0, *map(float, rng.normal(0, 1, 3))) for i in range(minority)]
    rows += [(minority + i, 1.0, 9.0, 9.0, 9.0) for i in range(same)]
    rows += [(10_000 + i, 0.0, *map(float, rng.normal(3, 1, 3))) for i in range(majority)]
    return spark.createDataFrame(rows, "row_id long, label double, a double, b double, c double")


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_smote_balances_between_neighbours(spark, block_rows):
    df = imbalanced(spark, 50, 180)
    out = smote(df, ["a", "b", "c"], block_rows=block_rows).toPandas()
    assert (out.label == 1).sum() == (out.label == 0).sum() == 180
    x = df.where("label = 1").toPandas()[["a", "b", "c"]].to_numpy()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    for p in out[out.synthetic][["a", "b", "c"]].to_numpy():
        ends = [(x[i], x[j]) for i in range(len(x)) for j in near[i]]
        # On the segment: the two part distances add up to its length.
        gaps = [np.linalg.norm(p - u) + np.linalg.norm(p - v) - np.linalg.norm(u - v) for u, v in ends]
        assert min(gaps) < 1e-9


def test_smote_with_a_hot_point(spark):
    df = imbalanced(spark, 12, 400, same=30)
    out = smote(df, ["a", "b", "c"], block_rows=8)
    assert out.where("label = 1").count() == 400
    from stayscope.operators.oversample import synthetic_rows
    portioned = synthetic_rows(df, ["a", "b", "c"], 1.0, 358, copies_per_row=10)
    whole = synthetic_rows(df, ["a", "b", "c"], 1.0, 358)
    assert sorted(map(tuple, portioned.collect())) == sorted(map(tuple, whole.collect()))


def test_smote_errors_and_balanced_input(spark):
    with pytest.raises(ValueError):
        smote(imbalanced(spark, 5, 20), ["a", "b", "c"])
    with pytest.raises(ValueError):
        smote(imbalanced(spark, 5, 0), ["a", "b", "c"])
    assert smote(imbalanced(spark, 20, 20), ["a", "b", "c"]).count() == 40


def test_smote_six_and_twenty(spark):
    assert smote(imbalanced(spark, 6, 20), ["a", "b", "c"]).where("label = 1").count() == 20
