"""Boosting, relational scoring, convergence, coalitions and side-by-side training against plain computations."""

import itertools
import math
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayscope.operators import boosting, explain as X, models as ML, treewalk
from stayscope.operators.boosting import BoostedTrees, BoostedTreesClassifier
from stayscope.session import materialise, scratch_path

NAMES = [f"f{i}" for i in range(6)]


def table(spark, n=400, seed=3, parts=3):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 6)), 2)
    x[:, 5] = draw.integers(0, 3, n)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + draw.normal(size=n) * 0.4 > 0).astype(float)
    rows = [(i, float(y[i]), float(1.0 + 2.0 * y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, label double, weight double, " + ", ".join(f"{c} double" for c in NAMES))
    return x, y, materialise(ML.assemble(df.repartition(parts), NAMES), "training")


@pytest.fixture(scope="module")
def data(spark):
    return table(spark)


@pytest.fixture(scope="module")
def model(data):
    return BoostedTreesClassifier(rounds=25, depth=3, step=0.2).fit(data[2])


def p_of(model, x):
    return 1 / (1 + np.exp(-model.margins(x)))


def test_training_loss_falls(data, model):
    x, y, _ = data
    w = 1 + 2 * y
    losses = []
    for n in range(0, 26, 5):
        p = p_of(BoostedTrees(model.trees[:n], 6, 3), x)
        losses.append(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.6 * losses[0]


def test_a_tree_uses_only_its_columns(model):
    draws = {tuple(t.drawn) for t in model.trees}
    assert all(len(d) == 5 for d in draws) and len(draws) > 3
    for t in model.trees:
        assert {f for f, left in zip(t.feature, t.left) if left >= 0} <= set(t.drawn)


def test_first_tree_equals_brute_force(data):
    """All rows and columns: each node's split has the largest gain over all cuts, leaves the Newton step."""
    x, y, df = data
    model = BoostedTreesClassifier(rounds=1, depth=2, sample=1.1, columns=1.0, step=1.0).fit(df)
    tree, w = model.trees[0], 1 + 2 * y
    g, h = w * (0.5 - y), w * 0.25

    def worth(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + 1)

    def check(node, rows, depth):
        best = 0.0
        for f in range(6):
            for cut in np.unique(np.percentile(x[:, f], np.arange(100 / 64, 100, 100 / 64), method="inverted_cdf")):
                low, high = rows & (x[:, f] <= cut), rows & (x[:, f] > cut)
                if min(h[low].sum(), h[high].sum()) >= 1:
                    best = max(best, worth(low) + worth(high) - worth(rows))
        if tree.left[node] < 0:
            assert tree.value[node] == pytest.approx(-g[rows].sum() / (h[rows].sum() + 1))
            return
        assert depth < 2 and tree.gain[node] == pytest.approx(best, rel=0.02)
        low = x[:, tree.feature[node]] <= tree.threshold[node]
        assert tree.gain[node] == pytest.approx(worth(rows & low) + worth(rows & ~low) - worth(rows))
        check(tree.left[node], rows & low, depth + 1)
        check(tree.right[node], rows & ~low, depth + 1)

    check(0, np.ones(len(x), bool), 0)


def test_blocks_and_rebasing_do_not_change_the_model(spark, data, model, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 30)
    monkeypatch.setattr(boosting, "REBASE", 4)
    again = BoostedTreesClassifier(rounds=25, depth=3, step=0.2).fit(table(spark, parts=7)[2])
    assert np.allclose(again.margins(data[0]), model.margins(data[0]), atol=1e-9)


def test_transform_equals_margins(data, model):
    got = {r.row_id: r.score for r in ML.score(model, data[2], NAMES).collect()}
    assert np.allclose([got[i] for i in range(400)], p_of(model, data[0]))


def test_boosted_trees_survive_saving(spark, data, model):
    path = scratch_path(spark, "boosted")
    model.save(spark, path)
    loaded = BoostedTrees.load(spark, path)
    assert np.array_equal(loaded.margins(data[0]), model.margins(data[0])) and loaded.trees[3].drawn == model.trees[3].drawn


def test_tables_without_a_split(spark):
    one = spark.createDataFrame([(i, 1.0, 1.0, 2.0, 2.0) for i in range(30)], "row_id long, label double, weight double, a double, b double")
    model = BoostedTreesClassifier(rounds=3, depth=2).fit(ML.assemble(one, ["a", "b"]))
    assert all(len(t.value) == 1 for t in model.trees) and p_of(model, np.array([[2.0, 2.0]]))[0] > 0.5


@pytest.mark.parametrize("name", [ML.FOREST, ML.BOOSTED])
def test_walking_the_node_table_equals_the_model(data, name):
    df = data[2]
    model = ML.fit_model(df, name, ML.Settings(forest_trees=9, forest_depth=5, boosted_rounds=9, boosted_depth=4))
    got = ML.score(model, df, NAMES).join(treewalk.walked_scores(df, NAMES, model), "row_id").collect()
    assert len(got) == 400 and all(abs(r.score - r.walked) < 1e-12 for r in got)


def test_the_logistic_model_converges(data):
    df = data[2].drop("weight")
    model = ML.fit_model(df, ML.LOGISTIC)
    assert ML.logistic_gradient(model, ML.weighted(df, ML.LOGISTIC)) < 1e-6
    early = ML.fit_model(df, ML.LOGISTIC, ML.Settings(logistic_iterations=1))
    assert ML.logistic_gradient(early, ML.weighted(df, ML.LOGISTIC)) > 1e-4


# ---- coalitions


@pytest.mark.parametrize("d", [1, 2, 3, 6, 9])
def test_all_coalitions_give_shapley_values(d):
    draw = np.random.default_rng(d)
    value = draw.normal(size=2 ** d)
    full = X.shapley_shares(d)
    by_mask = {tuple(m): v for m, v in zip(full.masks, value)}
    plan = X.coalitions(d)
    got = plan.shares.T @ np.array([by_mask[tuple(m)] for m in plan.masks])
    want = np.zeros(d)
    for i in range(d):
        for size in range(d):
            for known in itertools.combinations([j for j in range(d) if j != i], size):
                mask = np.isin(np.arange(d), known).astype(float)
                more = mask.copy()
                more[i] = 1
                want[i] += math.factorial(size) * math.factorial(d - 1 - size) / math.factorial(d) * (by_mask[tuple(more)] - by_mask[tuple(mask)])
    assert np.allclose(got, want, atol=1e-9) and np.allclose(full.shares.T @ value, want, atol=1e-9)


def test_drawn_coalitions_add_up_and_are_exact_for_linear_scores():
    plan = X.coalitions(20, budget=400)
    assert len(plan.masks) < 500
    weights = np.random.default_rng(1).normal(size=20)
    assert np.allclose(plan.shares.T @ (plan.masks @ weights + 3), weights, atol=1e-8)
    scores = np.random.default_rng(2).normal(size=len(plan.masks))
    assert (plan.shares.T @ scores).sum() == pytest.approx(scores[-1] - scores[0])


def test_kernel_attribution_with_a_background(spark, data, model):
    x, _, df = data
    ground = x[:7]
    rows = df.where("row_id < 12")
    got = {r.row_id: r for r in X.kernel_attribution(rows, model, NAMES, ground).collect()}
    full = X.shapley_shares(6)
    for i in range(12):
        scores = [p_of(model, m * x[i] + (1 - m) * ground).mean() for m in full.masks]
        assert got[i].base_value == pytest.approx(scores[0])
        assert np.allclose([c["shap"] for c in got[i].contributions], full.shares.T @ np.array(scores), atol=1e-9)


# ---- side by side


def test_pieces_overlap_and_a_failing_group_goes_alone(spark):
    seen, lock, most = [0], threading.Lock(), [0]

    def piece(result, seconds=0.4, fail=False):
        def run():
            with lock:
                seen[0] += 1
                most[0] = max(most[0], seen[0])
            time.sleep(seconds)
            with lock:
                seen[0] -= 1
            if fail:
                raise ValueError("no")
            return spark.range(5).count() + result
        return run

    work = {("a", 1): piece(1), ("b", 1): piece(0, 0.05, True), ("a", 2): piece(2), ("a", 3): piece(3), ("b", 2): piece(9)}
    results, errors = ML.side_by_side(spark, work, 2)
    assert results == {("a", 1): 6, ("a", 2): 7, ("a", 3): 8} and list(errors) == ["b"] and most[0] == 2


def test_cancelling_stops_running_jobs_of_the_group(spark):
    def slow():
        def wait(batches):
            for batch in batches:
                time.sleep(30)
                yield batch
        return spark.range(1).mapInArrow(wait, "id long").count()

    def fails():
        time.sleep(3)
        raise ValueError("no")

    began = time.time()
    results, errors = ML.side_by_side(spark, {("a", 1): slow, ("a", 2): fails, ("b", 1): lambda: spark.range(7).count()}, 3)
    assert time.time() - began < 20 and results == {("b", 1): 7} and list(errors) == ["a"]


def test_histograms_of_many_partitions_stay_off_the_driver(spark, data, model, monkeypatch):
    """Each node's histogram is merged and searched in the executors: no sum of all partitions is fetched."""
    from pyspark import RDD

    def fetch(*_):
        raise AssertionError("histograms were sent to the driver")

    monkeypatch.setattr(boosting, "BLOCK_ROWS", 30)
    monkeypatch.setattr(RDD, "reduce", fetch)
    monkeypatch.setattr(RDD, "treeReduce", fetch)
    again = BoostedTreesClassifier(rounds=5, depth=3, step=0.2).fit(table(spark, parts=7)[2])
    assert np.allclose(again.margins(data[0]), BoostedTrees(model.trees[:5], 6, 3).margins(data[0]), atol=1e-9)


def test_a_walk_holds_the_model_once(data):
    """Each level is joined to its own nodes only: the joins' sides together are the node table."""
    df = data[2]
    model = ML.fit_model(df, ML.FOREST, ML.Settings(forest_trees=9, forest_depth=5))
    nodes = treewalk.node_table(model, df.sparkSession)
    walked = treewalk.walk(df, NAMES, nodes, 5)
    assert walked.count() == 400
    plan = walked._jdf.queryExecution().optimizedPlan().toString()
    sides = [line for line in plan.splitlines() if "level" in line and "Filter" in line]
    assert len(sides) == 6 and len({line[line.index("(level"):] for line in sides}) == 6
    levels = treewalk.with_levels(nodes)
    assert levels.count() == nodes.count() == sum(tree.numNodes for tree in model.trees)
    assert levels.agg(F.max("level")).first()[0] == max(tree.depth for tree in model.trees)


def test_a_table_of_one_block_grows_in_one_pass_and_to_the_same_trees(spark, monkeypatch):
    """Levels are not asked for one by one, and the trees are those of the passes over many blocks, beyond a rebasing too."""
    df = table(spark)[2]
    passes = []
    monkeypatch.setattr(boosting.BoostedTreesClassifier, "_cuts_of", lambda *_: passes.append(1))
    one = BoostedTreesClassifier(rounds=25, depth=3, step=0.2).fit(df)
    assert not passes
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    many = BoostedTreesClassifier(rounds=25, depth=3, step=0.2).fit(df)
    assert [(t.feature, t.threshold, t.left) for t in one.trees] == [(t.feature, t.threshold, t.left) for t in many.trees]
    assert np.allclose(np.concatenate([t.value for t in one.trees]), np.concatenate([t.value for t in many.trees]), atol=1e-12)


def test_a_table_of_several_packs_grows_in_its_task_up_to_a_size_in_bytes(spark, monkeypatch):
    """Packing does not decide how trees grow: a table that one task holds needs no passes, a wide one is spread over tasks."""
    df = table(spark)[2]
    one = BoostedTreesClassifier(rounds=25, depth=3, step=0.2).fit(df)
    passes, cuts_of = [], BoostedTreesClassifier._cuts_of
    monkeypatch.setattr(BoostedTreesClassifier, "_cuts_of", staticmethod(lambda *asked: passes.append(1) or cuts_of(*asked)))
    monkeypatch.setattr(boosting, "PACKED_ROWS", 100)
    several = BoostedTreesClassifier(rounds=25, depth=3, step=0.2).fit(df)
    assert not passes
    monkeypatch.setattr(boosting, "BLOCK_BYTES", 400 * (6 + 40) - 1)
    spread = BoostedTreesClassifier(rounds=25, depth=3, step=0.2).fit(df)
    assert passes
    for other in (several, spread):
        assert [(t.feature, t.threshold, t.left) for t in one.trees] == [(t.feature, t.threshold, t.left) for t in other.trees]
        assert np.allclose(np.concatenate([t.value for t in one.trees]), np.concatenate([t.value for t in other.trees]), atol=1e-12)


def test_places_of_chosen_rows_equal_a_walk_of_each_row(model):
    """The node of a row follows from its own columns, for all rows and for chosen ones, and leaves keep theirs."""
    bins = np.random.default_rng(5).integers(0, 64, (6, 500)).astype(np.uint8)
    rows = np.arange(3, 500, 7)
    for tree in model.trees[:5]:
        for levels in (0, 2, 3):
            expected = []
            for row in range(500):
                node = 0
                for _ in range(levels):
                    if tree.left[node] >= 0:
                        node = (tree.left if bins[tree.feature[node], row] <= tree.bin[node] else tree.right)[node]
                expected.append(node)
            assert tree.places(bins, tree.bin, levels).tolist() == expected
            assert tree.places(bins, tree.bin, levels, rows).tolist() == [expected[i] for i in rows]


def test_fits_that_grow_together_share_each_pass_and_equal_those_alone(spark, monkeypatch):
    """As many passes as the deepest fit needs, for tables of one block and of many, rounds that differ, and beyond a rebasing."""
    tables = [table(spark, n=n, seed=seed)[2] for n, seed in ((400, 7), (350, 2), (80, 3))]
    classifiers = [BoostedTreesClassifier(rounds=rounds, depth=depth, step=0.2) for rounds, depth in ((9, 3), (6, 2), (7, 3))]
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "REBASE", 4)
    alone = [classifier.fit(df) for classifier, df in zip(classifiers, tables)]
    passes, cuts_of = [], BoostedTreesClassifier._cuts_of
    monkeypatch.setattr(BoostedTreesClassifier, "_cuts_of", staticmethod(lambda *asked: passes.append(1) or cuts_of(*asked)))
    together = boosting.fit_together(list(zip(classifiers, tables)))
    assert len(passes) == 9 * 3 and [len(model.trees) for model in together] == [9, 6, 7]
    for one, other in zip(alone, together):
        assert [(t.feature, t.threshold, t.left) for t in one.trees] == [(t.feature, t.threshold, t.left) for t in other.trees]
        assert np.allclose(np.concatenate([t.value for t in one.trees]), np.concatenate([t.value for t in other.trees]), atol=1e-12)


def test_the_folds_of_boosted_trees_are_fitted_together(data, monkeypatch):
    """The comparison's boosted fits are one call, so that they share their passes; the fold's scores are those of a fit alone."""
    calls, real = [], ML.fit_together
    monkeypatch.setattr(ML, "fit_together", lambda work: calls.append(len(work)) or real(work))
    settings = ML.Settings(names=(ML.BOOSTED,), boosted_rounds=5, boosted_depth=2, folds=3)
    df = data[2].drop("weight", "features")
    trained = ML.train_all(df, df, NAMES, settings, use_smote=False)
    assert calls == [4] and trained.fold_scores.count() == 400 and not trained.failures
    folded = ML.folded_table(ML.assemble(df, NAMES), settings)
    alone = {r.row_id: r.score for r in ML.score_fold(folded, 1, ML.BOOSTED, settings).collect()}
    got = {r.row_id: r.score for r in trained.fold_scores.where("fold = 1").collect()}
    assert alone.keys() == got.keys() and all(abs(got[i] - alone[i]) < 1e-12 for i in alone)


def test_scores_are_compared_without_a_broadcast(spark, tmp_path):
    """Tables that the optimiser takes for small are not sent through the driver."""
    from stayscope.plans.queries import same_scores

    rows = [(i, i / 7) for i in range(50)] + [(3, 3 / 7), (None, 0.5)]
    spark.createDataFrame(rows, "row_id bigint, before double").write.parquet(f"{tmp_path}/before")
    spark.createDataFrame([(i, x + (i == 9)) for i, x in rows[:-1]], "row_id bigint, after double").write.parquet(f"{tmp_path}/after")
    same = same_scores(spark.read.parquet(f"{tmp_path}/before"), spark.read.parquet(f"{tmp_path}/after"))
    found = same.collect()
    assert "Broadcast" not in same._jdf.queryExecution().executedPlan().toString()
    assert len(found) == 53 and [r.row_id for r in found if not r.same] == [9]
