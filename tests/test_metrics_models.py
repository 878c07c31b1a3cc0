import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stayscope.operators import explain as X
from stayscope.operators import metrics as M
from stayscope.operators import models as ML
from stayscope.operators.scoring import Scorer, fill_defaults, gauge_band, out_of_bounds, risk_band
from stayscope.operators.split import stratified_split
from stayscope.plans.preparation import Preparation
from stayscope.session import materialise, scratch_path
from stayscope.sources.generator import generate_employees

SMALL = ML.Settings(logistic_iterations=100, forest_trees=6, forest_depth=4, boosted_rounds=5, boosted_depth=3, folds=3)


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1, 1, 0.9), (2, 1, 0.5), (3, 0, 0.5), (4, 0, 0.2), (5, 1, 0.2), (6, 0, 0.7), (7, 0, 0.1)]
    return spark.createDataFrame([(i, y, s, int(s >= 0.5)) for i, y, s in rows], "row_id long, label int, score double, prediction int")


def test_confusion_and_threshold_metrics(scored):
    cells = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(scored).collect()}
    assert cells == {(1, 1): 2, (1, 0): 1, (0, 1): 2, (0, 0): 2}
    row = M.threshold_metrics(scored).first()
    assert (row["accuracy"], row["precision"], row["recall"]) == pytest.approx((4 / 7, 0.5, 2 / 3))
    assert row["f1"] == pytest.approx(4 / 7)


def test_empty_denominators_and_absent_cells(spark):
    df = spark.createDataFrame([(0, 0.1, 0)], "label int, score double, prediction int")
    row = M.threshold_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    assert M.confusion_matrix(df).count() == 4 and M.roc_auc(df).first()["roc_auc"] is None


@pytest.mark.parametrize("rows_per_range", [10**9, 1])
def test_auc_counts_ties_half(scored, rows_per_range):
    pos, neg = [0.9, 0.5, 0.2], [0.5, 0.2, 0.7, 0.1]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert M.roc_auc(scored, rows_per_range=rows_per_range).first()["roc_auc"] == pytest.approx(want)


@pytest.mark.parametrize("rows_per_range", [10**9, 1])
def test_roc_curve_area_is_the_auc(scored, rows_per_range):
    points = sorted((r["fpr"], r["tpr"]) for r in M.roc_curve(scored, rows_per_range=rows_per_range).collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0) and len(points) == 6
    area = np.trapezoid([t for _, t in points], [f for f, _ in points])
    assert area == pytest.approx(M.roc_auc(scored).first()["roc_auc"])


def test_metrics_table_and_flags(spark):
    df = spark.createDataFrame([("b", 0.9, 0.5, 0.5, 0.5, 0.8), ("a", 0.7, 0.6, 0.5, 0.55, 0.8)],
                               "model string, accuracy double, precision double, recall double, f1 double, roc_auc double")
    table = M.metrics_table(df)
    assert [r["Model"] for r in table.collect()] == ["a", "b"] and len(table.columns) == 8
    flags = {(r["Model"], r["metric"]) for r in M.best_flags(table).where("is_best").collect()}
    assert ("b", "Accuracy") in flags and ("a", "Precision") in flags and {("a", "Recall"), ("b", "Recall")} <= flags
    assert M.radar_table(table).count() == 10 and M.best_model(table) == "a"


def test_bands(spark):
    df = spark.createDataFrame([(0.3,), (0.30001,), (0.6,), (0.61,)], "p double")
    got = [tuple(r) for r in df.select(risk_band(F.col("p")), gauge_band(F.col("p"))).collect()]
    assert got == [("LOW", "MEDIUM"), ("MEDIUM", "MEDIUM"), ("MEDIUM", "HIGH"), ("HIGH", "HIGH")]


def test_defaults_and_bounds(spark):
    df = spark.createDataFrame([(1, 99, None), (2, 30, "Maybe")], "row_id int, Age int, OverTime string")
    rows = out_of_bounds(fill_defaults(df)).orderBy("row_id").collect()
    assert rows[0]["invalid_fields"] == ["Age"] and rows[0]["OverTime"] == "No" and rows[0]["MonthlyRate"] == 14000
    assert rows[1]["invalid_fields"] == ["OverTime"]


@pytest.fixture(scope="module")
def world(spark):
    prep = Preparation()
    raw = materialise(generate_employees(spark, 700), "sample")
    features = materialise(prep.fit_transform(raw).features, "features")
    train, test = stratified_split(features)
    return prep, raw, features, train, test


@pytest.fixture(scope="module")
def trained(world):
    prep, _, _, train, test = world
    return ML.train_all(train, test, prep.feature_names, SMALL)


def test_feature_matrix_has_36_columns(world):
    assert len(world[0].feature_names) == 36


def test_all_models_train_and_are_better_than_chance(trained):
    rows = {r["Model"]: r for r in trained.metrics.collect()}
    assert set(rows) == {ML.LOGISTIC, ML.FOREST, ML.BOOSTED} and not trained.failures
    assert all(0.5 < r["ROC-AUC"] <= 1 and 0.5 < r["CV AUC (mean)"] <= 1 for r in rows.values())
    assert trained.best_name == max(rows, key=lambda n: rows[n]["ROC-AUC"]) and trained.best is not None
    assert trained.roc().where("model = 'Random Forest' and fpr = 0 and tpr = 0").count() >= 1


def test_a_failing_model_is_left_out(world, monkeypatch):
    prep, _, _, train, test = world
    real = ML.fit_model

    def breaks(df, name, settings=SMALL):
        if name == ML.FOREST:
            raise RuntimeError("no forest today")
        return real(df, name, settings)

    monkeypatch.setattr(ML, "fit_model", breaks)
    small = ML.Settings(**{**vars(SMALL), "names": (ML.FOREST, ML.LOGISTIC)})
    out = ML.train_all(train, test, prep.feature_names, small, use_smote=False)
    assert out.best_name == ML.LOGISTIC and ML.FOREST in out.failures
    only = ML.Settings(**{**vars(SMALL), "names": (ML.FOREST,)})
    with pytest.raises(RuntimeError, match="every model"):
        ML.train_all(train, test, prep.feature_names, only, use_smote=False)


def test_logistic_penalty(world, spark):
    """At the optimum, the summed weighted residuals equal the penalty's pull on every coefficient."""
    prep, _, _, train, _ = world
    table = materialise(ML.weighted(train, ML.LOGISTIC), "weighted")
    model = ML.fit_model(ML.assemble(train, prep.feature_names), ML.LOGISTIC, ML.Settings())
    p = ML.score(model, table, prep.feature_names).withColumn("res", F.col("weight") * (F.col("label") - F.col("score")))
    sums = p.agg(F.sum("res"), *[F.sum(F.col("res") * F.col(f)) for f in prep.feature_names]).first()
    assert sums[0] == pytest.approx(0, abs=0.5)
    assert np.allclose(list(sums[1:]), np.array(model.coefficients) / 0.1, atol=0.5)


def test_model_sizes():
    full = ML.Settings()
    forest = ML.estimator(ML.FOREST, 100.0, full)
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (200, 8, 5)
    boosted = ML.estimator(ML.BOOSTED, 100.0, full)
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize(), boosted.getSubsamplingRate()) == (300, 5, 0.05, 0.8)
    logistic = ML.estimator(ML.LOGISTIC, 100.0, full)
    assert logistic.getRegParam() == pytest.approx(0.1) and logistic.getMaxIter() == 1000


def test_save_and_load(trained, world, spark):
    prep, _, _, _, test = world
    folder = scratch_path(spark, "models")
    ML.save_models(trained.models, folder)
    for name, model in trained.models.items():
        loaded = ML.load_model(folder, name)
        a = {r["row_id"]: r["score"] for r in ML.score(model, test, prep.feature_names).collect()}
        b = {r["row_id"]: r["score"] for r in ML.score(loaded, test, prep.feature_names).collect()}
        assert a == pytest.approx(b)


def test_importance(trained, world, spark):
    prep = world[0]
    for model in trained.models.values():
        rows = ML.feature_importance(model, prep.feature_names, spark).collect()
        values = [r["importance"] for r in rows]
        assert len(rows) == 36 and values == sorted(values, reverse=True)
    top = ML.top_importance(ML.feature_importance(trained.best, prep.feature_names, spark)).collect()
    assert len(top) == 15 and top[0]["importance"] <= top[-1]["importance"]
    assert ML.feature_importance(object(), prep.feature_names, spark).count() == 0


def margins(model, df, features):
    out = model.transform(ML.assemble(df, features))
    raw = vector_to_array("rawPrediction")[1]
    p = vector_to_array("probability")[1]
    return {r["row_id"]: (r["raw"], r["p"]) for r in out.select("row_id", raw.alias("raw"), p.alias("p")).collect()}


@pytest.mark.parametrize("name", [ML.LOGISTIC, ML.FOREST, ML.BOOSTED])
def test_attributions_add_up(trained, world, name):
    prep, _, _, train, test = world
    model = trained.models[name]
    explained = X.attribution(test, model, prep.feature_names, train).collect()
    want = margins(model, test, prep.feature_names)
    for r in explained:
        total = r["base_value"] + sum(c["shap"] for c in r["contributions"])
        raw, p = want[r["row_id"]]
        assert total == pytest.approx({ML.LOGISTIC: raw, ML.FOREST: p, ML.BOOSTED: 2 * raw}[name], abs=1e-6)


def test_tree_attribution_equals_enumeration(trained, world, spark):
    """Against the definition: all orders of the features, absent ones averaged by training weight."""
    from itertools import combinations
    from math import factorial

    from stayscope.operators.treeshap import _node_rows

    prep, _, _, _, test = world
    model = ML.fit_model(
        ML.assemble(test, prep.feature_names[:4]), ML.FOREST, ML.Settings(forest_trees=3, forest_depth=4, forest_leaf_rows=1)
    )
    names = prep.feature_names[:4]
    rows = test.orderBy("row_id").limit(8)
    got = {r["row_id"]: [c["shap"] for c in r["contributions"]] for r in X.tree_attribution(rows, model, names).collect()}
    trees, _, _ = _node_rows(model, spark)

    def expected(nodes, at, x, known):
        node = nodes[at]
        if node["left"] < 0:
            return node["stats"][1] / node["cover"]
        if node["feature"] in known:
            return expected(nodes, node["left"] if x[node["feature"]] <= node["threshold"] else node["right"], x, known)
        sides = (node["left"], node["right"])
        return sum(nodes[s]["cover"] / node["cover"] * expected(nodes, s, x, known) for s in sides)

    for r in rows.collect():
        x = [r[n] for n in names]
        for i in range(4):
            others = [j for j in range(4) if j != i]
            phi = 0.0
            for size in range(4):
                for known in combinations(others, size):
                    w = factorial(size) * factorial(3 - size) / factorial(4)
                    phi += w * np.mean([expected(t, 0, x, {*known, i}) - expected(t, 0, x, set(known)) for t in trees.values()])
            assert got[r["row_id"]][i] == pytest.approx(phi, abs=1e-9)


def test_tree_blocks_do_not_change_attributions(trained, world, spark, monkeypatch):
    from stayscope.operators import treeshap

    prep, _, _, _, test = world
    tables = treeshap.tree_tables(trained.models[ML.BOOSTED], spark)
    x = np.array([[r[f] for f in prep.feature_names] for r in test.limit(20).collect()])
    whole = tables.attribute(x, 36)
    monkeypatch.setattr(treeshap, "BLOCK_CELLS", 1)
    assert np.allclose(tables.attribute(x, 36), whole)


def test_deep_leaves_are_exact():
    """Paths of 15 features: attributions add up, and equal the definition where few features matter."""
    from itertools import combinations
    from math import factorial

    from stayscope.operators.treeshap import LeafGroup

    draw = np.random.default_rng(4)
    for d in (1, 2, 5, 15):
        low, share = draw.normal(size=(3, d)), draw.uniform(0, 1, (3, d))
        group = LeafGroup(np.tile(np.arange(d), (3, 1)), low, np.full((3, d), np.inf), share, np.array([1.0, -2.0, 0.5]))
        x = draw.normal(size=(6, d))
        phi = np.zeros((6, d))
        group.add(x, phi)
        met = x[:, None, :] > low
        assert np.allclose(phi.sum(axis=1), ((met.prod(axis=2) - share.prod(axis=1)) * group.value).sum(axis=1))
        if d > 5:
            continue
        for row in range(6):
            for i in range(d):
                want = 0.0
                for size in range(d):
                    for known in combinations([j for j in range(d) if j != i], size):
                        rest = [j for j in range(d) if j != i and j not in known]
                        base = met[row][:, list(known)].prod(axis=1) * share[:, rest].prod(axis=1) * group.value
                        want += factorial(size) * factorial(d - 1 - size) / factorial(d) * (base * (met[row][:, i] - share[:, i])).sum()
                assert abs(phi[row, i] - want) < 1e-12


def test_sampled_attribution_is_exact_for_two_features(world, spark):
    prep, _, _, train, test = world
    used = prep.feature_names[:2]
    model = ML.fit_model(ML.assemble(train, used), ML.LOGISTIC, SMALL)
    means = X.feature_means(train, used)
    rows = test.limit(10)
    out = X.sampled_attribution(rows, model, used, means, orders=8).collect()
    want = margins(model, rows, used)
    for r in out:
        assert r["base_value"] + sum(c["shap"] for c in r["contributions"]) == pytest.approx(want[r["row_id"]][1])


def test_scorer_on_records(trained, world):
    prep, raw, features, _, _ = world
    scorer = Scorer(prep.encoding, trained.best, prep.medians)
    out = scorer(raw.withColumnRenamed("EmployeeID", "row_id"))
    assert out.count() == raw.count()
    assert out.where("score < 0 or score > 1 or risk not in ('LOW', 'MEDIUM', 'HIGH')").count() == 0


def test_scoring_streams(trained, world, spark):
    from stayscope.streaming.scoring import score_stream

    prep, raw, _, _, _ = world
    records = raw.withColumnRenamed("EmployeeID", "row_id")
    source = scratch_path(spark, "records")
    records.repartition(3).write.parquet(source)
    scorer = Scorer(prep.encoding, trained.models[ML.LOGISTIC], prep.medians)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink = scratch_path(spark, "scores")
    query = score_stream(stream, scorer, scratch_path(spark, "progress")).format("parquet").trigger(availableNow=True).start(sink)
    assert query.awaitTermination(120)
    got = {r["row_id"]: r["score"] for r in spark.read.parquet(sink).collect()}
    want = {r["row_id"]: r["score"] for r in scorer(records).collect()}
    assert got == pytest.approx(want)


def test_study_from_raw_table_to_report(spark):
    from stayscope.plans.lifecycle import predict_and_explain, run_study, write_study_report

    raw = materialise(generate_employees(spark, 400), "study")
    study = run_study(raw, ML.Settings(**{**vars(SMALL), "names": (ML.LOGISTIC, ML.FOREST)}))
    out = predict_and_explain(study, raw.withColumnRenamed("EmployeeID", "row_id")).collect()
    assert len(out) == 400 and all(r["explanation"].startswith("Attrition Assessment: ") for r in out)
    assert {r["risk"] for r in out} <= {"LOW", "MEDIUM", "HIGH"}
    paths = write_study_report(study, scratch_path(spark, "report"))
    assert len(paths) == 6 and spark.read.parquet(paths["Feature Importance"]).count() == 36
