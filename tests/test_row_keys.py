import warnings

import pytest
from pyspark.sql import functions as F

from stayscope.operators import clean as C
from stayscope.operators import models as M
from stayscope.operators.profile import best_identifier, plain_names
from stayscope.operators.split import stratified_split
from stayscope.plans.lifecycle import predict_and_explain, run_study
from stayscope.plans.preparation import Preparation

QUICK = M.Settings(logistic_iterations=10, folds=2, names=(M.LOGISTIC,))


@pytest.fixture(autouse=True)
def quiet():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def variants(raw):
    return {
        "no id": raw.drop("EmpID"),
        "id repeats": raw.withColumn("temp_humidity", F.col("EmpID") % 3).drop("EmpID"),
        "dotted names": raw.withColumnsRenamed({"EmpID": "Emp.ID", "badge_score": "badge.score", "free_text": "free`text"}),
    }


@pytest.mark.parametrize("name", ["no id", "id repeats", "dotted names"])
def test_studies_on_any_key(raw, name):
    study = run_study(variants(raw)[name], QUICK)
    n = study.prepared.features.count()
    assert n == C.clean(raw).count()
    assert study.prepared.features.select("row_id").distinct().count() == n
    assert study.train.count() == pytest.approx(0.8 * n, abs=2)
    out = predict_and_explain(study, study.prepared.cleaned)
    assert out.count() == n and {"score", "risk", "explanation"} <= set(out.columns)


def test_explained_rows_that_share_a_key_stay_apart(raw):
    study = run_study(raw, QUICK)
    records = study.prepared.cleaned.withColumn("row_id", F.lit(7))
    assert predict_and_explain(study, records).count() == records.count()


def test_fit_on_the_training_part_without_an_id(raw):
    plain = Preparation(fit_on="train").fit_transform(raw.drop("EmpID"))
    assert plain.features.count() == C.clean(raw).count()


def test_digest_keys(spark):
    schema = "a string, b string, x double"
    rows = [("1", None, 0.0), (None, "1", 0.0), ("1", "", 0.0), ("1", "null", 0.0), ("1", None, -0.0)]
    df = spark.createDataFrame(rows, schema)
    keys = [r[0] for r in df.select(C.row_digest(df)).collect()]
    assert len(set(keys)) == 4 and keys[0] == keys[4]
    again = df.repartition(3).select("*", C.row_digest(df).alias("key")).select("key")
    assert sorted(r[0] for r in again.collect()) == sorted(keys)


def test_keys_of_repeated_rows(spark):
    whole = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "row_id int, x string")
    assert C.is_row_key(whole)
    assert not C.is_row_key(spark.createDataFrame([(1, "a"), (1, "b")], "row_id int, x string"))
    assert not C.is_row_key(spark.createDataFrame([(None, "a"), (1, "b")], "row_id int, x string"))
    assert C.is_row_key(whole.limit(0))


def test_plain_names(spark):
    assert plain_names(["a.b", "a_b", "A`B", "c"]) == {"a.b": "a_b_2", "A`B": "A_B_3"}
    df = spark.createDataFrame([(1.0, "x"), (2.0, "x")], "`p.q` double, y string")
    assert best_identifier(df) == "p.q"


def test_named_key_that_repeats(raw):
    table = raw.withColumn("site", F.col("EmpID") % 4)
    params, out = C.fit_clean(table, row_id="site")
    assert params.row_id is None and params.dropped["site"] == "identifier"
    train, test = stratified_split(out.select("row_id", "Attrition"), "Attrition")
    assert train.count() + test.count() == out.count() and test.count() > 0
