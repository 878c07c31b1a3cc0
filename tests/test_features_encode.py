import numpy as np
import pytest
from pyspark.sql import functions as F

from stayscope.operators import encode as E
from stayscope.operators import features as X
from stayscope.plans.preparation import Preparation


def test_income_to_level(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (2, 1, 30.0), (3, 2, -5.0), (4, 2, 5.0), (5, None, 7.0), (6, 3, None)],
                               "k int, JobLevel int, MonthlyIncome double")
    got = {r["k"]: r["IncomeToLevelRatio"] for r in X.income_to_level(df).collect()}
    assert got == {1: 0.5, 2: 1.5, 3: 1.0, 4: 1.0, 5: 1.0, 6: 1.0}
    alone = X.income_to_level(df.where("k = 1"), single_row_mode="self").first()
    assert alone["IncomeToLevelRatio"] == 1.0


def test_features_only_with_inputs(spark):
    df = spark.createDataFrame([(4, "Yes")], "YearsAtCompany int, OverTime string")
    assert X.engineer(df).columns == ["YearsAtCompany", "OverTime", "IsTenured"]


def test_row_features(spark):
    df = spark.createDataFrame(
        [(6, 3, "Yes", 2, 4, 1, 5, 9, 10)],
        "YearsAtCompany int, YearsSinceLastPromotion int, OverTime string, WorkLifeBalance int, JobSatisfaction int,"
        "EnvironmentSatisfaction int, NumCompaniesWorked int, TotalWorkingYears int, DistanceFromHome int",
    )
    row = X.row_features(df).first()
    assert (row["PromotionLag"], row["IsTenured"], row["BurnoutRisk"], row["OverallSatisfaction"]) == (3 / 7, 1, 3, 2.5)
    assert (row["CareerMobility"], row["LoyaltyIndex"], row["DistanceOvertimeRisk"]) == (0.5, 0.6, 20)


def test_codes_with_null_and_unseen(spark):
    fit = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    codes = E.fit_codes(fit, ["c"])
    assert {(r["value"], r["code"]) for r in codes.table.collect()} == {("a", 0), ("b", 1), ("nan", 2)}
    out = E.apply_codes(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), codes, ["c"])
    assert sorted(r["c"] for r in out.collect()) == [-1, 0, 2]
    joined = E.apply_codes(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), E.Codes(codes.table, {}), ["c"])
    assert sorted(r["c"] for r in joined.collect()) == [-1, 0, 2]
    other = E.apply_codes(spark.createDataFrame([("a",)], "d string"), codes, ["d"])
    assert other.first()["d"] == -1


def test_large_dictionary_is_numbered_the_same(spark):
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"), F.lit("x").alias("d"))
    small = {tuple(r) for r in E.fit_codes(df, ["c", "d"]).table.collect()}
    large = {tuple(r) for r in E.fit_codes(df, ["c", "d"], local_codes=100).table.collect()}
    assert small == large and len(small) == 3001


def test_scale_population_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    moments = E.fit_scale(df, ["x", "c"])
    assert moments == {"x": (2.0, 1.0), "c": (5.0, 1.0)}
    assert sorted(map(tuple, E.apply_scale(df, moments).collect())) == [(-1.0, 0.0), (1.0, 0.0)]


def test_align(spark):
    df = spark.createDataFrame([(1, 2, 3)], "row_id int, b int, extra int")
    assert E.align(df, ["a", "b"], ("row_id",)).first().asDict() == {"row_id": 1, "a": 0, "b": 2}


def test_not_fitted(spark):
    with pytest.raises(E.NotFittedError):
        E.apply_encoding(spark.range(1), None)
    with pytest.raises(E.NotFittedError):
        Preparation().transform(spark.range(1))


def test_prepared_features_are_standardised(raw):
    prep = Preparation()
    out = prep.fit_transform(raw).features
    table = np.array([[r[f] for f in prep.feature_names] for r in out.collect()])
    assert np.allclose(table.mean(axis=0), 0, atol=1e-9)
    spread = table.std(axis=0)
    assert np.all(np.isclose(spread, 1) | np.isclose(spread, 0))
    assert prep.identifier == "EmpID" and "label" in out.columns


def test_transform_of_the_same_table_agrees(raw):
    prep = Preparation()
    fitted = prep.fit_transform(raw)
    again = prep.transform(raw)
    one = {r["row_id"]: r for r in fitted.features.collect()}
    two = {r["row_id"]: r for r in again.features.collect()}
    assert one.keys() == two.keys()
    assert all(one[k][f] == pytest.approx(two[k][f]) for k in one for f in prep.feature_names)


def test_transform_of_one_record(raw):
    prep = Preparation()
    prep.fit_transform(raw)
    row = prep.transform(raw.orderBy("EmpID").limit(1)).features.first()
    assert set(prep.feature_names) <= set(row.asDict())


def test_fit_on_train_differs_only_in_parameters(raw):
    prep = Preparation(fit_on="train")
    out = prep.fit_transform(raw)
    assert out.features.count() == Preparation().fit_transform(raw).features.count()
    with pytest.raises(ValueError):
        Preparation(fit_on="test")


def test_invalid_table_is_refused(spark):
    with pytest.raises(ValueError, match="rows"):
        Preparation().fit_transform(spark.createDataFrame([("Yes", 1)], "Attrition string, Age int"))
