import pytest

from stayscope.operators import profile as P
from stayscope.schema import HR, SCORING_DEFAULTS, column_key, looks_like_identifier


@pytest.mark.parametrize(
    ("name", "key"),
    [(" Monthly-Income ", "monthly_income"), ("__Over Time?", "over_time"), ("AGE", "age"), ("a  b--c", "a_b_c"), ("%", "")],
)
def test_column_key(name, key):
    assert column_key(name) == key


def test_identifier_names():
    assert all(map(looks_like_identifier, ("EmployeeID", "Emp ID", "EmployeeNumber", "EmployeeCount", "Over18", "StandardHours")))
    # The pattern "emp ... id" also takes unrelated names.
    assert looks_like_identifier("temp_humidity")
    assert not any(map(looks_like_identifier, HR.known))


def test_spellings_complete():
    assert len(HR.canonical_by_key) == 75
    assert set(HR.canonical_by_key.values()) == set(HR.known)
    assert set(SCORING_DEFAULTS) <= set(HR.known) and len(HR.known) == 29


def test_spelling_map_keeps_first_and_existing():
    with pytest.warns(UserWarning):
        assert P.spelling_map(["dept", "division", "tenure"]) == {"dept": "Department", "tenure": "YearsAtCompany"}
    assert P.spelling_map(["Age", "employee_age"]) == {}


def test_find_label_by_name_and_by_value(spark):
    named = spark.createDataFrame([(1, "yes")], "x int, Left_Company string")
    assert P.find_label(named) == "Left_Company"
    by_value = spark.createDataFrame([("a", "YES", 3), ("b", "no", 4), ("c", None, 5)], "n string, f string, k int")
    with pytest.warns(UserWarning):
        assert P.find_label(by_value) == "f"
    none = spark.createDataFrame([("a", "up"), ("b", "down")], "n string, f string")
    assert P.find_label(none) is None


def test_label_fallback_may_take_overtime(spark):
    df = spark.createDataFrame([("u", "Yes"), ("v", "No"), ("w", "No")], "name string, OverTime string")
    with pytest.warns(UserWarning):
        assert P.find_label(df) == "OverTime"


def test_droppable_order_and_protection(spark):
    rows = [(i, "c", float(i) * 3, i % 2, 100 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "EmpID int, site string, MonthlyIncome double, left int, serial int")
    assert P.droppable_columns(df) == {"EmpID": "identifier", "site": "constant", "serial": "row index"}
    assert "MonthlyIncome" in P.droppable_columns(df, strict_reference=True)


def test_constant_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("a", None, None), ("a", 1, None)], "x string, y int, z int")
    marks = {c: p.is_constant for c, p in P.profile_table(df).items()}
    assert marks == {"x": True, "y": False, "z": True}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert P.profile_table(df)["x"].nulls == 2


def test_best_identifier(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "k int, v int")
    assert P.best_identifier(df) == "k"
    assert P.best_identifier(df.withColumnRenamed("v", "employee_number")) == "employee_number"
    assert P.best_identifier(df.select("v")) is None


def test_validation_issues(spark):
    few = spark.createDataFrame([(1, None)], "Attrition int, gap string")
    ok, issues = P.validate(few)
    assert not ok and len(issues) == 2 and "gap" in issues[1]
    assert len(P.validate(spark.createDataFrame([], "x int"))[1]) == 3


def test_summary_marks(raw):
    rows = {r["column"]: r for r in P.summarise(raw).collect()}
    assert rows["Salary"]["is_currency"] and rows["EmpID"]["is_id"] and rows["churned"]["is_label"]
    assert rows["Salary"]["missing_pct"] == pytest.approx(100 * rows["Salary"]["nulls"] / rows["Salary"]["rows"], abs=0.005)


def test_currency_share_is_strict(spark):
    df = spark.createDataFrame([("$1,200",)] * 3 + [("x",)] * 7, "c string")
    assert not P.profile_table(df)["c"].is_currency
    assert P.profile_table(spark.createDataFrame([("Doe, Jane",)] * 4 + [("x",)] * 6, "c string"))["c"].is_currency
