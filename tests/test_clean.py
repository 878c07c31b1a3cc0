import pytest
from pyspark.sql import functions as F

from stayscope.functions.expr import fixed_text, money_to_number, nearest_decimal, text_to_number
from stayscope.operators import clean as C


def values(df):
    return [row[0] for row in df.collect()]


def test_money_and_number_guards(spark):
    df = spark.createDataFrame([(t,) for t in ("$1,200", "£5", "abc", "", "1.0d", "1_000", None, " 7 ", "1e3", "NaN")], "c string")
    assert values(df.select(money_to_number(F.col("c")))) == [1200.0, 5.0, None, None, None, None, None, 7.0, 1000.0, None]
    assert values(df.select(text_to_number(F.col("c")))) == [None] * 7 + [7.0, 1000.0, None]


def test_label_texts(spark):
    texts = ["Yes", "yes ", "TRUE", "1", "1.0", "left", "churned", "y", "no", "0", None]
    df = C.standardise_label(spark.createDataFrame([(t,) for t in texts], "x string"), "x")
    assert values(df) == ["Yes"] * 7 + ["No"] * 4


def test_label_numbers(spark):
    df = C.standardise_label(spark.createDataFrame([(1.0,), (0.0,)], "Attrition double"), "Attrition")
    assert values(df) == ["Yes", "No"]


def test_nearest_decimal_equals_python(spark):
    xs = [i / 10000 for i in range(-3000, 3000, 7)] + [0.125, 0.375, 2.5, -0.5, 2.675, 1e6 + 0.0005]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    out = df.select("x", nearest_decimal(F.col("x"), 3).alias("r"), fixed_text(F.abs("x"), 3).alias("t")).collect()
    assert all(row.r == round(row.x, 3) and row.t == f"{abs(row.x):.3f}" for row in out)


def test_duplicates_keep_least_key(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1)], "row_id int, x string, y int")
    assert sorted(r["row_id"] for r in C.drop_duplicate_rows(df).collect()) == [1, 2]


def test_modes_prefer_frequent_then_least(spark):
    df = spark.createDataFrame([("b", "z"), ("a", "z"), ("b", "y"), ("a", None)], "u string, v string")
    assert C.modes(df, ["u", "v"]) == {"u": "a", "v": "z"}


def frame(spark):
    rows = [(i, "Yes" if i % 4 == 0 else "No", float(i) if i != 5 else None, None if i == 3 else i % 3, str(i % 9), f"t{i % 5}", "Q" if i % 2 else None)
            for i in range(40)]
    return spark.createDataFrame(
        rows, "EmpID int, Attrition string, Age double, JobLevel int, badge string, note string, Gender string"
    )


def test_fit_clean_steps(spark):
    params, out = C.fit_clean(frame(spark))
    assert params.row_id == "EmpID" and params.extras_kept == ["badge"] and params.extras_dropped == ["note"]
    rows = {r["row_id"]: r for r in out.collect()}
    ages = [float(i) for i in range(40) if i != 5]
    assert params.medians["Age"] == sorted(ages)[len(ages) // 2]
    assert rows[5]["Age"] == params.medians["Age"] and rows[0]["Age"] == params.clips["Age"][0]
    assert rows[3]["JobLevel"] == int(params.medians["JobLevel"]) and params.modes == {"Gender": "Q"}
    assert all(v is not None for r in rows.values() for v in r)


def test_apply_clean_reuses_parameters(spark):
    params, _ = C.fit_clean(frame(spark))
    one = frame(spark).where("EmpID = 39").drop("Attrition")
    row = C.apply_clean(one, params).first()
    assert row["Age"] == params.clips["Age"][1] and "note" not in row.asDict()


def test_all_null_number_becomes_zero(spark):
    df = spark.createDataFrame([(i, "Yes" if i % 2 else "No", None, i % 3) for i in range(12)],
                               "EmpID int, Attrition string, Age string, JobLevel int")
    assert "Age" in C.plan_clean(df).dropped  # constant: null counts as its only value
    params = C.CleanParams(C.HR, {}, {}, "EmpID", [], "Attrition")
    filled = C.impute(C.coerce_numbers(df.withColumnRenamed("EmpID", "row_id"), params), params)
    assert {r["Age"] for r in filled.collect()} == {0.0}


def test_clean_needs_a_label(spark):
    with pytest.raises(ValueError):
        C.clean(spark.createDataFrame([(i, f"v{i}") for i in range(12)], "a int, b string"))


def test_cleaning_is_independent_of_partitioning(raw):
    one = sorted(map(tuple, C.clean(raw).collect()))
    two = sorted(map(tuple, C.clean(raw.repartition(7, "free_text")).collect()))
    assert one == two


def test_cleaning_report(raw):
    params, cleaned = C.fit_clean(raw)
    rows = C.cleaning_report(raw, cleaned, params).collect()
    n = {r["step"]: r["n"] for r in rows}
    assert n["duplicate rows removed"] == raw.count() - cleaned.count() and n["missing after"] == 0


def test_ranged_quantiles_give_the_same_cleaning(raw):
    plain = C.fit_clean(raw)[0]
    ranged = C.fit_clean(raw, rows_per_range=10)[0]
    assert plain.medians == pytest.approx(ranged.medians) and plain.modes == ranged.modes
    for c, bounds in plain.clips.items():
        assert ranged.clips[c] == pytest.approx(bounds)


def test_gaps_that_first_appear_after_fitting(spark):
    from stayscope.functions.expr import means_left
    from stayscope.operators.clean import apply_clean, fit_clean

    rows = [(i, 20 + i, "Sales" if i % 3 else "Research", "Yes" if i % 2 else "No") for i in range(30)]
    whole = spark.createDataFrame(rows, "EmployeeID int, Age int, Department string, Attrition string")
    params, _ = fit_clean(whole, row_id="EmployeeID")
    gaps = spark.createDataFrame([(100, None, None, "Yes")], whole.schema)
    got = apply_clean(gaps, params).first()
    assert got["Age"] == 34.5 and got["Department"] == "Sales"
    padded = spark.createDataFrame([("\tYes",), (" no\n",), (None,)], "t string")
    assert [r[0] for r in padded.select(means_left(padded.t)).collect()] == [True, False, False]
