import pytest
from pyspark.sql import functions as F

from stayscope.operators import explain as X
from stayscope.operators import report as R
from stayscope.operators.clean import clean
from stayscope.session import scratch_path
from stayscope.sources import tables as S
from stayscope.sources.generator import COLUMNS, employees_for, generate_employees


@pytest.fixture(scope="module")
def explained(spark):
    rows = [
        (1, "job_level", 2.0, 0.5), (1, "Age", 1.0, -0.2), (1, "OverTime", 0.0, 0.0), (1, "Stock", 3.0, 0.00004), (1, "Years", 3.0, 0.2),
        (2, "job_level", 2.0, -0.5), (2, "Age", 1.0, -0.2), (2, "OverTime", 1.0, -0.3), (2, "Stock", 0.0, -0.1), (2, "Years", 1.0, -0.1),
    ]
    shown = {name: X.display_name(name, {"Stock": "Stock Options"}) for _, name, _, _ in rows}
    packed = [
        (key, [(name, shown[name], value, shap) for owner, name, value, shap in sorted(rows) if owner == key]) for key in (1, 2)
    ]
    one = "struct<feature: string, display_name: string, value: double, shap: double>"
    return spark.createDataFrame(packed, f"row_id long, contributions array<{one}>")


def test_row_explanations(explained):
    rows = [r for r in X.explain_rows(explained).collect() if r["row_id"] == 1]
    assert [r["feature"] for r in rows] == ["job_level", "Age", "Years", "Stock", "OverTime"]
    assert [r["direction"] for r in rows] == ["↑ Risk", "↓ Risk", "↑ Risk", "↑ Risk", "↓ Risk"]
    assert rows[0]["display_name"] == "Job Level" and rows[3]["display_name"] == "Stock Options" and rows[3]["shap"] == 0.0


def test_display_name_like_title_case():
    assert X.display_name("MonthlyIncome") == "Monthlyincome" and X.display_name("over_time") == "Over Time"


def test_top_factors_need_a_visible_impact(explained):
    rows = X.top_factors(explained, 2).collect()
    one = [(r["type"], r["factor"], r["rank"]) for r in rows if r["row_id"] == 1]
    assert one == [("risk", "Job Level", 1), ("risk", "Years", 2), ("protective", "Age", 1)]
    assert sum(r["row_id"] == 2 for r in rows) == 2


def test_narratives(explained, spark):
    scores = spark.createDataFrame([(1, 0.75, 1), (2, 0.2, 0)], "row_id long, score double, prediction int")
    texts = {r["row_id"]: r["explanation"].split("\n") for r in X.narrative(explained.join(scores, "row_id")).collect()}
    assert texts[1][0] == "Attrition Assessment: HIGH RISK" and texts[1][1].startswith("This employee has a 75.0%")
    assert "• Job Level: contributing +0.500 to attrition risk" in texts[1] and "• Age: reducing attrition risk by 0.200" in texts[1]
    assert texts[2][3:6] == ["Primary Risk Drivers:", "", "Protective Factors:"]


def test_waterfall_and_global(explained):
    rows = [r["feature"] for r in X.waterfall(explained, 3).where("row_id = 2").collect()]
    assert rows == ["job_level", "OverTime", "Age"]
    first = X.global_importance(explained).first()
    assert (first["feature"], first["mean_abs_shap"]) == ("job_level", 0.5)


def test_linear_attribution_adds_up(people):
    weights = {"Age": 0.1, "JobLevel": -2.0}
    means = X.feature_means(people, list(weights))
    out = X.linear_attribution(people, weights, means, 0.5, "EmployeeID")
    margin = {r["EmployeeID"]: 0.5 + 0.1 * r["Age"] - 2.0 * r["JobLevel"] for r in people.collect()}
    for r in out.collect():
        assert r["base_value"] + sum(c["shap"] for c in r["contributions"]) == pytest.approx(margin[r["EmployeeID"]])


def test_background_is_bounded_and_repeatable(people):
    a = {r["EmployeeID"] for r in X.background(people, "EmployeeID", 30).collect()}
    assert len(a) == 30 and a == {r["EmployeeID"] for r in X.background(people.repartition(5), "EmployeeID", 30).collect()}


def test_summary_leaves_out_absent_columns(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("No",)], "Attrition string")
    rows = {r["metric"]: r["text"] for r in R.executive_summary(df, "2024-01-31 10:00").collect()}
    assert rows == {"Report Generated": "2024-01-31 10:00", "Total Employees": "3", "Attrition Count": "1",
                    "Attrition Rate (%)": "33.33", "Retained Employees": "2"}


def test_leavers_keep_the_key(raw):
    rows = R.leavers(clean(raw), key="row_id")
    assert rows.columns[0] == "row_id" and rows.where("Attrition <> 'Yes'").count() == 0


def test_riskiest_takes_fifty(people):
    scores = people.select("EmployeeID", (F.col("EmployeeID") % 100 / 100).alias("score"))
    rows = R.riskiest(people, scores).collect()
    assert len(rows) == 50 and [r["risk_pct"] for r in rows] == sorted((r["risk_pct"] for r in rows), reverse=True)


def test_lookup_falls_back_to_the_first_row(raw, spark):
    cleaned = clean(raw)
    ids = spark.createDataFrame([(41,), (42,), (-1,)], "id long")
    got = {r["asked_id"]: r for r in R.lookup(raw, cleaned, ids, "EmpID").collect()}
    assert got[42]["found"] and not got[-1]["found"] and not got[41]["found"]
    assert got[-1]["row_id"] == cleaned.agg(F.min("row_id")).first()[0]


def test_report_sheets_round_trip(people, spark):
    metrics = spark.createDataFrame([("m", 0.5)], "Model string, Accuracy double")
    importance = spark.createDataFrame([("Age", 0.5)], "feature string, importance double")
    paths = S.write_report(people, scratch_path(spark, "report"), metrics, importance)
    assert list(paths) == ["Executive Summary", "Department Analysis", "Job Role Analysis", "High Risk Employees",
                           "Model Performance", "Feature Importance"]
    back = spark.read.parquet(paths["Department Analysis"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, R.department_analysis(people).collect()))
    assert "Feature Importance" not in R.report_tables(people, metrics, importance.limit(0))


def test_csv_round_trip(people, spark):
    path = scratch_path(spark, "csv")
    S.write_csv(people, path)
    back = S.read_csv(spark, path, people.schema, row_id="n")
    assert sorted(map(tuple, back.drop("n").collect())) == sorted(map(tuple, people.collect()))
    assert back.select("n").distinct().count() == people.count()
    risk = scratch_path(spark, "risk")
    S.write_risk_list(people, risk, people.select("EmployeeID", F.lit(0.4).alias("score")))
    assert S.read_csv(spark, risk).count() == 50


def test_generator(spark):
    df = generate_employees(spark, 3000)
    assert df.columns == COLUMNS and df.count() == 3000
    a = sorted(map(tuple, df.where("EmployeeID < 1100").collect()))
    ids = spark.range(1001, 1100).withColumnRenamed("id", "key").repartition(5)
    assert a == sorted(map(tuple, employees_for(ids, "key").collect()))
    m = df.agg(
        F.avg("Age").alias("age"), F.min("Age").alias("lo"), F.max("Age").alias("hi"), F.avg("YearsAtCompany").alias("tenure"),
        F.avg((F.col("OverTime") == "Yes").cast("int")).alias("ot"), F.avg((F.col("Attrition") == "Yes").cast("int")).alias("left"),
        F.avg((F.col("Department") == "Sales").cast("int")).alias("sales"), F.max("MonthlyIncome").alias("income"),
        F.count_if(F.col("YearsInCurrentRole") > F.col("YearsAtCompany")).alias("bad"), F.avg("JobSatisfaction").alias("js"),
    ).first()
    assert abs(m["age"] - 37) < 1 and (m["lo"], m["hi"]) == (18, 60) and abs(m["tenure"] - 6.5) < 0.5
    assert abs(m["ot"] - 0.29) < 0.03 and abs(m["sales"] - 0.35) < 0.03 and abs(m["js"] - 2.94) < 0.1
    assert 0.2 < m["left"] < 0.5 and m["income"] <= 20000 and m["bad"] == 0


def test_present_keeps_the_wanted_order(people):
    assert R.present(people, ("OverTime", "Nope", "Age")) == ["OverTime", "Age"]


def test_kernel_comparison_joins_rows_without_a_broadcast(spark):
    """The size of 10 rows a person is not known to the planner before they are listed."""
    from stayscope.plans.queries import _compared_attributions

    def made(*shaps):
        rows = [(row, [(name, 1.5, shap) for name, shap in zip("ab", pair)]) for row, pair in zip((1, 2, None), shaps)]
        return spark.createDataFrame(rows, "row_id bigint, contributions array<struct<feature:string,value:double,shap:double>>")

    compared = _compared_attributions(made((0.1, 0.2), (0.3, 0.4), (0.5, 0.6)), made((0.1, 0.2), (0.3, 0.5), (0.5, 0.6)), ["a", "b"])
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, compared.collect())) == [(1, "a", 1.5, True), (1, "b", 1.5, True), (2, "a", 1.5, True), (2, "b", 1.5, False)]
