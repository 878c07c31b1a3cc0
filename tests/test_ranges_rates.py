import numpy as np
import pytest
from pyspark.sql import functions as F

from stayscope.functions.hashing import digest, pick, uniform
from stayscope.functions.ranges import exact_quantiles, range_cuts, running_totals
from stayscope.operators import distribution as D
from stayscope.operators import rates as R


@pytest.fixture(scope="module")
def numbers(spark):
    """A third of the rows share one value; one group is tiny."""
    x = F.when(F.col("id") % 3 == 0, F.lit(50.0)).otherwise(uniform(digest("x", F.col("id"))) * 100)
    g = F.when(F.col("id") < 3, F.lit(None)).when(F.col("id") % 10 < 7, F.lit("big")).otherwise(F.lit("small"))
    return spark.range(4000).select("id", g.alias("g"), x.alias("x"))


@pytest.mark.parametrize("rows_per_range", [10**9, 300, 40])
def test_quantiles_match_numpy(numbers, rows_per_range):
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    local = numbers.toPandas()
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(numbers, "x", probs, ["g"], rows_per_range).collect()}
    for name in ("big", "small", None):
        part = local[local.g.isna()] if name is None else local[local.g == name]
        assert got[name] == pytest.approx(list(np.quantile(part.x, probs)))
    whole = exact_quantiles(numbers, "x", probs, (), rows_per_range).first()["quantiles"]
    assert whole == pytest.approx(list(np.quantile(local.x, probs)))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, "x", [0.5]).collect() in ([], [(None,)])


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals_by_range_equal_one_window(numbers, by):
    counted = numbers.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n")) if by else numbers.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    cuts = range_cuts(numbers, "x", 200)
    assert len(cuts) > 5
    plain = running_totals(counted, "x", {"before": "n"}, by)
    ranged = running_totals(counted, "x", {"before": "n"}, by, cuts)

    def key(row):
        return (str(row["g"]) if by else "", row["x"], row["before"])

    assert sorted(map(key, plain.collect())) == sorted(map(key, ranged.collect()))


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(500)
    draw = df.select("id", uniform(digest(1, F.col("id"))).alias("u"), pick(digest(1, F.col("id")), 7, 3).alias("p"))
    other = df.repartition(13).select("id", uniform(digest(1, F.col("id"))).alias("u"), pick(digest(1, F.col("id")), 7, 3).alias("p"))
    assert sorted(map(tuple, draw.collect())) == sorted(map(tuple, other.collect()))
    u = [r["u"] for r in draw.collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.05


def test_rate_with_missing_labels(spark):
    df = spark.createDataFrame([("a", "Yes"), ("a", None), ("a", "No"), ("b", None)], "k string, Attrition string")
    got = {r["k"]: (r["total"], r["positives"], r["rate_pct"]) for r in R.label_rate_by(df, ["k"]).collect()}
    assert got["a"][:2] == (2, 1) and got["b"] == (0, 0, 0.0)


def test_overtime_risk_without_regular_leavers(spark):
    df = spark.createDataFrame([("Yes", "Yes"), ("No", "No")], "OverTime string, Attrition string")
    assert R.overtime_risk(df).first().asDict() == {"overtime_rate": 100.0, "regular_rate": 0.0, "risk_ratio": None}


def test_kpi_with_absent_columns(spark):
    row = R.kpi_row(spark.createDataFrame([("Yes",), ("No",)], "Attrition string")).first()
    assert (row["employees"], row["rate_pct"], row["avg_income"], row["overtime_pct"]) == (2, 50.0, 0.0, 0.0)


def test_satisfaction_grid_has_null_for_absent(spark):
    df = spark.createDataFrame([("Yes", 1), ("No", 3)], "Attrition string, JobSatisfaction int")
    row = R.satisfaction_grid(df).first()
    assert (row["measure"], row["1"], row["2"], row["3"]) == ("JobSatisfaction", 100.0, None, 0.0)


def test_top_group_tie_goes_to_least_key(spark):
    df = spark.createDataFrame([("b", "Yes"), ("a", "Yes"), ("c", "No")], "Department string, Attrition string")
    assert R.top_group(df).first()["Department"] == "a" and R.overview(df).first()["top_department"] == "a"


def test_histogram_covers_all_rows(people):
    bins = D.histogram(people, "Age", ["Attrition"]).collect()
    assert sum(b["n"] for b in bins) == people.count() and {b["bin"] for b in bins} <= set(range(25))
    flat = D.histogram(people.withColumn("one", F.lit(3)), "one", [])
    assert flat.first()["n"] == people.count()


def test_boxes_match_numpy(people):
    local = people.toPandas()
    for row in D.box_stats(people, "MonthlyIncome", ["Attrition"], rows_per_range=20).collect():
        x = local[local.Attrition == row["Attrition"]].MonthlyIncome
        q1, med, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (row["q1"], row["median"], row["q3"]) == pytest.approx((q1, med, q3))
        assert (row["low_whisker"], row["high_whisker"], row["outliers"]) == (inside.min(), inside.max(), len(x) - len(inside))
