"""Personnel views over the order tables, clean and dirty, and a deterministic scored view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayscope.functions.hashing import digest, uniform
from stayscope.operators.rates import positive
from stayscope.sources.tables import read_table


def _int(column: Column) -> Column:
    return column.cast("int")


def profile(spark: SparkSession, folder: str) -> DataFrame:
    """One person per customer, with attributes from the customer's orders (19 of 30 columns)."""
    year = F.year("o_orderdate")
    per_customer = read_table(spark, folder, "orders").groupBy("o_custkey").agg(
        _int(F.count(F.lit(1))).alias("n_orders"),
        _int(F.max(year) - F.min(year)).alias("span_y"),
        _int(F.lit(2001) - F.max(year)).alias("since_y"),
        _int(F.count_if(F.col("o_orderpriority") == "1-URGENT")).alias("n_urgent"),
        _int(F.count_if(F.col("o_orderstatus") == "F")).alias("n_f"),
        _int(F.count_if(F.col("o_orderstatus") == "O")).alias("n_o"),
    )
    people = (
        read_table(spark, folder, "customer")
        .join(read_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    )
    k = F.col("c_custkey")

    def got(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    travel = (
        F.when(k % 10 < 7, F.lit("Travel_Rarely")).when(k % 10 < 9, F.lit("Non-Travel"))
        .otherwise(F.lit("Travel_Frequently"))
    )

    def yes(condition: Column) -> Column:
        return F.when(condition, F.lit("Yes")).otherwise(F.lit("No"))

    return people.select(
        k.alias("EmployeeID"),
        _int(18 + (k * 7) % 43).alias("Age"),
        yes(got("n_f") > got("n_o")).alias("Attrition"),
        travel.alias("BusinessTravel"),
        F.col("c_mktsegment").alias("Department"),
        _int(1 + (k * 13) % 29).alias("DistanceFromHome"),
        _int(1 + (k * 3) % 4).alias("EnvironmentSatisfaction"),
        F.when(k % 5 < 3, F.lit("Male")).otherwise(F.lit("Female")).alias("Gender"),
        _int(1 + (k * 11) % 5).alias("JobLevel"),
        F.col("n_name").alias("JobRole"),
        _int(1 + (k * 19 + 1) % 4).alias("JobSatisfaction"),
        F.col("c_acctbal").alias("MonthlyIncome"),
        got("n_orders").alias("NumCompaniesWorked"),
        yes(got("n_urgent") >= 3).alias("OverTime"),
        _int(1 + (k * 5) % 3).alias("RelationshipSatisfaction"),
        _int(got("span_y") + k % 10).alias("TotalWorkingYears"),
        _int(1 + (k * 17 + 3) % 4).alias("WorkLifeBalance"),
        got("span_y").alias("YearsAtCompany"),
        got("since_y").alias("YearsSinceLastPromotion"),
    )


def profile_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The same people as a messy upload: aliases, money text, gaps, duplicates, noise columns."""
    people = profile(spark, folder)
    key = F.col("EmployeeID")
    twice = people.withColumn(
        "copy",
        F.explode(F.when(key % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    )
    whole = _int(F.floor("MonthlyIncome"))
    thousands = _int(F.floor(F.col("MonthlyIncome") / 1000)).cast("string")
    money = (
        F.when(key % 19 == 0, F.lit(None))
        .when(
            F.col("MonthlyIncome") >= 1000,
            F.concat(F.lit("$"), thousands, F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0")),
        )
        .otherwise(F.concat(F.lit("$"), whole.cast("string")))
    )
    badge = (
        F.when(key % 3 == 0, (key % 50).cast("string")).when(key % 3 == 1, (key % 7).cast("string"))
        .otherwise(F.lit("n/a"))
    )
    return twice.select(
        (key * 2 + F.col("copy")).alias("EmpID"),
        F.lit(1).alias("EmployeeCount"),
        F.lit("Y").alias("Over18"),
        F.lit("x").alias("Campus"),
        F.when(key % 17 != 0, F.col("Age")).alias("employee_age"),
        F.when(F.col("Attrition") == "Yes", F.lit(" TRUE ")).otherwise(F.lit("0")).alias("churned"),
        F.when(key % 23 != 0, F.col("Department")).alias("dept"),
        F.col("JobRole").alias("job_title"),
        F.col("JobLevel").alias("joblevel"),
        money.alias("Salary"),
        F.col("OverTime").alias("over_time"),
        F.col("YearsAtCompany").alias("tenure"),
        badge.alias("badge_score"),
        F.concat(F.lit("note "), key.cast("string")).alias("free_text"),
    )


def scored(people: DataFrame) -> DataFrame:
    """``row_id``, ``label``, a score in [0, 1] leaning towards the label, ``prediction``.

    Scores have four decimals, so many rows tie.
    """
    u = uniform(digest("score", F.col("EmployeeID")))
    lean = F.when(positive(), F.lit(0.15)).otherwise(F.lit(0.0))
    score = F.bround(F.lit(0.85) * u + lean, 4)
    return people.select(
        F.col("EmployeeID").alias("row_id"),
        positive().cast("int").alias("label"),
        score.alias("score"),
    ).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as a scored table: returned or not, with a score from price and discount."""
    lines = read_table(spark, folder, "lineitem")
    amount = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    score = F.floor(F.least(F.lit(1.0), amount / F.lit(110000.0)) * F.lit(1e6)) / F.lit(1e6)
    return lines.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("label"), score.alias("score"),
    ).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
