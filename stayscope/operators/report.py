"""Report tables: executive summary, department and role analysis, risk lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stayscope.functions.expr import half_even, rate_pct
from stayscope.operators.rates import positive
from stayscope.schema import HR

RISK_COLUMNS = (
    "EmployeeID", "Department", "JobRole", "Age", "MonthlyIncome", "YearsAtCompany", "OverTime", HR.label,
)
RISK_LIST_LENGTH = 50
PREVIEW_ROWS = 100


def executive_summary(df: DataFrame, generated_at: str | None = None) -> DataFrame:
    """``position``, ``metric``, ``value``: one aggregation, then one row per metric.

    Metrics whose column is absent are left out. ``generated_at`` adds the report time.
    """
    have = set(df.columns)
    left = positive()
    stayed = F.col(HR.label) == HR.negative
    n, k = F.count(F.lit(1)), F.count_if(left)
    wanted: list[tuple[str, Column]] = [
        ("Total Employees", n.cast("double")),
        ("Attrition Count", k.cast("double")),
        ("Attrition Rate (%)", half_even(rate_pct(left), 2)),
        ("Retained Employees", (n - k).cast("double")),
    ]
    if "MonthlyIncome" in have:
        wanted += [
            ("Avg Income (Left)", half_even(F.avg(F.when(left, F.col("MonthlyIncome"))), 0)),
            ("Avg Income (Stayed)", half_even(F.avg(F.when(stayed, F.col("MonthlyIncome"))), 0)),
        ]
    if "YearsAtCompany" in have:
        wanted.append(
            ("Avg Tenure of Leavers (years)", half_even(F.avg(F.when(left, F.col("YearsAtCompany"))), 1))
        )
    if "OverTime" in have:
        hit = F.when(left, F.lit(100.0)).otherwise(F.lit(0.0))
        wanted.append(
            ("Overtime Workers Attrition Rate (%)", half_even(F.avg(F.when(F.col("OverTime") == "Yes", hit)), 1))
        )
    row = df.agg(*[value.alias(f"v{i}") for i, (_, value) in enumerate(wanted)])
    cells = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("metric"), F.col(f"v{i}").alias("value"))
        for i, (name, _) in enumerate(wanted)
    ]
    table = row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    whole = F.col("metric").isin("Total Employees", "Attrition Count", "Retained Employees")
    table = table.withColumn(
        "text", F.when(whole, F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    )
    if generated_at is None:
        return table
    stamp = df.sparkSession.createDataFrame(
        [(0, "Report Generated", None, generated_at)], "position int, metric string, value double, text string"
    )
    return stamp.unionByName(table)


def _analysis(df: DataFrame, key: str, income: bool) -> DataFrame:
    marks = [F.count(HR.label).alias("total"), F.count_if(positive()).alias("leavers")]
    if income:
        marks.append(half_even(F.avg("MonthlyIncome"), 0).alias("avg_income"))
    grouped = df.where(F.col(key).isNotNull()).groupBy(key).agg(*marks)
    rate = half_even(F.try_divide(F.col("leavers") * 100.0, F.col("total").cast("double")), 2)
    return grouped.withColumn("rate_pct", rate).orderBy(F.col("rate_pct").desc(), key)


def department_analysis(df: DataFrame, key: str = "Department") -> DataFrame:
    """Headcount, leavers, rate and mean income per department, highest rate first.

    Counts and income share one aggregation, so nothing is joined.
    """
    return _analysis(df, key, "MonthlyIncome" in df.columns)


def role_analysis(df: DataFrame, key: str = "JobRole") -> DataFrame:
    return _analysis(df, key, income=False)


def present(df: DataFrame, wanted: tuple[str, ...]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def leavers(df: DataFrame, columns: tuple[str, ...] = RISK_COLUMNS, key: str | None = None) -> DataFrame:
    """The people who left, with the wanted columns the table has; ``key`` is kept in front."""
    kept = ([key] if key and key not in columns else []) + present(df, columns)
    return df.where(positive()).select(*kept)


def riskiest(
    df: DataFrame, scores: DataFrame, key: str = "EmployeeID", n: int = RISK_LIST_LENGTH
) -> DataFrame:
    """The ``n`` highest scores with the people's details.

    The top rows are taken from the scores alone before the join, so the join sees ``n`` rows.
    """
    risk = half_even(F.col("score") * 100, 1)
    top = scores.select(key, risk.alias("risk_pct")).orderBy(F.col("risk_pct").desc(), key).limit(n)
    columns = ([key] if key not in RISK_COLUMNS else []) + present(df, RISK_COLUMNS)
    return df.select(*columns).join(top, key).orderBy(F.col("risk_pct").desc(), key)


def preview(df: DataFrame, key: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows by key; a bounded heap per task, not a sort."""
    return df.orderBy(key).limit(n)


def preview_total(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """``shown`` and ``total``: the caption of a preview."""
    total = F.count(F.lit(1))
    return df.agg(F.least(total, F.lit(n)).cast("bigint").alias("shown"), total.alias("total"))


def lookup(raw: DataFrame, cleaned: DataFrame, ids: DataFrame, key: str, row_id: str = "row_id") -> DataFrame:
    """The cleaned record for each asked id.

    An id whose row was removed as a duplicate, or that is unknown, gets the cleaned row with the
    least key and ``found`` false.
    """
    asked = ids.select(F.col(ids.columns[0]).alias("asked_id")).distinct()
    wanted = asked.join(raw.select(F.col(key).alias("asked_id")).distinct(), "asked_id", "left_semi")
    hit = wanted.join(cleaned, F.col("asked_id") == F.col(row_id))
    first = cleaned.orderBy(row_id).first()
    missing = asked.join(hit.select("asked_id"), "asked_id", "left_anti")
    types = {f.name: f.dataType for f in cleaned.schema.fields}
    fallback = missing.select(
        "asked_id", *[F.lit(first[c] if first else None).cast(types[c]).alias(c) for c in cleaned.columns]
    )
    return hit.withColumn("found", F.lit(True)).unionByName(fallback.withColumn("found", F.lit(False)))


def report_tables(
    df: DataFrame, metrics: DataFrame | None = None, importance: DataFrame | None = None,
    generated_at: str | None = None,
) -> dict[str, DataFrame]:
    """The sheets of the full report, in order."""
    sheets = {
        "Executive Summary": executive_summary(df, generated_at),
        "Department Analysis": department_analysis(df),
        "Job Role Analysis": role_analysis(df),
        "High Risk Employees": leavers(df),
    }
    if metrics is None:
        metrics = df.sparkSession.createDataFrame(
            [], "Model string, Accuracy double, `F1-Score` double, `ROC-AUC` double"
        )
    sheets["Model Performance"] = metrics
    if importance is not None and not importance.isEmpty():
        sheets["Feature Importance"] = importance
    return sheets
