"""Grouped label statistics behind the dashboard and the short answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayscope.functions.expr import half_even, rate_pct, ratio
from stayscope.schema import HR
from stayscope.session import lookup_table

SATISFACTION = ("JobSatisfaction", "EnvironmentSatisfaction", "WorkLifeBalance", "RelationshipSatisfaction")
TENURE_SHOWN = 25


def positive(label: str = HR.label, text: str = HR.positive) -> Column:
    return F.coalesce(F.col(label) == F.lit(text), F.lit(False))


def label_rate_by(
    df: DataFrame, keys: Sequence[str], label: str = HR.label, text: str = HR.positive
) -> DataFrame:
    """Per key: ``total`` rows with a label, ``positives`` and ``rate_pct``.

    Sums and counts only, so each map task sends one row per key whatever the key's share.
    """
    hit = positive(label, text)
    return df.groupBy(*keys).agg(
        F.count(label).alias("total"),
        F.count_if(hit).alias("positives"),
        rate_pct(hit).alias("rate_pct"),
    )


def kpi_row(df: DataFrame) -> DataFrame:
    """Headcount, leavers, rate, average income and tenure, overtime share; 0 for absent columns."""
    have = set(df.columns)

    def when_present(name: str, value: Column) -> Column:
        return value if name in have else F.lit(0.0)

    return df.agg(
        F.count(F.lit(1)).alias("employees"),
        F.count_if(positive()).alias("leavers"),
        rate_pct(positive()).alias("rate_pct"),
        when_present("MonthlyIncome", F.avg("MonthlyIncome")).alias("avg_income"),
        when_present("YearsAtCompany", F.avg("YearsAtCompany")).alias("avg_tenure"),
        when_present("OverTime", rate_pct(positive("OverTime"))).alias("overtime_pct"),
    )


def status_card(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("employees"),
        rate_pct(positive()).alias("rate_pct"),
        F.count_distinct("Department").alias("departments"),
        F.count_distinct("JobRole").alias("roles"),
    )


def class_shares(df: DataFrame, label: str = HR.label) -> DataFrame:
    """Rows per label value and their share. The window runs over the few counted labels."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return counted.withColumn("share_pct", share)


def pair_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def gender_counts(df: DataFrame, shown: Sequence[str] = ("Male", "Female")) -> DataFrame:
    return pair_counts(df.where(F.col("Gender").isin(*shown)), ["Gender", HR.label])


def satisfaction_rates(df: DataFrame, measures: Sequence[str] = SATISFACTION) -> DataFrame:
    """Leaver rate per (measure, score) for the measures the table has."""
    present = [m for m in measures if m in df.columns]
    long = df.select(HR.label, *[F.col(m).cast("int") for m in present]).unpivot(
        [HR.label], present, "measure", "score"
    )
    return label_rate_by(long.where("score is not null"), ["measure", "score"])


def satisfaction_grid(df: DataFrame, scores: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """The same as a grid, one column per score; a combination that never occurs is null."""
    return satisfaction_rates(df).groupBy("measure").pivot("score", list(scores)).agg(F.first("rate_pct"))


def tenure_curve(df: DataFrame, longest: int = TENURE_SHOWN) -> DataFrame:
    return label_rate_by(df.where(F.col("YearsAtCompany") <= longest), ["YearsAtCompany"])


def rate_ranking(df: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    ranked = F.col("rate_pct").asc() if ascending else F.col("rate_pct").desc()
    return label_rate_by(df, [key]).orderBy(ranked, key)


def top_group(df: DataFrame, key: str = "Department") -> DataFrame:
    """The key with the highest rate, the least key on a tie."""
    rates = label_rate_by(df.where(F.col(key).isNotNull()), [key])
    return rates.orderBy(F.col("rate_pct").desc(), key).limit(1).select(key, "rate_pct")


def overtime_risk(df: DataFrame) -> DataFrame:
    """Leaver rate with and without overtime and their ratio, in one pass."""
    hit = F.when(positive(), F.lit(100.0)).otherwise(F.lit(0.0))
    both = df.agg(
        F.avg(F.when(F.col("OverTime") == "Yes", hit)).alias("overtime_rate"),
        F.avg(F.when(F.col("OverTime") == "No", hit)).alias("regular_rate"),
    )
    return both.withColumn("risk_ratio", ratio(F.col("overtime_rate"), F.col("regular_rate")))


def income_gap(df: DataFrame) -> DataFrame:
    income = F.col("MonthlyIncome")
    return df.agg(
        F.avg(F.when(positive(), income)).alias("income_left"),
        F.avg(F.when(F.col(HR.label) == HR.negative, income)).alias("income_stayed"),
    )


def overview(df: DataFrame) -> DataFrame:
    """Headcount, rate and the top department from one grouped aggregation.

    The table totals are sums of the department counts, so the rows are read once.
    """
    by_department = df.groupBy("Department").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(positive()).alias("k")
    )
    rate = F.when(F.col("Department").isNotNull(), F.col("k") / F.col("n"))
    return by_department.agg(
        F.sum("n").alias("employees"),
        (F.sum("k") * 100.0 / F.sum("n")).alias("rate_pct"),
        F.min_by("Department", F.when(rate.isNotNull(), F.struct(-rate, F.col("Department")))).alias("top_department"),
    )


def department_summary(df: DataFrame) -> DataFrame:
    return _summary(df, "Department").orderBy("Department")


def role_summary(df: DataFrame) -> DataFrame:
    return (
        _summary(df, "JobRole")
        .select("JobRole", F.col("total").alias("count"), "rate_pct")
        .orderBy(F.col("rate_pct").desc(), "JobRole")
    )


def _summary(df: DataFrame, key: str) -> DataFrame:
    grouped = df.where(F.col(key).isNotNull()).groupBy(key)
    return grouped.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(positive()).alias("leavers"),
        half_even(rate_pct(positive()), 1).alias("rate_pct"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def with_group_total(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Attach a group aggregate to every row.

    The aggregate is joined back rather than windowed: a window would pull a whole group into
    one task, while the small aggregate is broadcast when its measured size allows.
    """
    totals = lookup_table(df.groupBy(key).agg(value.alias(name)).withColumnRenamed(key, "_key"))
    return df.join(totals, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
