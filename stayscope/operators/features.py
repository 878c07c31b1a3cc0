"""Derived retention features. Each is added only when its inputs exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stayscope.functions.expr import ratio
from stayscope.functions.ranges import SINGLE_RANGE_ROWS, exact_quantiles, null_safe_join
from stayscope.schema import HR, Roles
from stayscope.session import lookup_table

TENURED_YEARS = 5


def _overtime() -> Column:
    return F.coalesce((F.col("OverTime") == "Yes").cast("int"), F.lit(0))


ROW_FEATURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "PromotionLag": (
        ("YearsSinceLastPromotion", "YearsAtCompany"),
        lambda: ratio(F.col("YearsSinceLastPromotion"), F.col("YearsAtCompany") + 1),
    ),
    "IsTenured": (
        ("YearsAtCompany",),
        lambda: F.coalesce((F.col("YearsAtCompany") >= TENURED_YEARS).cast("int"), F.lit(0)),
    ),
    "BurnoutRisk": (
        ("OverTime", "WorkLifeBalance"),
        lambda: _overtime() * (F.lit(5) - F.col("WorkLifeBalance")),
    ),
    "OverallSatisfaction": (
        ("JobSatisfaction", "EnvironmentSatisfaction"),
        lambda: (F.col("JobSatisfaction") + F.col("EnvironmentSatisfaction")) / F.lit(2.0),
    ),
    "CareerMobility": (
        ("NumCompaniesWorked", "TotalWorkingYears"),
        lambda: ratio(F.col("NumCompaniesWorked"), F.col("TotalWorkingYears") + 1),
    ),
    "LoyaltyIndex": (
        ("YearsAtCompany", "TotalWorkingYears"),
        lambda: ratio(F.col("YearsAtCompany"), F.col("TotalWorkingYears") + 1),
    ),
    "DistanceOvertimeRisk": (
        ("DistanceFromHome", "OverTime"),
        lambda: F.col("DistanceFromHome") * (F.lit(1) + _overtime()),
    ),
}


def row_features(df: DataFrame) -> DataFrame:
    """The seven features that need only their own row, as one projection."""
    have = set(df.columns)
    return df.withColumns({name: make() for name, (needs, make) in ROW_FEATURES.items() if have.issuperset(needs)})


def level_medians(
    df: DataFrame, level: str = "JobLevel", income: str = "MonthlyIncome", rows_per_range: int = SINGLE_RANGE_ROWS
) -> DataFrame:
    """Median income per job level: ``(level, level_median)``."""
    return exact_quantiles(df.where(F.col(level).isNotNull()), income, [0.5], [level], rows_per_range).select(
        level, F.col("quantiles")[0].alias("level_median")
    )


def income_to_level(
    df: DataFrame,
    medians: DataFrame | None = None,
    level: str = "JobLevel",
    income: str = "MonthlyIncome",
    single_row_mode: str = "fitted",
) -> DataFrame:
    """Income relative to the median of the job level; 1 where that is undefined.

    The median table is broadcast only when its measured size allows.
    ``single_row_mode="self"`` compares each row with itself, as scoring one record on its own
    does; the result is 1 for every row.
    """
    if single_row_mode == "self":
        return df.withColumn("IncomeToLevelRatio", F.coalesce(ratio(F.col(income), F.col(income)), F.lit(1.0)))
    medians = lookup_table(level_medians(df, level, income)) if medians is None else medians
    joined = null_safe_join(df, medians, [level], "left")
    value = F.coalesce(ratio(F.col(income), F.col("level_median")), F.lit(1.0))
    return joined.withColumn("IncomeToLevelRatio", value).drop("level_median")


def engineer(df: DataFrame, medians: DataFrame | None = None, single_row_mode: str = "fitted") -> DataFrame:
    """All derived features whose inputs exist."""
    if {"MonthlyIncome", "JobLevel"} <= set(df.columns):
        df = income_to_level(df, medians, single_row_mode=single_row_mode)
    return row_features(df)


def feature_columns(df: DataFrame, roles: Roles = HR, row_id: str = "row_id") -> list[str]:
    """Columns a model sees: everything but the label and the key."""
    return [c for c in df.columns if c not in (roles.label, row_id)]
