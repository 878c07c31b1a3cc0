"""A synthetic personnel table whose values depend only on each row's key.

Every draw comes from a digest of (seed, key, purpose), so the table is the same however it is
partitioned and any part of it can be generated on its own.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayscope.functions.expr import weighted_pick
from stayscope.functions.hashing import digest, uniform

# Distributions of the sample table.
DEPARTMENTS = [("Sales", 0.35), ("Research & Development", 0.55), ("Human Resources", 0.10)]
ROLES = {
    "Sales": ["Sales Executive", "Sales Representative", "Manager"],
    "Research & Development": [
        "Research Scientist", "Laboratory Technician", "Manufacturing Director", "Healthcare Representative",
        "Manager",
    ],
    "Human Resources": ["Human Resources", "Manager"],
}
BASE_INCOME = {
    "Sales Executive": 6000, "Sales Representative": 3000, "Manager": 17000, "Research Scientist": 5000,
    "Laboratory Technician": 3500, "Manufacturing Director": 14000, "Healthcare Representative": 6000,
    "Human Resources": 4000,
}
EDUCATION_FIELDS = [
    ("Life Sciences", 0.41), ("Medical", 0.27), ("Marketing", 0.11), ("Technical Degree", 0.09),
    ("Human Resources", 0.07), ("Other", 0.05),
]
TRAVEL = [("Non-Travel", 0.19), ("Travel_Rarely", 0.71), ("Travel_Frequently", 0.10)]
GENDERS = [("Male", 0.60), ("Female", 0.40)]
MARITAL = [("Single", 0.32), ("Married", 0.46), ("Divorced", 0.22)]
OVERTIME = [("Yes", 0.29), ("No", 0.71)]
SCORES = {
    "JobSatisfaction": (1, [0.12, 0.20, 0.30, 0.38]),
    "EnvironmentSatisfaction": (1, [0.10, 0.18, 0.35, 0.37]),
    "RelationshipSatisfaction": (1, [0.08, 0.20, 0.37, 0.35]),
    "WorkLifeBalance": (1, [0.05, 0.22, 0.60, 0.13]),
    "PerformanceRating": (1, [0.01, 0.03, 0.85, 0.11]),
    "TrainingTimesLastYear": (0, [0.06, 0.20, 0.29, 0.26, 0.11, 0.06, 0.02]),
    "Education": (1, [0.12, 0.19, 0.32, 0.28, 0.09]),
    "NumCompaniesWorked": (0, [0.10, 0.30, 0.20, 0.15, 0.10, 0.07, 0.04, 0.02, 0.01, 0.01]),
    "StockOptionLevel": (0, [0.47, 0.36, 0.12, 0.05]),
    "JobInvolvement": (1, [0.06, 0.20, 0.59, 0.15]),
    "JobLevel": (1, [0.26, 0.37, 0.22, 0.10, 0.05]),
}
RISK_TERMS = [
    ("OverTime = 'Yes'", 0.30), ("JobSatisfaction = 1", 0.25), ("MaritalStatus = 'Single'", 0.15),
    ("YearsAtCompany < 3", 0.20), ("YearsSinceLastPromotion > 5", 0.10),
    ("BusinessTravel = 'Travel_Frequently'", 0.10), ("EnvironmentSatisfaction = 1", 0.15),
    ("WorkLifeBalance = 1", 0.10), ("StockOptionLevel = 0", 0.08), ("DistanceFromHome > 20", 0.05),
    ("NumCompaniesWorked > 5", 0.08), ("Department = 'Sales'", 0.05),
    ("YearsAtCompany > 10", -0.15), ("StockOptionLevel > 1", -0.10), ("JobSatisfaction = 4", -0.10),
]
RISK_SLOPE, RISK_CENTRE = 2.0, 0.5
FIRST_ID = 1001
COLUMNS = [
    "EmployeeID", "Age", "Attrition", "BusinessTravel", "Department", "DistanceFromHome", "Education",
    "EducationField", "EnvironmentSatisfaction", "Gender", "JobInvolvement", "JobLevel", "JobRole",
    "JobSatisfaction", "MaritalStatus", "MonthlyIncome", "MonthlyRate", "NumCompaniesWorked", "OverTime",
    "PercentSalaryHike", "PerformanceRating", "RelationshipSatisfaction", "StockOptionLevel",
    "TotalWorkingYears", "TrainingTimesLastYear", "WorkLifeBalance", "YearsAtCompany", "YearsInCurrentRole",
    "YearsSinceLastPromotion", "YearsWithCurrManager",
]


class _Draws:
    """Hands out uniforms, four to a digest column, under names fixed by the order of use."""

    def __init__(self, key: Column, seed: object):
        self.key, self.seed, self.used = key, seed, 0

    def u(self) -> Column:
        block, part = divmod(self.used, 4)
        self.used += 1
        return uniform(F.col(f"_d{block}"), part)

    def columns(self) -> dict[str, Column]:
        return {f"_d{b}": digest(f"{self.seed}:{b}", self.key) for b in range(-(-self.used // 4))}


def _clipped_int(value: Column, low: float, high: float) -> Column:
    return F.floor(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))).cast("int")


def _exponential(u: Column, scale: float) -> Column:
    return -F.lit(float(scale)) * F.log(F.lit(1.0) - u)


def _normal(u: Column, v: Column, mean: float, deviation: float) -> Column:
    return F.lit(float(mean)) + F.lit(float(deviation)) * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(
        F.lit(2 * pi) * v
    )


def employees_for(ids: DataFrame, key: str, seed: object = 42) -> DataFrame:
    """One synthetic employee per row of ``ids``, identified by its key. Map-only."""
    draws = _Draws(F.col(key), seed)
    u = draws.u
    role = F.lit(None).cast("string")
    role_u = u()
    for department, roles in ROLES.items():
        even = [(r, 1.0 / len(roles)) for r in roles]
        role = F.when(F.col("Department") == department, weighted_pick(role_u, even)).otherwise(role)
    stages: list[dict[str, Column]] = [
        {
            "EmployeeID": F.col(key).cast("bigint"),
            "Department": weighted_pick(u(), DEPARTMENTS),
            "EducationField": weighted_pick(u(), EDUCATION_FIELDS),
            "BusinessTravel": weighted_pick(u(), TRAVEL),
            "Gender": weighted_pick(u(), GENDERS),
            "MaritalStatus": weighted_pick(u(), MARITAL),
            "OverTime": weighted_pick(u(), OVERTIME),
            "Age": _clipped_int(_normal(u(), u(), 37, 9), 18, 60),
            "YearsAtCompany": _clipped_int(_exponential(u(), 7), 0, 40),
            "DistanceFromHome": _clipped_int(_exponential(u(), 9), 1, 29),
            "PercentSalaryHike": _clipped_int(_normal(u(), u(), 15, 3), 11, 25),
            "MonthlyRate": F.floor(F.lit(2094) + u() * F.lit(26999 - 2094)).cast("int"),
            **{
                name: weighted_pick(u(), [(first + i, w) for i, w in enumerate(weights)]).cast("int")
                for name, (first, weights) in SCORES.items()
            },
        },
        {
            "JobRole": role,
            "YearsInCurrentRole": F.least(F.col("YearsAtCompany"), _clipped_int(_exponential(u(), 4), 0, 18)),
            "YearsSinceLastPromotion": F.least(F.col("YearsAtCompany"), _clipped_int(_exponential(u(), 3), 0, 15)),
            "YearsWithCurrManager": F.least(F.col("YearsAtCompany"), _clipped_int(_exponential(u(), 4), 0, 17)),
            "TotalWorkingYears": F.least(
                F.lit(40), F.col("YearsAtCompany") + F.floor(u() * F.lit(10.0)).cast("int")
            ),
        },
    ]
    base = F.lit(5000.0)
    for name, amount in BASE_INCOME.items():
        base = F.when(F.col("JobRole") == name, F.lit(float(amount))).otherwise(base)
    income = base * (F.lit(0.7) + u() * F.lit(0.8)) + F.col("YearsAtCompany") * F.lit(100.0)
    risk = sum((F.when(F.expr(term), F.lit(points)).otherwise(F.lit(0.0)) for term, points in RISK_TERMS), F.lit(0.0))
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(RISK_SLOPE) * (risk - F.lit(RISK_CENTRE))))
    stages.append({
        "MonthlyIncome": _clipped_int(income, 1009, 20000),
        "Attrition": F.when(u() < chance, F.lit("Yes")).otherwise(F.lit("No")),
    })
    out = ids.select(key).withColumns(draws.columns())
    for stage in stages:
        out = out.withColumns(stage)
    return out.select(*COLUMNS)


def generate_employees(spark: SparkSession, n: int = 1470, seed: object = 42) -> DataFrame:
    """``n`` synthetic employees with ids from 1001."""
    ids = spark.range(FIRST_ID, FIRST_ID + n).withColumnRenamed("id", "key")
    return employees_for(ids, "key", seed)
