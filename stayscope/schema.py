"""Column roles of a personnel table and the fixed values the repair rules rely on."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Canonical column names by role.
CATEGORICAL = (
    "BusinessTravel", "Department", "EducationField", "Gender", "JobRole", "MaritalStatus", "OverTime",
)
ORDINAL = (
    "Education", "EnvironmentSatisfaction", "JobInvolvement", "JobLevel", "JobSatisfaction",
    "PerformanceRating", "RelationshipSatisfaction", "StockOptionLevel", "WorkLifeBalance",
)
NUMERIC = (
    "Age", "DistanceFromHome", "MonthlyIncome", "MonthlyRate", "NumCompaniesWorked", "PercentSalaryHike",
    "TotalWorkingYears", "TrainingTimesLastYear", "YearsAtCompany", "YearsInCurrentRole",
    "YearsSinceLastPromotion", "YearsWithCurrManager",
)

# Spellings (as normalised keys) accepted for each canonical column.
SPELLINGS = {
    "Attrition": ("attrition", "left", "churned", "turnover", "employee_left", "left_company"),
    "Age": ("age", "employee_age"),
    "Gender": ("gender", "sex"),
    "MaritalStatus": ("marital_status", "maritalstatus"),
    "Department": ("department", "dept", "division"),
    "JobRole": ("job_role", "jobrole", "role", "position", "job_title"),
    "JobLevel": ("job_level", "joblevel"),
    "JobInvolvement": ("job_involvement", "jobinvolvement"),
    "JobSatisfaction": ("job_satisfaction", "jobsatisfaction"),
    "Education": ("education", "education_level"),
    "EducationField": ("education_field", "educationfield"),
    "MonthlyIncome": ("monthly_income", "monthlyincome", "salary", "monthly_salary"),
    "MonthlyRate": ("monthly_rate", "monthlyrate"),
    "PercentSalaryHike": ("percent_salary_hike", "percentsalaryhike", "salary_hike"),
    "StockOptionLevel": ("stock_option_level", "stockoptionlevel", "stock_options"),
    "OverTime": ("overtime", "over_time", "overwork"),
    "BusinessTravel": ("business_travel", "businesstravel", "travel"),
    "DistanceFromHome": ("distance_from_home", "distancefromhome", "commute_distance"),
    "EnvironmentSatisfaction": ("environment_satisfaction", "environmentsatisfaction"),
    "WorkLifeBalance": ("work_life_balance", "worklifebalance"),
    "PerformanceRating": ("performance_rating", "performancerating"),
    "RelationshipSatisfaction": ("relationship_satisfaction", "relationshipsatisfaction"),
    "TrainingTimesLastYear": ("training_times_last_year", "trainingtimeslastyear"),
    "YearsAtCompany": ("years_at_company", "yearsatcompany", "tenure"),
    "TotalWorkingYears": ("total_working_years", "totalworkingyears"),
    "YearsInCurrentRole": ("years_in_current_role", "yearsincurrentrole"),
    "YearsSinceLastPromotion": ("years_since_last_promotion", "yearssincelastpromotion"),
    "YearsWithCurrManager": ("years_with_curr_manager", "yearswithcurrmanager"),
    "NumCompaniesWorked": ("num_companies_worked", "numcompaniesworked", "number_of_companies"),
}

# Whole-key patterns of identifier and bookkeeping columns.
IDENTIFIER_PATTERNS = (
    r".*employee.*id.*", r".*emp.*id.*", r".*employee.*number.*", r".*employee.*count.*",
    r".*over.*18.*", r".*standard.*hours.*",
)

# Label texts that mean "left".
POSITIVE_TEXTS = ("yes", "1", "true", "left", "churned", "1.0")

# Characters that mark or separate money amounts.
CURRENCY_CHARS = "$£€₹,"

# What a record being scored gets for a field it does not carry.
SCORING_DEFAULTS = {
    "Age": 35, "MonthlyIncome": 5000, "OverTime": "No", "YearsAtCompany": 5, "YearsSinceLastPromotion": 2,
    "JobSatisfaction": 3, "MaritalStatus": "Married", "WorkLifeBalance": 3, "EnvironmentSatisfaction": 3,
    "DistanceFromHome": 10, "NumCompaniesWorked": 2, "StockOptionLevel": 0, "BusinessTravel": "Travel_Rarely",
    "TotalWorkingYears": 8, "Gender": "Male", "Education": 3, "EducationField": "Life Sciences", "JobLevel": 2,
    "JobInvolvement": 3, "MonthlyRate": 14000, "PercentSalaryHike": 14, "PerformanceRating": 3,
    "RelationshipSatisfaction": 3, "TrainingTimesLastYear": 3, "YearsInCurrentRole": 3,
    "YearsWithCurrManager": 4, "Attrition": "No",
}

# Accepted range of each field of a record being scored.
SCORING_BOUNDS = {
    "Age": (18, 65), "MonthlyIncome": (1000, 25000), "YearsAtCompany": (0, 40),
    "YearsSinceLastPromotion": (0, 15), "JobSatisfaction": (1, 4), "WorkLifeBalance": (1, 4),
    "EnvironmentSatisfaction": (1, 4), "DistanceFromHome": (1, 30), "NumCompaniesWorked": (0, 10),
    "StockOptionLevel": (0, 3), "TotalWorkingYears": (0, 40),
}
SCORING_CHOICES = {
    "OverTime": ("Yes", "No"),
    "MaritalStatus": ("Single", "Married", "Divorced"),
    "BusinessTravel": ("Non-Travel", "Travel_Rarely", "Travel_Frequently"),
}


@dataclass(frozen=True)
class Roles:
    """Which columns play which part. The defaults are the personnel-table names."""

    label: str = "Attrition"
    positive: str = "Yes"
    negative: str = "No"
    categorical: tuple[str, ...] = CATEGORICAL
    ordinal: tuple[str, ...] = ORDINAL
    numeric: tuple[str, ...] = NUMERIC
    spellings: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(SPELLINGS))

    @property
    def known(self) -> frozenset[str]:
        return frozenset((self.label, *self.categorical, *self.ordinal, *self.numeric))

    @property
    def canonical_by_key(self) -> dict[str, str]:
        return {key: name for name, keys in self.spellings.items() for key in keys}


HR = Roles()


def column_key(name: str) -> str:
    """``" Monthly-Income "`` and ``"monthly_income"`` share the key ``"monthly_income"``."""
    return "_".join(re.findall(r"[a-z0-9]+", name.strip().lower()))


def looks_like_identifier(name: str) -> bool:
    key = column_key(name)
    return any(re.fullmatch(pattern, key) for pattern in IDENTIFIER_PATTERNS)
