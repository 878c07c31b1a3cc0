"""The same results in SQL for an independent engine (DuckDB) on the same parquet tables."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from stayscope.plans.queries import (
    FOLDS, KERNEL_FEATURES, LINEAR_INTERCEPT, LINEAR_WEIGHTS, METERS, MODEL_NAMES, NEIGHBOUR_FEATURES, SHEET_KEYS, SHEET_MEASURES,
    SMALL_TREE, SMALL_TREE_FEATURES,
)
from stayscope.schema import POSITIVE_TEXTS, SCORING_BOUNDS, SCORING_CHOICES
from stayscope.sources import generator as gen

ORACLES: dict[str, str] = {}

PROFILE = """
o AS (
  SELECT o_custkey, CAST(count(*) AS INT) AS n_orders,
         CAST(max(year(o_orderdate)) - min(year(o_orderdate)) AS INT) AS span_y,
         CAST(2001 - max(year(o_orderdate)) AS INT) AS since_y,
         CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INT) AS n_urgent,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INT) AS n_f,
         CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS INT) AS n_o
  FROM orders GROUP BY o_custkey),
profile AS (
SELECT c.c_custkey AS EmployeeID,
  CAST(18 + (c.c_custkey * 7) % 43 AS INT) AS Age,
  CASE WHEN coalesce(o.n_f, 0) > coalesce(o.n_o, 0) THEN 'Yes' ELSE 'No' END AS Attrition,
  CASE WHEN c.c_custkey % 10 < 7 THEN 'Travel_Rarely' WHEN c.c_custkey % 10 < 9 THEN 'Non-Travel'
       ELSE 'Travel_Frequently' END AS BusinessTravel,
  c.c_mktsegment AS Department,
  CAST(1 + (c.c_custkey * 13) % 29 AS INT) AS DistanceFromHome,
  CAST(1 + (c.c_custkey * 3) % 4 AS INT) AS EnvironmentSatisfaction,
  CASE WHEN c.c_custkey % 5 < 3 THEN 'Male' ELSE 'Female' END AS Gender,
  CAST(1 + (c.c_custkey * 11) % 5 AS INT) AS JobLevel,
  n.n_name AS JobRole,
  CAST(1 + (c.c_custkey * 19 + 1) % 4 AS INT) AS JobSatisfaction,
  c.c_acctbal AS MonthlyIncome,
  coalesce(o.n_orders, 0) AS NumCompaniesWorked,
  CASE WHEN coalesce(o.n_urgent, 0) >= 3 THEN 'Yes' ELSE 'No' END AS OverTime,
  CAST(1 + (c.c_custkey * 5) % 3 AS INT) AS RelationshipSatisfaction,
  CAST(coalesce(o.span_y, 0) + c.c_custkey % 10 AS INT) AS TotalWorkingYears,
  CAST(1 + (c.c_custkey * 17 + 3) % 4 AS INT) AS WorkLifeBalance,
  coalesce(o.span_y, 0) AS YearsAtCompany,
  coalesce(o.since_y, 0) AS YearsSinceLastPromotion
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN o ON c.c_custkey = o.o_custkey)"""

RAW = PROFILE + """,
dup AS (SELECT *, 0 AS copy FROM profile UNION ALL SELECT *, 1 AS copy FROM profile WHERE EmployeeID % 20 = 0),
profile_raw AS (
SELECT CAST(EmployeeID * 2 + copy AS BIGINT) AS EmpID, CAST(1 AS INT) AS EmployeeCount, 'Y' AS Over18, 'x' AS Campus,
  CASE WHEN EmployeeID % 17 = 0 THEN NULL ELSE Age END AS employee_age,
  CASE WHEN Attrition = 'Yes' THEN ' TRUE ' ELSE '0' END AS churned,
  CASE WHEN EmployeeID % 23 = 0 THEN NULL ELSE Department END AS dept,
  JobRole AS job_title, JobLevel AS joblevel,
  CASE WHEN EmployeeID % 19 = 0 THEN NULL
       WHEN MonthlyIncome >= 1000 THEN concat('$', CAST(CAST(floor(MonthlyIncome / 1000) AS INT) AS VARCHAR), ',',
            lpad(CAST(CAST(floor(MonthlyIncome) AS INT) % 1000 AS VARCHAR), 3, '0'))
       ELSE concat('$', CAST(CAST(floor(MonthlyIncome) AS INT) AS VARCHAR)) END AS Salary,
  OverTime AS over_time, YearsAtCompany AS tenure,
  CASE WHEN EmployeeID % 3 = 0 THEN CAST(EmployeeID % 50 AS VARCHAR)
       WHEN EmployeeID % 3 = 1 THEN CAST(EmployeeID % 7 AS VARCHAR) ELSE 'n/a' END AS badge_score,
  concat('note ', CAST(EmployeeID AS VARCHAR)) AS free_text
FROM dup)"""

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
LEFT_TEXTS = ", ".join(f"'{t}'" for t in POSITIVE_TEXTS)


def number(text: str) -> str:
    return f"(CASE WHEN regexp_matches({text}, '{NUMBER}') THEN TRY_CAST({text} AS DOUBLE) END)"


def money(column: str) -> str:
    return number(f"regexp_replace({column}, '[$£€₹,\\s]', '', 'g')")


CLEAN = RAW + f""",
prepared AS (SELECT EmpID AS row_id, employee_age AS Age,
  CASE WHEN coalesce(lower(trim(churned)) IN ({LEFT_TEXTS}), false) THEN 'Yes' ELSE 'No' END AS Attrition,
  dept AS Department, job_title AS JobRole, joblevel AS JobLevel, {money("Salary")} AS MonthlyIncome,
  over_time AS OverTime, tenure AS YearsAtCompany, badge_score, free_text FROM profile_raw),
uniq AS (SELECT min(row_id) AS row_id, Age, Attrition, Department, JobRole, JobLevel, MonthlyIncome, OverTime,
  YearsAtCompany, badge_score, free_text FROM prepared GROUP BY ALL),
numbers AS (SELECT row_id, CAST(Age AS DOUBLE) AS Age, Attrition, Department, JobRole,
  CAST(JobLevel AS DOUBLE) AS JobLevel, MonthlyIncome, OverTime, CAST(YearsAtCompany AS DOUBLE) AS YearsAtCompany,
  {number("badge_score")} AS badge_score FROM uniq),
medians AS (SELECT quantile_cont(Age, 0.5) AS m_age, quantile_cont(MonthlyIncome, 0.5) AS m_income,
  quantile_cont(badge_score, 0.5) AS m_badge FROM numbers),
mode_department AS (SELECT Department AS m_department FROM numbers WHERE Department IS NOT NULL
  GROUP BY Department ORDER BY count(*) DESC, Department LIMIT 1),
filled AS (SELECT row_id, coalesce(Age, m_age) AS Age, Attrition, coalesce(Department, m_department) AS Department,
  JobRole, CAST(trunc(coalesce(JobLevel, 1)) AS INT) AS JobLevel, coalesce(MonthlyIncome, m_income) AS MonthlyIncome,
  OverTime, YearsAtCompany, coalesce(badge_score, m_badge) AS badge_score
  FROM numbers CROSS JOIN medians CROSS JOIN mode_department),
bounds AS (SELECT quantile_cont(Age, [0.01, 0.99]) AS b_age, quantile_cont(MonthlyIncome, [0.01, 0.99]) AS b_income,
  quantile_cont(YearsAtCompany, [0.01, 0.99]) AS b_tenure FROM filled),
clean AS (SELECT row_id, greatest(b_age[1], least(b_age[2], Age)) AS Age, Attrition, Department, JobRole, JobLevel,
  greatest(b_income[1], least(b_income[2], MonthlyIncome)) AS MonthlyIncome, OverTime,
  greatest(b_tenure[1], least(b_tenure[2], YearsAtCompany)) AS YearsAtCompany, badge_score
  FROM filled CROSS JOIN bounds)"""


def r(expr: str, places: int = 6) -> str:
    return f"(round_even(CAST({expr} AS DOUBLE), {places}) + 0.0)"


def u(text: str, part: int = 0) -> str:
    """A number in [0, 1) from one part of a digest."""
    return f"(CAST(('0x' || substr({text}, {1 + 8 * part}, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def h(seed: object, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


def profile_sql(name: str, select: str) -> None:
    ORACLES[name] = f"WITH {PROFILE}\n{select}"


def raw_sql(name: str, select: str) -> None:
    ORACLES[name] = f"WITH {RAW}\n{select}"


def clean_sql(name: str, select: str) -> None:
    ORACLES[name] = f"WITH {CLEAN}\n{select}"


def table_sql(name: str, select: str) -> None:
    ORACLES[name] = select


RATE = "avg(CASE WHEN Attrition = 'Yes' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)"
YES = "count(*) FILTER (Attrition = 'Yes')"


def rate_by(keys: str) -> str:
    return f"SELECT {keys}, count(Attrition) AS total, {YES} AS positives, {r(RATE)} AS rate_pct FROM profile GROUP BY {keys}"


# Sources and sinks ------------------------------------------------------------------------------

profile_sql("s1_csv_source", "SELECT * FROM profile")


def _choice(draw: str, options: list) -> str:
    parts, total = [], 0.0
    for value, weight in options[:-1]:
        total += weight
        shown = f"'{value}'" if isinstance(value, str) else str(value)
        parts.append(f"WHEN {draw} < {round(total, 10)!r}::DOUBLE THEN {shown}")
    value = options[-1][0]
    return f"CASE {' '.join(parts)} ELSE {repr(value) if isinstance(value, str) else value} END"


def _generated() -> str:
    count = iter(range(1000))

    def draw() -> str:
        block, part = divmod(next(count), 4)
        return u(h(f"42:{block}", "c_custkey"), part)

    def clip(x: str, lo: float, hi: float) -> str:
        return f"CAST(floor(greatest({float(lo)}::DOUBLE, least({float(hi)}::DOUBLE, {x}))) AS INT)"

    def expo(scale: int) -> str:
        return f"(-{scale}.0::DOUBLE * ln(1.0::DOUBLE - {draw()}))"

    def normal(mean: int, dev: int) -> str:
        first, second = draw(), draw()
        return f"({mean}.0::DOUBLE + {dev}.0::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {first})) * cos(2 * pi() * {second}))"

    role_u = draw()
    role_cases = " ".join(
        f"WHEN Department = '{d}' THEN ({_choice(role_u, [(x, 1.0 / len(rs)) for x in rs])})" for d, rs in gen.ROLES.items()
    )
    first = [
        ("Department", _choice(draw(), gen.DEPARTMENTS)),
        ("EducationField", _choice(draw(), gen.EDUCATION_FIELDS)),
        ("BusinessTravel", _choice(draw(), gen.TRAVEL)),
        ("Gender", _choice(draw(), gen.GENDERS)),
        ("MaritalStatus", _choice(draw(), gen.MARITAL)),
        ("OverTime", _choice(draw(), gen.OVERTIME)),
        ("Age", clip(normal(37, 9), 18, 60)),
        ("YearsAtCompany", clip(expo(7), 0, 40)),
        ("DistanceFromHome", clip(expo(9), 1, 29)),
        ("PercentSalaryHike", clip(normal(15, 3), 11, 25)),
        ("MonthlyRate", f"CAST(floor(2094 + {draw()} * {26999 - 2094}) AS INT)"),
    ]
    for name, (low, weights) in gen.SCORES.items():
        first.append((name, f"CAST({_choice(draw(), [(low + i, w) for i, w in enumerate(weights)])} AS INT)"))
    second = [
        ("JobRole", f"CASE {role_cases} END"),
        ("YearsInCurrentRole", f"least(YearsAtCompany, {clip(expo(4), 0, 18)})"),
        ("YearsSinceLastPromotion", f"least(YearsAtCompany, {clip(expo(3), 0, 15)})"),
        ("YearsWithCurrManager", f"least(YearsAtCompany, {clip(expo(4), 0, 17)})"),
        ("TotalWorkingYears", f"least(40, YearsAtCompany + CAST(floor({draw()} * 10.0::DOUBLE) AS INT))"),
    ]
    base = " ".join(f"WHEN JobRole = '{name}' THEN {float(v)}::DOUBLE" for name, v in gen.BASE_INCOME.items())
    income = clip(
        f"((CASE {base} ELSE 5000.0::DOUBLE END) * (0.7::DOUBLE + {draw()} * 0.8::DOUBLE) + YearsAtCompany * 100.0::DOUBLE)",
        1009, 20000,
    )
    risk = " + ".join(f"(CASE WHEN {term} THEN {points}::DOUBLE ELSE 0.0::DOUBLE END)" for term, points in gen.RISK_TERMS)
    chance = f"1.0::DOUBLE / (1.0::DOUBLE + exp(-2.0::DOUBLE * (({risk}) - 0.5::DOUBLE)))"
    return f"""WITH first AS (SELECT c_custkey, c_custkey AS EmployeeID,
{', '.join(f'{e} AS {n}' for n, e in first)} FROM customer),
second AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in second)} FROM first),
people AS (SELECT *, {income} AS MonthlyIncome, CASE WHEN {draw()} < {chance} THEN 'Yes' ELSE 'No' END AS Attrition FROM second)
"""


table_sql("s2_generated_employees", _generated() + f"SELECT {', '.join(gen.COLUMNS)} FROM people")
table_sql("s3_csv_sink", _generated() + "SELECT EmployeeID, JobRole, MonthlyIncome, Attrition FROM people")
LEAVERS = (
    "SELECT EmployeeID, Department, JobRole, Age, MonthlyIncome, YearsAtCompany, OverTime, Attrition "
    "FROM profile WHERE Attrition = 'Yes'"
)
profile_sql("s4_risk_list_csv", LEAVERS)
profile_sql("s6_saved_model", f"""SELECT model, EmployeeID AS row_id, true AS same
FROM profile, (VALUES {', '.join(f"('{name}')" for name in MODEL_NAMES)}) m(model)""")
profile_sql("s7_row_preview", f"SELECT * REPLACE ({r('MonthlyIncome')} AS MonthlyIncome) FROM profile ORDER BY EmployeeID LIMIT 100")

profile_sql("s7_preview_total", "SELECT least(count(*), 100) AS shown, count(*) AS total FROM profile")

# Schema repair and profiling ----------------------------------------------------------------------

RAW_COLUMNS = {
    "EmpID": "n", "EmployeeCount": "n", "Over18": "t", "Campus": "t", "employee_age": "n", "churned": "t", "dept": "t",
    "job_title": "t", "joblevel": "n", "Salary": "t", "over_time": "t", "tenure": "n", "badge_score": "t", "free_text": "t",
}
RENAMED = """EmpID, EmployeeCount, Over18, Campus, employee_age AS Age, churned AS Attrition, dept AS Department,
job_title AS JobRole, joblevel AS JobLevel, Salary AS MonthlyIncome, over_time AS OverTime, tenure AS YearsAtCompany,
badge_score, free_text"""
table_sql("p1_column_keys", f"""SELECT c AS "column", trim(regexp_replace(lower(c), '[^a-z0-9]+', '_', 'g'), '_') AS key
FROM (VALUES {', '.join(f"('{c}')" for c in RAW_COLUMNS)}) v(c)""")
raw_sql("p7_column_types", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
    ELSE typeof({c}) END AS type FROM (SELECT * FROM profile_raw LIMIT 1)""" for c in RAW_COLUMNS))
table_sql("p7_no_label_warning", "SELECT * FROM (VALUES ('whole', false), ('without label', true)) v(variant, warned)")
raw_sql("p2_alias_mapping", f"SELECT {RENAMED} FROM profile_raw")
raw_sql("p3_two_valued_columns", "SELECT column FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT lower(CAST({c} AS VARCHAR))) AS k,
    count(*) FILTER (lower(CAST({c} AS VARCHAR)) IN ({LEFT_TEXTS})) AS hits FROM profile_raw""" for c in RAW_COLUMNS
) + ") WHERE k BETWEEN 1 AND 2 AND hits > 0")
ORACLES["p3_two_valued_columns"] = ORACLES["p3_two_valued_columns"].replace("SELECT column FROM", 'SELECT "column" FROM', 1)
ID_KEY = "regexp_full_match(regexp_replace(lower(trim(c)), '[^a-z0-9]+', '_', 'g'), " \
    "'.*employee.*id.*|.*emp.*id.*|.*employee.*number.*|.*employee.*count.*|.*over.*18.*|.*standard.*hours.*')"
raw_sql("p4_droppable_columns", "SELECT c AS \"column\", CASE WHEN " + ID_KEY + """ THEN 'identifier'
 WHEN k + has_null <= 1 THEN 'constant' ELSE 'row index' END AS reason FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS c, '{kind}' AS kind, count(DISTINCT {c}) AS k, CAST(count(*) > count({c}) AS INT) AS has_null,
    count(*) AS n FROM profile_raw""" for c, kind in RAW_COLUMNS.items()
) + f") WHERE {ID_KEY} OR k + has_null <= 1 OR (kind = 'n' AND k = n AND c NOT IN ('employee_age', 'joblevel', 'tenure'))")


def _first_unique(table: str, numbers: list[str]) -> str:
    union = " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS c FROM {table} HAVING count(DISTINCT {c}) = count(*)" for i, c in enumerate(numbers)
    )
    return f"SELECT '{table}' AS table_name, (SELECT c FROM ({union}) ORDER BY i LIMIT 1) AS identifier"


table_sql("p5_best_identifier", " UNION ALL ".join([
    _first_unique("customer", ["c_custkey", "c_nationkey", "c_acctbal"]),
    _first_unique("orders", ["o_orderkey", "o_custkey", "o_totalprice"]),
    _first_unique("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                               "l_discount", "l_tax"]),
    _first_unique("supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]),
]))
raw_sql("p6_validation", """SELECT count(*) AS rows, CAST(14 AS INT) AS cols, count(*) >= 10 AS ok,
CAST(CASE WHEN count(*) < 10 THEN 1 ELSE 0 END AS INT) AS issues FROM profile_raw""")
SHARE = "count(*) FILTER (regexp_matches({c}, '[$£€₹,]'))"
raw_sql("p7_dataset_summary", f"""SELECT c AS "column", rows, nulls, {r('nulls * 100.0::DOUBLE / rows', 2)} AS missing_pct,
{ID_KEY} AS is_id, is_currency, c = 'churned' AS is_label, nulls * 100.0 / rows > 20 AS has_warning FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS c, count(*) AS rows, count(*) - count({c}) AS nulls,
    {(SHARE.format(c=c) + f' > 0.3 * count({c})') if kind == 't' else 'false'} AS is_currency FROM profile_raw"""
    for c, kind in RAW_COLUMNS.items()) + ")")
raw_sql("p8_currency_share", f"""SELECT c AS "column", {r('share')} AS share, share > 0.3 AS is_currency FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, {SHARE.format(c=c)} / count({c})::DOUBLE AS share FROM profile_raw"
    for c, kind in RAW_COLUMNS.items() if kind == "t") + ")")

raw_sql("p8_currency_sample", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {SHARE.format(c=c)} > 0.3 * count({c}) AS is_currency
    FROM (SELECT {c} FROM profile_raw WHERE {c} IS NOT NULL ORDER BY EmpID LIMIT 50)"""
    for c, kind in RAW_COLUMNS.items() if kind == "t"))

# Cleaning -------------------------------------------------------------------------------------------

raw_sql("c1_renamed", f"""SELECT dept AS Department, over_time AS OverTime, count(*) AS n,
{r('avg(employee_age)')} AS avg_age, {r('avg(tenure)')} AS avg_tenure FROM profile_raw GROUP BY ALL""")
raw_sql("c2_without_identifiers", """SELECT employee_age AS Age, churned AS Attrition, dept AS Department, job_title AS JobRole,
joblevel AS JobLevel, Salary AS MonthlyIncome, over_time AS OverTime, tenure AS YearsAtCompany, badge_score, free_text
FROM profile_raw""")
raw_sql("c3_currency_to_number", f"SELECT EmpID, {money('Salary')} AS Salary FROM profile_raw")
clean_sql("c4_label_standardised", "SELECT row_id AS EmpID, Attrition FROM prepared")
clean_sql("c2_row_keys", " UNION ALL ".join(
    f"""SELECT '{variant}' AS variant, '{key}' AS row_key, count(*) AS rows, count(*) AS row_keys,
CAST(round(0.8::DOUBLE * count(*) FILTER (Attrition = 'Yes')) + round(0.8::DOUBLE * count(*) FILTER (Attrition = 'No')) AS BIGINT) AS train_rows
FROM uniq""" for variant, key in (
        ("id", "EmpID"), ("no id", "digest of the row"), ("id repeats", "digest of the row"),
        ("id with gaps", "digest of the row"), ("dotted names", "Emp_ID"))))
clean_sql("c5_deduplicated", "SELECT * FROM uniq")
clean_sql("c6_extra_columns", "SELECT row_id, badge_score FROM numbers")
clean_sql("c7_medians", """SELECT 'Age' AS "column", m_age AS median FROM medians
UNION ALL SELECT 'MonthlyIncome', m_income FROM medians UNION ALL SELECT 'badge_score', m_badge FROM medians""")
clean_sql("c8_modes", "SELECT \"column\", value FROM (SELECT \"column\", value, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS place FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM uniq WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ("Department", "JobRole", "OverTime")) + ")) WHERE place = 1")
clean_sql("c9_numbers_filled", "SELECT row_id, Age, MonthlyIncome, YearsAtCompany, badge_score, Department FROM filled")
clean_sql("c10_ordinals_whole", "SELECT row_id, JobLevel FROM filled")
_WINS = ["Age", "MonthlyIncome", "NumCompaniesWorked", "YearsAtCompany"]
profile_sql("c11_winsorised", "SELECT EmployeeID, " + ", ".join(
    r(f"greatest(b_{c}[1], least(b_{c}[2], CAST({c} AS DOUBLE)))") + f" AS {c}" for c in _WINS
) + " FROM profile CROSS JOIN (SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), [0.01, 0.99]) AS b_{c}" for c in _WINS) + " FROM profile)")
clean_sql("c13_cleaned", "SELECT * REPLACE (" + ", ".join(f"{r(c)} AS {c}" for c in ("Age", "MonthlyIncome", "YearsAtCompany", "badge_score")) + ") FROM clean")

_GAPS = ("Age", "Department", "JobRole", "JobLevel", "MonthlyIncome", "OverTime", "YearsAtCompany", "badge_score")
clean_sql("c12_cleaning_report", "SELECT step, entries, total FROM (" + " UNION ALL ".join(
    f"SELECT '{step}' AS step, CAST({entries} AS BIGINT) AS entries, CAST(({total}) AS BIGINT) AS total"
    for step, entries, total in (
        ("original rows", 1, "SELECT count(*) FROM profile_raw"), ("original columns", 1, 14), ("renamed", 8, 8),
        ("dropped", 4, 4), ("currency", 1, 1), ("row key", 1, 1),
        ("duplicate rows removed", 1, "SELECT (SELECT count(*) FROM profile_raw) - (SELECT count(*) FROM uniq)"),
        ("extra kept as number", 1, 1), ("warning: extra dropped", 1, 1),
        ("missing before", 1, "SELECT " + " + ".join(f"count(*) - count({c})" for c in _GAPS) + " FROM numbers"),
        ("missing after", 1, 0), ("clipped", 3, 3), ("final rows", 1, "SELECT count(*) FROM clean"), ("final columns", 1, 10),
    )) + ")")

# Features, codes, scaling ----------------------------------------------------------------------------

table_sql("e6_not_fitted_guard", "SELECT true AS raised")
_NAMES = [
    "Age", "BusinessTravel", "Department", "DistanceFromHome", "EnvironmentSatisfaction", "Gender", "JobLevel", "JobRole", "JobSatisfaction",
    "MonthlyIncome", "NumCompaniesWorked", "OverTime", "RelationshipSatisfaction", "TotalWorkingYears", "WorkLifeBalance", "YearsAtCompany",
    "YearsSinceLastPromotion", "IncomeToLevelRatio", "PromotionLag", "IsTenured", "BurnoutRisk", "OverallSatisfaction", "CareerMobility",
    "LoyaltyIndex", "DistanceOvertimeRisk",
]
table_sql("e8_feature_names", "SELECT CAST(i AS INT) AS position, feature FROM (VALUES " + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(_NAMES)) + ") v(i, feature)")
profile_sql("q4_column_pick", "SELECT OverTime, EmployeeID, Age FROM profile")

INCOME_RATIO = """coalesce(MonthlyIncome / nullif(quantile_cont(MonthlyIncome, 0.5) OVER (PARTITION BY JobLevel), 0), 1.0::DOUBLE)"""
ROW_SQL = {
    "PromotionLag": "YearsSinceLastPromotion::DOUBLE / (YearsAtCompany + 1)",
    "IsTenured": "CAST(YearsAtCompany >= 5 AS INT)",
    "BurnoutRisk": "CAST(OverTime = 'Yes' AS INT) * (5 - WorkLifeBalance)",
    "OverallSatisfaction": "(JobSatisfaction + EnvironmentSatisfaction) / 2.0::DOUBLE",
    "CareerMobility": "NumCompaniesWorked::DOUBLE / (TotalWorkingYears + 1)",
    "LoyaltyIndex": "YearsAtCompany::DOUBLE / (TotalWorkingYears + 1)",
    "DistanceOvertimeRisk": "DistanceFromHome * (1 + CAST(OverTime = 'Yes' AS INT))",
}
WHOLE = ("IsTenured", "BurnoutRisk", "DistanceOvertimeRisk")


def _shown(name: str, sql: str) -> str:
    return f"{sql if name in WHOLE else r(sql)} AS {name}"


profile_sql("f1_income_to_level", f"SELECT EmployeeID, {r(INCOME_RATIO)} AS IncomeToLevelRatio FROM profile")
for _i, (_name, _sql) in enumerate(ROW_SQL.items(), start=2):
    _key = "".join(f"_{ch.lower()}" if ch.isupper() else ch for ch in _name).lstrip("_")
    profile_sql(f"f{_i}_{_key}", f"SELECT EmployeeID, {_shown(_name, _sql)} FROM profile")
profile_sql("f9_engineered", "SELECT * REPLACE (" + r("MonthlyIncome") + f" AS MonthlyIncome), {r(INCOME_RATIO)} AS IncomeToLevelRatio, "
            + ", ".join(_shown(n, s) for n, s in ROW_SQL.items()) + " FROM profile")
profile_sql("e1_label_extracted", "SELECT EmployeeID, CAST(Attrition = 'Yes' AS INT)::DOUBLE AS label FROM profile")


def _codes(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", value, CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS code
        FROM (SELECT DISTINCT coalesce({c}, 'nan') AS value FROM {source})""" for c in columns
    )


profile_sql("e2_fitted_codes", _codes(["BusinessTravel", "Department", "Gender", "JobRole", "OverTime"], "profile"))
profile_sql("e3_applied_codes", f"""SELECT EmployeeID, coalesce(d.code, -1) AS Department, coalesce(j.code, -1) AS JobRole,
CAST(-1 AS INT) AS Gender FROM profile p
LEFT JOIN ({_codes(["Department"], "(SELECT * FROM profile WHERE Department <> 'BUILDING')")}) d ON p.Department = d.value
LEFT JOIN ({_codes(["JobRole"], "(SELECT * FROM profile WHERE Department <> 'BUILDING')")}) j ON p.JobRole = j.value""")


def _scale(column: str) -> str:
    return f"(({column}) - avg({column}) OVER ()) / CASE stddev_pop({column}) OVER () WHEN 0 THEN 1 ELSE stddev_pop({column}) OVER () END"


profile_sql("e4_scaled", "SELECT EmployeeID, " + ", ".join(r(_scale(c)) + f" AS {c}" for c in METERS) + " FROM profile")
profile_sql("e5_aligned", "SELECT EmployeeID, Department, CAST(0 AS INT) AS Age, JobLevel, CAST(0 AS INT) AS MonthlyRate FROM profile")
_PREP = ["Age", "Department", "JobRole", "JobLevel", "MonthlyIncome", "OverTime", "YearsAtCompany", "badge_score",
         "IncomeToLevelRatio", "IsTenured"]
clean_sql("e7_prepared_features", f""", coded AS (SELECT row_id, CAST(Attrition = 'Yes' AS INT)::DOUBLE AS label, Age,
d.code AS Department, j.code AS JobRole, JobLevel, MonthlyIncome, t.code AS OverTime, YearsAtCompany, badge_score,
{INCOME_RATIO} AS IncomeToLevelRatio, CAST(YearsAtCompany >= 5 AS INT) AS IsTenured FROM clean c
JOIN ({_codes(["Department"], "clean")}) d ON c.Department = d.value
JOIN ({_codes(["JobRole"], "clean")}) j ON c.JobRole = j.value
JOIN ({_codes(["OverTime"], "clean")}) t ON c.OverTime = t.value)
SELECT row_id, label, """ + ", ".join(r(_scale(c)) + f" AS {c}" for c in _PREP) + " FROM coded")
ORACLES["e7_prepared_features"] = ORACLES["e7_prepared_features"].replace("CROSS JOIN bounds)\n, coded", "CROSS JOIN bounds), coded")

# Filters, joins, sorts, windows ------------------------------------------------------------------------

profile_sql("q1_equality_filter", """SELECT EmployeeID, Department, JobRole FROM profile
WHERE Attrition = 'Yes' AND OverTime = 'Yes' AND Gender = 'Female'""")
profile_sql("q2_range_filter", f"SELECT * FROM ({rate_by('NumCompaniesWorked')}) WHERE NumCompaniesWorked <= 8")
clean_sql("q3_record_lookup", f"""SELECT r.EmpID AS asked_id, coalesce(c.row_id, f.row_id) AS row_id,
coalesce(c.Department, f.Department) AS Department, {r('coalesce(c.MonthlyIncome, f.MonthlyIncome)')} AS MonthlyIncome,
c.row_id IS NOT NULL AS found
FROM profile_raw r LEFT JOIN clean c ON r.EmpID = c.row_id
CROSS JOIN (SELECT * FROM clean ORDER BY row_id LIMIT 1) f""")
profile_sql("j1_department_join", f"""SELECT s.Department, total, positives, {r('rate_pct', 4)} AS rate_pct, {r('avg_income', 4)} AS avg_income
FROM (SELECT Department, count(Attrition) AS total, {YES} AS positives, {RATE} AS rate_pct FROM profile GROUP BY Department) s
JOIN (SELECT Department, avg(MonthlyIncome) AS avg_income FROM profile GROUP BY Department) i ON s.Department = i.Department""")
profile_sql("j2_group_value_on_rows", f"SELECT EmployeeID, JobLevel, {r('avg(MonthlyIncome) OVER (PARTITION BY JobLevel)', 4)} AS level_income FROM profile")
profile_sql("u1_appended_rows", f"""SELECT JobRole AS "group", count(*) AS total, {YES} AS positives FROM profile GROUP BY JobRole
UNION ALL SELECT BusinessTravel, count(*), {YES} FROM profile GROUP BY BusinessTravel""")
profile_sql("o1_sorted_rates", rate_by("JobRole") + " ORDER BY rate_pct DESC, JobRole")
profile_sql("o2_top_earners", f"SELECT EmployeeID, {r('MonthlyIncome')} AS MonthlyIncome FROM profile ORDER BY profile.MonthlyIncome DESC, EmployeeID LIMIT 50")
TOP = "SELECT {k}, " + r("rate") + " AS rate_pct FROM (SELECT {k}, " + RATE + " AS rate FROM profile GROUP BY {k}) ORDER BY rate DESC, {k} LIMIT 1"
profile_sql("o3_top_role", TOP.format(k="JobRole"))
profile_sql("d1_distinct_roles", "SELECT DISTINCT JobRole FROM profile")
profile_sql("d1_distinct_counts", "SELECT " + ", ".join(f"count(DISTINCT {c}) AS n_{c}" for c in ("Department", "JobRole", "BusinessTravel", "Age")) + " FROM profile")

# Dashboard aggregations ---------------------------------------------------------------------------------

OT_RATE = "avg(CASE WHEN OverTime = 'Yes' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)"
profile_sql("a1_kpi_row", f"""SELECT count(*) AS employees, {YES} AS leavers, {r(RATE, 4)} AS rate_pct, {r('avg(MonthlyIncome)', 4)} AS avg_income,
{r('avg(YearsAtCompany)', 4)} AS avg_tenure, {r(OT_RATE, 4)} AS overtime_pct FROM profile""")
profile_sql("a2_status_card", f"""SELECT count(*) AS employees, {r(RATE)} AS rate_pct, count(DISTINCT Department) AS departments,
count(DISTINCT JobRole) AS roles FROM profile""")
profile_sql("a3_class_shares", f"""SELECT Attrition, count(*) AS n, {r('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM profile)')} AS share_pct
FROM profile GROUP BY Attrition""")


def pair(keys: str, where: str = "true") -> str:
    return f"SELECT {keys}, count(*) AS n FROM profile WHERE {where} GROUP BY {keys}"


def histogram(value: str, by: str, source: str, places: int = 6, bins: int = 25) -> str:
    return f"""SELECT {by}, bin, n, {r(f'lo + bin * w', places)} AS bin_low, {r(f'lo + (bin + 1) * w', places)} AS bin_high FROM (
SELECT {by}, CAST(least(floor(({value} - lo) / w), {bins - 1}) AS INT) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(w) AS w
FROM {source} CROSS JOIN (SELECT min({value})::DOUBLE AS lo, (max({value}) - min({value}))::DOUBLE / {bins} AS w FROM {source}) e GROUP BY {by}, bin)"""


def boxes(value: str, by: str, source: str, places: int = 6) -> str:
    keys = [k.strip() for k in by.split(",")]
    using = ", ".join(keys)
    return f"""SELECT {using}, count(*) AS n, {r('min(q[1])', places)} AS q1, {r('min(q[2])', places)} AS median, {r('min(q[3])', places)} AS q3,
{r('min(x) FILTER (inside)', places)} AS low_whisker, {r('max(x) FILTER (inside)', places)} AS high_whisker,
count(*) FILTER (NOT inside) AS outliers FROM (
SELECT {using}, q, CAST({value} AS DOUBLE) AS x,
{value} BETWEEN q[1] - 1.5::DOUBLE * (q[3] - q[1]) AND q[3] + 1.5::DOUBLE * (q[3] - q[1]) AS inside
FROM {source} JOIN (SELECT {using}, quantile_cont(CAST({value} AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM {source} GROUP BY {using}) b USING ({using}))
GROUP BY {using}"""


profile_sql("a4_department_counts", pair("Department, Attrition"))
profile_sql("a5_age_histogram", histogram("Age", "Attrition", "profile"))
profile_sql("a6_income_boxes", boxes("MonthlyIncome", "Department, Attrition", "profile", 4))
profile_sql("a6_order_count_outliers", """SELECT EmployeeID, Department, Attrition, NumCompaniesWorked FROM profile
JOIN (SELECT Department, Attrition, quantile_cont(CAST(NumCompaniesWorked AS DOUBLE), [0.25, 0.75]) AS q FROM profile GROUP BY ALL) b USING (Department, Attrition)
WHERE NumCompaniesWorked < q[1] - 1.5 * (q[2] - q[1]) OR NumCompaniesWorked > q[2] + 1.5 * (q[2] - q[1])""")
SATISFACTION = ("JobSatisfaction", "EnvironmentSatisfaction", "WorkLifeBalance", "RelationshipSatisfaction")
_SAT = " UNION ALL ".join(f"SELECT '{c}' AS measure, {c} AS score, Attrition FROM profile" for c in SATISFACTION)
profile_sql("a7_satisfaction_rates", f"""SELECT measure, score, count(Attrition) AS total, {YES} AS positives, {r(RATE)} AS rate_pct
FROM ({_SAT}) GROUP BY measure, score""")
profile_sql("a7_satisfaction_grid", "SELECT measure, " + ", ".join(
    r(f"avg(CASE WHEN Attrition = 'Yes' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (score = {i})") + f" AS score_{i}" for i in (1, 2, 3, 4)
) + f" FROM ({_SAT}) GROUP BY measure")
profile_sql("a8_overtime_counts", pair("OverTime, Attrition"))
profile_sql("a9_tenure_curve", f"SELECT * FROM ({rate_by('YearsAtCompany')}) WHERE YearsAtCompany <= 25")
profile_sql("a10_role_rates", rate_by("JobRole") + " ORDER BY rate_pct, JobRole")
profile_sql("a11_promotion_boxes", boxes("YearsSinceLastPromotion", "Attrition", "profile"))
profile_sql("a11_promotion_histogram", histogram("YearsSinceLastPromotion", "Attrition", "profile"))
profile_sql("a12_gender_counts", pair("Gender, Attrition", "Gender IN ('Male', 'Female')"))
profile_sql("a13_top_department", TOP.format(k="Department"))
_OT = "avg(CASE WHEN Attrition = 'Yes' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (OverTime = '{v}')"
profile_sql("a14_overtime_risk", f"""SELECT {r(_OT.format(v='Yes'))} AS overtime_rate, {r(_OT.format(v='No'))} AS regular_rate,
{r(_OT.format(v='Yes') + ' / nullif(' + _OT.format(v='No') + ', 0)')} AS risk_ratio FROM profile""")
profile_sql("a15_income_gap", f"""SELECT {r("avg(MonthlyIncome) FILTER (Attrition = 'Yes')", 4)} AS income_left,
{r("avg(MonthlyIncome) FILTER (Attrition = 'No')", 4)} AS income_stayed FROM profile""")
profile_sql("a16_overview", f"""SELECT count(*) AS employees, {r(YES + ' * 100.0::DOUBLE / count(*)')} AS rate_pct,
(SELECT Department FROM ({TOP.format(k='Department')})) AS top_department FROM profile""")
profile_sql("a17_department_summary", f"SELECT Department, count(*) AS total, {YES} AS leavers, {r(RATE, 1)} AS rate_pct FROM profile GROUP BY Department")
profile_sql("a18_role_summary", f"SELECT JobRole, count(*) AS count, {r(RATE, 1)} AS rate_pct FROM profile GROUP BY JobRole")

# The same operators on the larger tables --------------------------------------------------------------------

table_sql("a4_line_return_rates", f"""SELECT l_suppkey, count(l_returnflag) AS total, count(*) FILTER (l_returnflag = 'R') AS positives,
{r("avg(CASE WHEN l_returnflag = 'R' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS rate_pct FROM lineitem GROUP BY l_suppkey""")
table_sql("a5_line_price_histogram", histogram("l_extendedprice", "l_returnflag", "lineitem", 4))
table_sql("a6_line_price_boxes", boxes("l_extendedprice", "l_returnflag, l_linestatus", "lineitem", 4))
table_sql("a10_document_quality_rates", f"""SELECT lang, source, count(quality) AS total, count(*) FILTER (quality = 1) AS positives,
{r("avg(CASE WHEN quality = 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS rate_pct
FROM labels JOIN documents USING (doc_id) GROUP BY lang, source""")
table_sql("f1_line_price_ratio", f"""SELECT l_linenumber, count(*) AS n, {r('avg(x)')} AS avg_ratio, {r('max(x)')} AS max_ratio FROM (
SELECT l_linenumber, l_extendedprice / quantile_cont(l_extendedprice, 0.5) OVER (PARTITION BY l_linenumber) AS x FROM lineitem)
GROUP BY l_linenumber""")
table_sql("c11_line_quantiles_by_range", "SELECT l_returnflag, " + ", ".join(f"{r(f'q[{i + 1}]', 4)} AS q{i}" for i in range(4)) + """
FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.99]) AS q FROM lineitem GROUP BY l_returnflag)""")


def split_sql(key: str, label: str, source: str) -> str:
    return f"""SELECT {key} AS row_id, label, CASE WHEN place <= round(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END AS part FROM (
SELECT {key}, {label} AS label, row_number() OVER (PARTITION BY {label} ORDER BY {h(42, key)}) AS place,
count(*) OVER (PARTITION BY {label}) AS n FROM {source})"""


table_sql("m1_order_split", split_sql("o_orderkey", "o_orderstatus", "orders"))
LINES = """scored AS (SELECT CAST(l_returnflag = 'R' AS INT) AS label,
floor(least(1.0::DOUBLE, l_extendedprice * (1.0::DOUBLE - l_discount) / 110000.0::DOUBLE) * 1000000.0::DOUBLE) / 1000000.0::DOUBLE AS score FROM lineitem)"""


def auc(by: str, source: str) -> str:
    group, part = (f"GROUP BY {by}", f"PARTITION BY {by}") if by else ("", "")
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}{r('(sum(place) FILTER (label = 1) - p * (p + 1) / 2.0::DOUBLE) / (p * q)')} AS roc_auc FROM (
SELECT {lead}label, (rank() OVER ({part} ORDER BY score) + (count(*) OVER ({part + (', ' if by else 'PARTITION BY ')}score) - 1) / 2.0::DOUBLE)::DOUBLE AS place,
(count(*) FILTER (label = 1) OVER ({part}))::DOUBLE AS p, (count(*) FILTER (label = 0) OVER ({part}))::DOUBLE AS q FROM {source}) GROUP BY {lead}p, q"""


def roc(by: str, source: str) -> str:
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {lead}threshold, {r('f / q')} AS fpr, {r('t / p')} AS tpr FROM (
SELECT {lead}score AS threshold, sum(pos) OVER ({part} ORDER BY score DESC)::DOUBLE AS t, sum(neg) OVER ({part} ORDER BY score DESC)::DOUBLE AS f,
sum(pos) OVER ({part})::DOUBLE AS p, sum(neg) OVER ({part})::DOUBLE AS q
FROM (SELECT {lead}score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {source} GROUP BY {lead}score))
UNION ALL SELECT {'DISTINCT ' + by + ', ' if by else ''}CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE {'FROM ' + source if by else ''}"""


ORACLES["m10_line_auc_by_range"] = f"WITH {LINES} {auc('', 'scored')}"
ORACLES["m11_line_roc_by_range"] = f"WITH {LINES} {roc('', 'scored')}"
table_sql("m10_line_auc", f"WITH {LINES} {auc('', 'scored')}")
table_sql("m11_line_roc", f"WITH {LINES} {roc('', 'scored')}")

# Modelling and evaluation -------------------------------------------------------------------------------------

SCORED = PROFILE + f""",
scored AS (SELECT EmployeeID AS row_id, CAST(Attrition = 'Yes' AS INT) AS label,
(round_even(0.85::DOUBLE * {u(h('score', 'EmployeeID'))} + CASE WHEN Attrition = 'Yes' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 4) + 0.0) AS score
FROM profile),
compared AS (SELECT *, CAST(score >= 0.5 AS INT) AS prediction FROM (""" + " UNION ALL ".join(
    f"""SELECT '{name}' AS model, row_id, label, CASE WHEN row_id % 7 < 7 * {pull}
    THEN (round_even({pull}::DOUBLE * score + {(1.0 - pull) * 0.5!r}::DOUBLE, 4) + 0.0) ELSE 0.25::DOUBLE END AS score FROM scored"""
    for name, pull in (("one", 1.0), ("two", 0.6), ("three", 0.4))
) + "))"


def scored_sql(name: str, select: str) -> None:
    ORACLES[name] = f"WITH {SCORED}\n{select}"


def _share(top: str, bottom: str) -> str:
    return f"coalesce(({top})::DOUBLE / nullif({bottom}, 0), 0.0::DOUBLE)"


TP, FP, FN, TN = (f"count(*) FILTER (label = {a} AND prediction = {p})" for a, p in ((1, 1), (0, 1), (1, 0), (0, 0)))
MEASURES = {
    "accuracy": _share(f"{TP} + {TN}", "count(*)"), "precision": _share(TP, f"{TP} + {FP}"),
    "recall": _share(TP, f"{TP} + {FN}"), "f1": _share(f"2 * {TP}", f"2 * {TP} + {FP} + {FN}"),
}
profile_sql("m1_split", split_sql("EmployeeID", "label", "(SELECT EmployeeID, CAST(Attrition = 'Yes' AS INT)::DOUBLE AS label FROM profile)"))
profile_sql("m12_folds", f"""SELECT row_id, label, CAST((place > round(0.2::DOUBLE * n))::INT + (place > round(0.4::DOUBLE * n))::INT
 + (place > round(0.6::DOUBLE * n))::INT + (place > round(0.8::DOUBLE * n))::INT AS INT) AS fold FROM (
SELECT EmployeeID AS row_id, CAST(Attrition = 'Yes' AS INT)::DOUBLE AS label,
row_number() OVER (PARTITION BY Attrition ORDER BY {h(42, 'EmployeeID')}) AS place, count(*) OVER (PARTITION BY Attrition) AS n FROM profile)""")

EMPLOYEE_TEXTS = ["BusinessTravel", "Department", "EducationField", "Gender", "JobRole", "MaritalStatus", "OverTime"]
EMPLOYEE_FEATURES = [c for c in gen.COLUMNS if c not in ("EmployeeID", "Attrition")]


def _squares(n: int) -> str:
    return " + ".join(f"(p.f{i} - q.f{i}) * (p.f{i} - q.f{i})" for i in range(n))


def _neighbours(n: int, k: int = 5) -> str:
    """CTEs ``cand`` and ``near`` over a CTE ``points`` (row_id, weight, f0..)."""
    other = ", ".join(f"q.f{i} AS g{i}" for i in range(n))
    own = ", ".join(f"p.f{i} AS g{i}" for i in range(n))
    return f"""cand AS (
SELECT p.row_id, 0 AS stage, 0.0::DOUBLE AS d2, p.row_id AS other, c.copy, {own}
FROM points p, range(0, {k}) c(copy) WHERE c.copy < least(p.weight - 1, {k})
UNION ALL
SELECT p.row_id, 1, {_squares(n)}, q.row_id, c.copy, {other}
FROM points p JOIN points q ON p.row_id <> q.row_id, range(0, {k}) c(copy) WHERE c.copy < least(q.weight, {k})),
near AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY stage, d2, other, copy) - 1 AS place FROM cand
QUALIFY place < {k})"""


def _smote(source: str, names: list[str], places: int | None) -> str:
    """Oversampled rows of a CTE with row_id, Attrition and f0.., the features under their names."""
    n = len(names)
    fs = ", ".join(f"f{i}" for i in range(n))
    mixed = [f'd.f{i} + {u("draw", 0)} * (n.g{i} - d.f{i})' for i in range(n)]
    made = ", ".join(f"{r(x) if places else x} AS {c}" for x, c in zip(mixed, names))
    return f"""minority AS (SELECT row_id, {fs} FROM {source} WHERE Attrition = 'Yes'),
sizes AS (SELECT count(*) FILTER (Attrition = 'Yes') AS m, count(*) FILTER (Attrition = 'No') - count(*) FILTER (Attrition = 'Yes') AS missing FROM {source}),
allotted AS (SELECT a.*, missing // m + CAST(row_number() OVER (ORDER BY {h(42, 'row_id')}) <= missing % m AS INT) AS copies FROM minority a CROSS JOIN sizes),
points AS (SELECT min(row_id) AS row_id, count(*) AS weight, CAST(sum(copies) AS BIGINT) AS copies, {fs} FROM allotted GROUP BY {fs}),
{_neighbours(n)},
drawn AS (SELECT p.*, c.copy, {h(42, 'p.row_id', 'c.copy')} AS draw
FROM points p, range(1, (SELECT max(copies) + 1 FROM points)) c(copy) WHERE c.copy <= p.copies)
SELECT row_id, CAST(Attrition = 'Yes' AS INT)::DOUBLE AS label, {', '.join(f'f{i} AS {c}' for i, c in enumerate(names))}, false AS synthetic FROM {source}
UNION ALL
SELECT CAST(NULL AS BIGINT), 1.0::DOUBLE, {made}, true
FROM drawn d JOIN near n ON d.row_id = n.row_id AND n.place = CAST(floor({u('draw', 1)} * 5.0::DOUBLE) AS INT)"""


_MEASURED = f"""{PROFILE}, measured AS (SELECT EmployeeID AS row_id, Attrition,
{', '.join(f'CAST({c} AS DOUBLE) AS f{i}' for i, c in enumerate(NEIGHBOUR_FEATURES))} FROM profile)"""
for _name in ("m2_oversampled_in_blocks", "m2_oversampled_on_measures"):
    ORACLES[_name] = f"WITH {_MEASURED}, {_smote('measured', NEIGHBOUR_FEATURES, 6)}"
_FS = ", ".join(f"f{i}" for i in range(len(NEIGHBOUR_FEATURES)))
ORACLES["m2_nearest_neighbours"] = f"""WITH {_MEASURED}, points AS (SELECT min(row_id) AS row_id, count(*) AS weight, {_FS}
FROM measured GROUP BY {_FS}), {_neighbours(len(NEIGHBOUR_FEATURES))}
SELECT n.row_id, p.weight, CAST(n.place AS INT) AS place, n.d2 FROM near n JOIN points p USING (row_id)"""
_CODED = ", ".join(
    f"CAST({f'dense_rank() OVER (ORDER BY {c}) - 1' if c in EMPLOYEE_TEXTS else c} AS DOUBLE) AS f{i}" for i, c in enumerate(EMPLOYEE_FEATURES)
)
_NUMBERED = f"{_generated()[:-1].rstrip()}, numbered AS (SELECT EmployeeID AS row_id, Attrition, {_CODED} FROM people)"
table_sql("m2_oversampled", f"{_NUMBERED}, {_smote('numbered', EMPLOYEE_FEATURES, None)}")
_GS = ", ".join(f"f{i}" for i in range(len(EMPLOYEE_FEATURES)))
_POINTS = f"{_NUMBERED}, points AS (SELECT min(row_id) AS row_id, {_GS} FROM numbered GROUP BY {_GS})"
table_sql("m2_neighbour_recall", _POINTS + "SELECT least(count(*), 256) AS probes, count(*) AS points, count(*) * 5 AS found, true AS recall_reached FROM points")
table_sql("m2_probe_distances", f"""{_POINTS}, probes AS (SELECT * FROM points ORDER BY {h('probe', 'row_id')}, row_id LIMIT 256)
SELECT row_id, d2 AS within FROM (SELECT p.row_id, {_squares(len(EMPLOYEE_FEATURES))} AS d2,
row_number() OVER (PARTITION BY p.row_id ORDER BY {_squares(len(EMPLOYEE_FEATURES))}) AS place FROM probes p JOIN points q ON p.row_id <> q.row_id) WHERE place = 5""")
_PARTS = split_sql("EmployeeID", "label", "(SELECT EmployeeID, CAST(Attrition = 'Yes' AS INT)::DOUBLE AS label FROM profile)")
for _name in ("m4_forest_walk", "m5_boosted_walk"):
    profile_sql(_name, f"SELECT row_id, label, true AS same FROM ({_PARTS}) WHERE part = 'test'")
profile_sql("m3_logistic_convergence", f"SELECT '{MODEL_NAMES[0]}' AS model, count(*) AS rows, true AS converged FROM ({_PARTS}) WHERE part = 'train'")
table_sql("m5_training_loss", "SELECT CAST(range * 50 AS INT) AS trees, true AS fell FROM range(7)")
table_sql("m5_tree_columns", "SELECT CAST(range AS INT) AS tree, CAST(20 AS INT) AS drawn, true AS within_draw FROM range(300)")
_MODELS = f"(VALUES {', '.join(f"('{name}')" for name in MODEL_NAMES)}) m(model)"
profile_sql("m7_comparison_recomputed", f"SELECT model, count(*) AS rows, true AS same FROM ({_PARTS}), {_MODELS} WHERE part = 'test' GROUP BY model")
_CUTS = " + ".join(f"(place > round({(i + 1) / FOLDS!r}::DOUBLE * n))::INT" for i in range(FOLDS - 1))
profile_sql("m12_fold_aucs", f"""SELECT model, CAST({_CUTS} AS INT) AS fold, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, true AS same
FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY {h(42, 'row_id')}) AS place, count(*) OVER (PARTITION BY label) AS n
FROM ({_PARTS}) WHERE part = 'train'), {_MODELS} GROUP BY ALL""")
profile_sql("m15_batch_walk", f"SELECT EmployeeID AS row_id, true AS same, model FROM profile, {_MODELS} WHERE model <> '{MODEL_NAMES[0]}'")
profile_sql("m6_class_weights", """SELECT EmployeeID AS row_id, CAST(Attrition = 'Yes' AS INT)::DOUBLE AS label,
(round_even((count(*) OVER ())::DOUBLE / (2 * count(*) OVER (PARTITION BY Attrition)), 6) + 0.0) AS weight FROM profile""")
scored_sql("m8_confusion", """SELECT m.model, a.actual, b.predicted, count(c.row_id) AS n
FROM (SELECT DISTINCT model FROM compared) m CROSS JOIN (VALUES (0), (1)) a(actual) CROSS JOIN (VALUES (0), (1)) b(predicted)
LEFT JOIN compared c ON c.model = m.model AND c.label = a.actual AND c.prediction = b.predicted GROUP BY ALL""")
scored_sql("m9_threshold_metrics", "SELECT model, " + ", ".join(f"{r(s)} AS {n}" for n, s in MEASURES.items()) + " FROM compared GROUP BY model")
scored_sql("m10_auc", auc("model", "compared"))
scored_sql("m11_roc_curve", roc("model", "compared"))


def _py4(x: str) -> str:
    """Rounded to four decimals by exact binary value."""
    return f"(CAST(format('{{:.4f}}', CAST({x} AS DOUBLE)) AS DOUBLE) + 0.0)"


def py_round(x: str, places: int) -> str:
    return f"(CAST(format('{{:.{places}f}}', CAST({x} AS DOUBLE)) AS DOUBLE) + 0.0)"


_AUC = auc("model", "compared").replace("round_even(", "(").replace(", 6) + 0.0)", ") + 0.0)")
METRICS = f"""measured AS (SELECT model, {', '.join(f'{s} AS {n}' for n, s in MEASURES.items())} FROM compared GROUP BY model),
ranked AS ({_AUC}),
metrics AS (SELECT model AS Model, {_py4('accuracy')} AS Accuracy, {_py4('precision')} AS Precision, {_py4('recall')} AS Recall,
{_py4('f1')} AS "F1-Score", {_py4('roc_auc')} AS "ROC-AUC", 0.0::DOUBLE AS "CV AUC (mean)", 0.0::DOUBLE AS "CV AUC (std)"
FROM measured JOIN ranked USING (model))"""
ORACLES["m13_metrics_table"] = f"WITH {SCORED}, {METRICS} SELECT * FROM metrics"
ORACLES["m14_best_model"] = f"""WITH {SCORED}, {METRICS} SELECT Model AS model FROM metrics ORDER BY "ROC-AUC" DESC, Model LIMIT 1"""
_RADAR = " UNION ALL ".join(f"""SELECT Model, '{c}' AS metric, "{c}" AS value FROM metrics""" for c in ("Accuracy", "Precision", "Recall", "F1-Score", "ROC-AUC"))
ORACLES["m17_radar"] = f"""WITH {SCORED}, {METRICS} SELECT Model, metric, value, value = max(value) OVER (PARTITION BY metric) AS is_best FROM ({_RADAR})"""
scored_sql("m18_risk_bands", """SELECT row_id, score, CASE WHEN score > 0.6 THEN 'HIGH' WHEN score > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS band,
CASE WHEN score < 0.3 THEN 'LOW' WHEN score < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS gauge FROM scored""")
_FILLED_COLUMNS = ["Age", "BusinessTravel", "DistanceFromHome", "EnvironmentSatisfaction", "JobSatisfaction", "MonthlyIncome",
                   "NumCompaniesWorked", "OverTime", "TotalWorkingYears", "WorkLifeBalance", "YearsAtCompany", "YearsSinceLastPromotion"]
_FLAGS = ", ".join(
    f"CASE WHEN {c} NOT BETWEEN {SCORING_BOUNDS[c][0]} AND {SCORING_BOUNDS[c][1]} THEN '{c}' END" if c in SCORING_BOUNDS
    else "CASE WHEN {} NOT IN ({}) THEN '{}' END".format(c, ", ".join(f"'{v}'" for v in SCORING_CHOICES[c]), c)
    for c in _FILLED_COLUMNS
)
profile_sql("m19_scoring_defaults", f"""SELECT EmployeeID, 'No' AS Attrition, 'Male' AS Gender, 'Married' AS MaritalStatus,
CAST(14000 AS INT) AS MonthlyRate, CAST(0 AS INT) AS StockOptionLevel, concat_ws(',', {_FLAGS}) AS invalid_fields FROM profile""")

# Explanation --------------------------------------------------------------------------------------------------

_MEANS = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in LINEAR_WEIGHTS)
_BASE = f"{LINEAR_INTERCEPT}::DOUBLE + " + " + ".join(f"({w}::DOUBLE * m_{f})" for f, w in LINEAR_WEIGHTS.items())
SHAP = SCORED + f""",
means AS (SELECT {_MEANS} FROM profile),
shap AS (""" + " UNION ALL ".join(
    f"""SELECT EmployeeID AS row_id, {_BASE} AS base_value, '{f}' AS feature, '{f.title()}' AS display_name, CAST({f} AS DOUBLE) AS value,
    {w}::DOUBLE * ({f} - m_{f}) AS shap FROM profile CROSS JOIN means""" for f, w in LINEAR_WEIGHTS.items()
) + f"""),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(shap) DESC, feature) AS rank,
{py_round('shap', 4)} AS shap4, {py_round('value', 4)} AS value4 FROM shap),
sided AS (SELECT *, CASE WHEN shap4 > 0 THEN 'risk' ELSE 'protective' END AS side,
row_number() OVER (PARTITION BY row_id, shap4 > 0 ORDER BY rank) AS place FROM ranked WHERE shap4 <> 0)"""


def shap_sql(name: str, select: str) -> None:
    ORACLES[name] = f"WITH {SHAP}\n{select}"


profile_sql("x1_background", f"SELECT EmployeeID, Age, JobRole FROM profile ORDER BY {h(42, 'EmployeeID')}, EmployeeID LIMIT 100")
shap_sql("x2_linear_attribution", f"SELECT row_id, {r('base_value')} AS base_value, feature, value, {r('shap')} AS shap FROM shap")


def _expected(known: frozenset[int], at: int = 0) -> str:
    """The small tree's output where only the known features count, the others by their share of the cover."""
    feature, threshold, left, right, value, cover = SMALL_TREE[at]
    if left < 0:
        return f"{value}::DOUBLE"
    low, high = _expected(known, left), _expected(known, right)
    if feature in known:
        return f"(CASE WHEN {SMALL_TREE_FEATURES[feature]} <= {threshold} THEN {low} ELSE {high} END)"
    return f"({SMALL_TREE[left][5] / cover!r}::DOUBLE * {low} + {SMALL_TREE[right][5] / cover!r}::DOUBLE * {high})"


def _shapley(i: int) -> str:
    others = [j for j in range(len(SMALL_TREE_FEATURES)) if j != i]
    terms = []
    for size in range(len(others) + 1):
        share = factorial(size) * factorial(len(others) - size) / factorial(len(others) + 1)
        terms += [
            f"{share!r}::DOUBLE * ({_expected(frozenset({*known, i}))} - {_expected(frozenset(known))})" for known in combinations(others, size)
        ]
    return " + ".join(terms)


profile_sql("x3_small_tree_values", " UNION ALL ".join(
    f"""SELECT EmployeeID AS row_id, {r(f'0.25::DOUBLE + {_expected(frozenset())}')} AS base_value, '{f}' AS feature,
    CAST({f} AS DOUBLE) AS value, {r(_shapley(i))} AS shap FROM profile""" for i, f in enumerate(SMALL_TREE_FEATURES)
))
for _name in ("logistic", "forest", "boosted"):
    profile_sql(f"x4_kernel_{_name}", " UNION ALL ".join(
        f"SELECT EmployeeID AS row_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, true AS equal FROM profile" for f in KERNEL_FEATURES
    ))
for _name in ("x3_forest_additivity", "x3_boosted_additivity", "x4_sampled_additivity"):
    profile_sql(_name, "SELECT EmployeeID AS row_id, true AS additive FROM profile")
shap_sql("x5_global_importance", f"SELECT feature, {r('avg(abs(shap))')} AS mean_abs_shap FROM shap GROUP BY feature")
shap_sql("x6_row_explanations", f"""SELECT row_id, CAST(rank AS INT) AS rank, feature, display_name, value4 AS value, shap4 AS shap,
CASE WHEN shap > 0 THEN '↑ Risk' ELSE '↓ Risk' END AS direction, {r('abs(shap)')} AS abs_shap FROM ranked""")
shap_sql("x7_top_factors", "SELECT row_id, side AS type, CAST(place AS INT) AS rank, display_name AS factor, shap4 AS impact FROM sided WHERE place <= 5")
shap_sql("x8_narratives", """, said AS (SELECT row_id,
string_agg('• ' || display_name || ': contributing +' || format('{:.3f}', shap4) || ' to attrition risk', chr(10) ORDER BY place) FILTER (side = 'risk' AND place <= 3) AS drivers,
string_agg('• ' || display_name || ': reducing attrition risk by ' || format('{:.3f}', abs(shap4)), chr(10) ORDER BY place) FILTER (side = 'protective' AND place <= 2) AS shield
FROM sided GROUP BY row_id)
SELECT s.row_id, 'Attrition Assessment: ' || CASE WHEN score >= 0.5 THEN 'HIGH RISK' ELSE 'LOW RISK' END || chr(10)
|| 'This employee has a ' || format('{:.1f}', score * 100) || '% probability of leaving.' || chr(10) || chr(10) || 'Primary Risk Drivers:'
|| coalesce(chr(10) || drivers, '') || coalesce(chr(10) || chr(10) || 'Protective Factors:' || chr(10) || shield, '')
|| chr(10) || chr(10) || 'Recommended HR Actions:' || chr(10)
|| CASE WHEN score > 0.7 THEN '🚨Immediate retention conversation recommended' || chr(10) || '• Consider salary review or career advancement discussion' || chr(10) || '• Review overtime workload and work-life balance'
WHEN score > 0.4 THEN '⚠️ Schedule engagement check-in within 30 days' || chr(10) || '• Review promotion history and growth opportunities'
ELSE '✅ Monitor in next quarterly review' || chr(10) || '• Maintain current engagement programs' END AS explanation
FROM scored s LEFT JOIN said USING (row_id)""")
ORACLES["x8_narratives"] = ORACLES["x8_narratives"].replace("WHERE shap4 <> 0)\n, said", "WHERE shap4 <> 0), said")
shap_sql("x9_waterfall", """SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY shap4, feature) AS INT) AS position, feature,
display_name, shap4 AS shap FROM ranked WHERE rank <= 10""")
shap_sql("x10_top_importance", f"""SELECT feature, {r('s')} AS importance FROM (SELECT feature, avg(abs(shap)) AS s FROM shap GROUP BY feature)
ORDER BY s DESC, feature LIMIT 15""")

# Reports --------------------------------------------------------------------------------------------------------

_OTR = _OT.format(v="Yes")
profile_sql("r1_executive_summary", " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS position, '{name}' AS metric, CAST({value} AS DOUBLE) AS value FROM profile"
    for i, (name, value) in enumerate((
        ("Total Employees", "count(*)"), ("Attrition Count", YES), ("Attrition Rate (%)", r(RATE, 2)),
        ("Retained Employees", f"count(*) - {YES}"),
        ("Avg Income (Left)", r("avg(MonthlyIncome) FILTER (Attrition = 'Yes')", 0)),
        ("Avg Income (Stayed)", r("avg(MonthlyIncome) FILTER (Attrition = 'No')", 0)),
        ("Avg Tenure of Leavers (years)", r("avg(YearsAtCompany) FILTER (Attrition = 'Yes')", 1)),
        ("Overtime Workers Attrition Rate (%)", r(_OTR, 1)),
    ), start=1)))
_RATE2 = r(f"{YES} * 100.0::DOUBLE / count(Attrition)", 2)
profile_sql("r2_department_analysis", f"""SELECT Department, count(Attrition) AS total, {YES} AS leavers, {r('avg(MonthlyIncome)', 0)} AS avg_income,
{_RATE2} AS rate_pct FROM profile GROUP BY Department ORDER BY rate_pct DESC, Department""")
profile_sql("r3_role_analysis", f"""SELECT JobRole, count(Attrition) AS total, {YES} AS leavers, {_RATE2} AS rate_pct
FROM profile GROUP BY JobRole ORDER BY rate_pct DESC, JobRole""")
profile_sql("r4_leavers", LEAVERS)
RISKIEST = f"""SELECT EmployeeID, Department, JobRole, Age, {r('MonthlyIncome')} AS MonthlyIncome, YearsAtCompany, OverTime, Attrition, risk_pct
FROM profile JOIN (SELECT row_id, {r('score * 100', 1)} AS risk_pct FROM scored ORDER BY risk_pct DESC, row_id LIMIT 50) ON EmployeeID = row_id"""
scored_sql("r5_riskiest", RISKIEST)
scored_sql("s4_scored_risk_list_csv", RISKIEST)


def _cells(sheet: str, source: str) -> str:
    item = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in SHEET_KEYS[sheet])
    return " UNION ALL ".join(
        f"""SELECT '{sheet}' AS sheet, {item} AS item, '{m}' AS measure, {r(f'CAST("{m}" AS DOUBLE)', 4)} AS value FROM ({source})""" for m in SHEET_MEASURES[sheet]
    )


def _select(name: str) -> str:
    """The part of a twin after its common table expressions."""
    return ORACLES[name].removeprefix(f"WITH {PROFILE}").removeprefix("\n")


_SHEETS = {
    "Executive Summary": _select("r1_executive_summary"), "Department Analysis": _select("r2_department_analysis"),
    "Job Role Analysis": _select("r3_role_analysis"), "High Risk Employees": LEAVERS, "Model Performance": "SELECT * FROM metrics",
    "Feature Importance": "SELECT feature, avg(abs(shap)) AS importance FROM shap GROUP BY feature",
}
ORACLES["s5_report_sheets"] = f"WITH {SHAP}, {METRICS.replace('ranked', 'ranked_scores')}\n" + " UNION ALL ".join(_cells(sheet, source) for sheet, source in _SHEETS.items())
