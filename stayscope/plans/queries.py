"""Registered queries: every operator applied to whole driver tables.

Keys start with the operator's identifier in the survey. Results are rounded where engines may
differ in the last digits.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from stayscope.functions.expr import has_currency_mark, money_to_number
from stayscope.functions.ranges import column_quantiles, exact_quantiles
from stayscope.operators import (
    boosting, clean as cleaning, distribution, encode, explain, features, forest, metrics, models, oversample,
    profile as profiling, rates, report, scoring, split, treewalk,
)
from stayscope.operators.neighbours import nearest
from stayscope.plans import lifecycle, workforce
from stayscope.plans.preparation import Preparation
from stayscope.schema import column_key
from stayscope.session import lookup_table, materialise, scratch_path
from stayscope.sources import generator, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Weights of the fixed linear model behind the explanation queries.
LINEAR_WEIGHTS = {
    "Age": -0.03, "DistanceFromHome": 0.02, "EnvironmentSatisfaction": -0.25, "JobLevel": -0.1,
    "JobSatisfaction": -0.3, "NumCompaniesWorked": 0.08, "TotalWorkingYears": -0.05, "WorkLifeBalance": -0.2,
    "YearsAtCompany": 0.15, "YearsSinceLastPromotion": 0.12,
}
LINEAR_INTERCEPT = 1.25
NEIGHBOUR_FEATURES = ["Age", "DistanceFromHome", "JobLevel", "YearsAtCompany"]
METERS = ["Age", "DistanceFromHome", "MonthlyIncome", "NumCompaniesWorked", "TotalWorkingYears", "YearsAtCompany",
          "YearsSinceLastPromotion"]


def query(name: str) -> Callable[[Query], Query]:
    def keep(make: Query) -> Query:
        QUERIES[name] = make
        return make

    return keep


def on_profile(name: str, places: int = 6) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Register a function of the clean personnel view, doubles rounded."""

    def keep(make: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(make(workforce.profile(spark, folder)), places)
        return make

    return keep


def on_raw(name: str, places: int = 6) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Register a function of the dirty personnel view, doubles rounded."""

    def keep(make: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(make(workforce.profile_raw(spark, folder)), places)
        return make

    return keep


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.bround(F.col(f"`{c}`"), places) for c in doubles})


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_table(spark, folder, "lineitem")


# Sources and sinks -----------------------------------------------------------------------------


@query("s1_csv_source")
def _(spark, folder):
    people = workforce.profile(spark, folder)
    path = scratch_path(spark, "csv")
    tables.write_csv(people, path)
    return tables.read_csv(spark, path, people.schema)


@query("s2_generated_employees")
def _(spark, folder):
    return generator.employees_for(tables.read_table(spark, folder, "customer"), "c_custkey")


@query("s3_csv_sink")
def _(spark, folder):
    people = generator.employees_for(tables.read_table(spark, folder, "customer"), "c_custkey")
    path = scratch_path(spark, "csv")
    tables.write_csv(people, path)
    return tables.read_csv(spark, path, people.schema).select("EmployeeID", "JobRole", "MonthlyIncome", "Attrition")


@query("s4_risk_list_csv")
def _(spark, folder):
    people = workforce.profile(spark, folder)
    path = scratch_path(spark, "csv")
    tables.write_risk_list(people, path)
    return tables.read_csv(spark, path, report.leavers(people).schema)


@on_profile("s4_scored_risk_list_csv")
def _(people):
    spark = people.sparkSession
    scores = workforce.scored(people).select(F.col("row_id").alias("EmployeeID"), "score")
    path = scratch_path(spark, "csv")
    tables.write_risk_list(people, path, scores)
    return tables.read_csv(spark, path, report.riskiest(people, scores).schema)


SHEET_KEYS = {
    "Executive Summary": ["metric"], "Department Analysis": ["Department"], "Job Role Analysis": ["JobRole"],
    "High Risk Employees": ["EmployeeID", "Department", "JobRole", "OverTime", "Attrition"], "Model Performance": ["Model"],
    "Feature Importance": ["feature"],
}
SHEET_MEASURES = {
    "Executive Summary": ["value"], "Department Analysis": ["total", "leavers", "avg_income", "rate_pct"],
    "Job Role Analysis": ["total", "leavers", "rate_pct"], "High Risk Employees": ["Age", "MonthlyIncome", "YearsAtCompany"],
    "Model Performance": ["Accuracy", "Precision", "Recall", "F1-Score", "ROC-AUC", "CV AUC (mean)", "CV AUC (std)"],
    "Feature Importance": ["importance"],
}


@query("s5_report_sheets")
def _(spark, folder):
    """All six sheets as a reader finds them, one row per cell."""
    people = workforce.profile(spark, folder)
    scored = metrics.metrics_table(metrics.evaluate(_model_scores(people)))
    importance = explain.global_importance(_explained(people)).withColumnRenamed("mean_abs_shap", "importance")
    path = scratch_path(spark, "report")
    tables.write_report(people, path, scored, importance)
    cells = []
    for sheet, table in tables.read_report(spark, path).items():
        item = F.concat_ws("|", *[F.col(c).cast("string") for c in SHEET_KEYS[sheet]])
        measures = [F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").cast("double").alias("value")) for m in SHEET_MEASURES[sheet]]
        cells.append(table.select(F.lit(sheet).alias("sheet"), item.alias("item"), F.explode(F.array(*measures)).alias("m")).select("sheet", "item", "m.*"))
    out = cells[0]
    for one in cells[1:]:
        out = out.unionByName(one)
    return rounded(out, 4)


def same_scores(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether each row's score is the same. Both sides are as large as the table, so neither goes through the driver."""
    return before.join(after.hint("merge"), "row_id").select("row_id", (F.col("before") == F.col("after")).alias("same"))


@query("s6_saved_model")
def _(spark, folder):
    """All three models, saved, loaded and applied to the whole table."""
    fits = [fitted(spark, folder, name) for name in MODEL_NAMES]
    path = scratch_path(spark, "models")
    models.save_models({fit.name: fit.model for fit in fits}, path)
    shown = []
    for fit in fits:
        before = models.score(fit.model, fit.table, fit.features).select("row_id", F.col("score").alias("before"))
        loaded = models.load_model(path, fit.name)
        after = models.score(loaded, fit.table, fit.features).select("row_id", F.col("score").alias("after"))
        shown.append(same_scores(before, after).select(F.lit(fit.name).alias("model"), "row_id", "same"))
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@on_profile("s7_row_preview")
def _(people):
    return report.preview(people, "EmployeeID")


on_profile("s7_preview_total")(report.preview_total)

# Schema repair and profiling ---------------------------------------------------------------------


@on_raw("p1_column_keys")
def _(raw):
    return raw.sparkSession.createDataFrame([(c, column_key(c)) for c in raw.columns], "column string, key string")


@on_raw("p2_alias_mapping")
def _(raw):
    return profiling.rename_spellings(raw)


@on_raw("p3_two_valued_columns")
def _(raw):
    found = profiling.two_valued_columns(raw, profiling.profile_table(raw))
    return raw.sparkSession.createDataFrame([(c,) for c in found], "column string")


@on_raw("p4_droppable_columns")
def _(raw):
    found = profiling.droppable_columns(raw)
    return raw.sparkSession.createDataFrame(list(found.items()), "column string, reason string")


@query("p5_best_identifier")
def _(spark, folder):
    found = [
        (name, profiling.best_identifier(tables.read_table(spark, folder, name)))
        for name in ("customer", "orders", "lineitem", "supplier")
    ]
    return spark.createDataFrame(found, "table_name string, identifier string")


@on_raw("p6_validation")
def _(raw):
    profile = profiling.profile_table(raw)
    ok, issues = profiling.validate(raw, profile)
    rows = next(iter(profile.values())).rows
    return raw.sparkSession.createDataFrame(
        [(rows, len(raw.columns), ok, len(issues))], "rows bigint, cols int, ok boolean, issues int"
    )


@on_raw("p7_dataset_summary")
def _(raw):
    return profiling.summarise(raw).select(
        "column", "rows", "nulls", "missing_pct", "is_id", "is_currency", "is_label",
        F.col("warning").isNotNull().alias("has_warning"),
    )


@on_raw("p7_column_types")
def _(raw):
    return profiling.summarise(raw).select("column", "type")


@on_raw("p7_no_label_warning")
def _(raw):
    """The summary of a table without a label column warns; that of the whole table does not."""
    rows = []
    for name, table in (("whole", raw), ("without label", raw.drop("churned", "over_time", "EmployeeCount", "Over18"))):
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            profiling.summarise(table)
        rows.append((name, any("no label column" in str(w.message) for w in said)))
    return raw.sparkSession.createDataFrame(rows, "variant string, warned boolean")


@on_raw("p8_currency_share")
def _(raw):
    texts = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.StringType)]
    long = raw.select(*texts).unpivot([], texts, "column", "text").where("text is not null")
    share = long.groupBy("column").agg((F.count_if(has_currency_mark(F.col("text"))) / F.count("text")).alias("share"))
    return share.withColumn("is_currency", F.col("share") > profiling.CURRENCY_SHARE)


@on_raw("p8_currency_sample")
def _(raw):
    found = profiling.currency_by_sample(raw, "EmpID")
    return raw.sparkSession.createDataFrame(list(found.items()), "column string, is_currency boolean")


# Cleaning ----------------------------------------------------------------------------------------


def _planned(raw: DataFrame):
    params = cleaning.plan_clean(raw)
    return params, cleaning.prepare(raw, params)


def _unique(raw: DataFrame):
    params, prepared = _planned(raw)
    return params, materialise(cleaning.drop_duplicate_rows(prepared), "unique")


def _numbers(raw: DataFrame):
    params, unique = _unique(raw)
    facts = cleaning.table_facts(unique, keep=("row_id",))
    params.extras_kept, params.extras_dropped = cleaning.split_extras(facts)
    return params, cleaning.coerce_numbers(unique, params)


@on_raw("c1_renamed")
def _(raw):
    named = profiling.rename_spellings(raw)
    return named.groupBy("Department", "OverTime").agg(
        F.count(F.lit(1)).alias("n"), F.avg("Age").alias("avg_age"), F.avg("YearsAtCompany").alias("avg_tenure")
    )


@on_raw("c2_without_identifiers")
def _(raw):
    params = cleaning.plan_clean(raw)
    return profiling.rename_spellings(raw).drop(*params.dropped)


@on_raw("c2_row_keys")
def _(raw):
    people = materialise(raw, "raw")
    variants = {
        "id": people,
        "no id": people.drop("EmpID"),
        "id repeats": people.withColumn("EmpID", F.col("EmpID") % 3),
        "id with gaps": people.withColumn("EmpID", F.when(F.col("EmpID") % 5 != 0, F.col("EmpID"))),
        "dotted names": people.withColumnsRenamed({"EmpID": "Emp.ID", "badge_score": "badge.score", "dept": "dept.name"}),
    }
    found = []
    for name, table in variants.items():
        params = cleaning.plan_clean(table)
        kept = materialise(cleaning.drop_duplicate_rows(cleaning.prepare(table, params)), "unique")
        train = split.stratified_split(kept.select("row_id", "Attrition"), "Attrition")[0]
        found.append(kept.agg(
            F.lit(name).alias("variant"), F.lit(params.row_id or "digest of the row").alias("row_key"),
            F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("row_keys"),
        ).crossJoin(F.broadcast(train.agg(F.count(F.lit(1)).alias("train_rows")))))  # one row each
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


@on_raw("c3_currency_to_number")
def _(raw):
    return raw.select("EmpID", money_to_number(F.col("Salary")).alias("Salary"))


@on_raw("c4_label_standardised")
def _(raw):
    return cleaning.standardise_label(raw.select("EmpID", "churned"), "churned")


@on_raw("c5_deduplicated")
def _(raw):
    return cleaning.drop_duplicate_rows(_planned(raw)[1])


@on_raw("c6_extra_columns")
def _(raw):
    return _numbers(raw)[1].select("row_id", "badge_score")


@on_raw("c7_medians")
def _(raw):
    params, numbers = _numbers(raw)
    found = column_quantiles(numbers, ["Age", "MonthlyIncome", "badge_score"], [0.5])
    return raw.sparkSession.createDataFrame([(c, q[0]) for c, q in found.items()], "column string, median double")


@on_raw("c8_modes")
def _(raw):
    _, unique = _unique(raw)
    found = cleaning.modes(unique, ["Department", "JobRole", "OverTime"])
    return raw.sparkSession.createDataFrame(list(found.items()), "column string, value string")


def _filled(raw: DataFrame) -> DataFrame:
    params, numbers = _numbers(raw)
    found = column_quantiles(numbers, ["Age", "MonthlyIncome", "badge_score"], [0.5])
    params.medians = {c: q[0] for c, q in found.items()}
    params.modes = cleaning.modes(numbers, ["Department"])
    return cleaning.impute(numbers, params)


@on_raw("c9_numbers_filled")
def _(raw):
    return _filled(raw).select("row_id", "Age", "MonthlyIncome", "YearsAtCompany", "badge_score", "Department")


@on_raw("c10_ordinals_whole")
def _(raw):
    return _filled(raw).select("row_id", "JobLevel")


@on_profile("c11_winsorised")
def _(people):
    wanted = ["Age", "MonthlyIncome", "NumCompaniesWorked", "YearsAtCompany"]
    bounds = column_quantiles(people, wanted, cleaning.CLIP_PROBS)
    return cleaning.winsorise(people.select("EmployeeID", *wanted), {c: (q[0], q[1]) for c, q in bounds.items()})


@on_raw("c12_cleaning_report")
def _(raw):
    params, cleaned = cleaning.fit_clean(raw)
    report_rows = cleaning.cleaning_report(raw, cleaned, params)
    return report_rows.groupBy("step").agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("total"))


@on_raw("c13_cleaned")
def _(raw):
    return cleaning.clean(raw)


# Features, codes, scaling --------------------------------------------------------------------------


def _feature(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda people: features.row_features(people).select("EmployeeID", name)


@on_profile("f1_income_to_level")
def _(people):
    return features.income_to_level(people).select("EmployeeID", "IncomeToLevelRatio")


for _number, _name in enumerate(features.ROW_FEATURES, start=2):
    _key = "".join(f"_{ch.lower()}" if ch.isupper() else ch for ch in _name).lstrip("_")
    on_profile(f"f{_number}_{_key}")(_feature(_name))


@on_profile("f9_engineered")
def _(people):
    return features.engineer(people)


def _keyed(people: DataFrame) -> DataFrame:
    return people.withColumnRenamed("EmployeeID", "row_id")


@on_profile("e1_label_extracted")
def _(people):
    return encode.extract_label(people).select("EmployeeID", "label")


@on_profile("e2_fitted_codes")
def _(people):
    return encode.fit_codes(people, ["BusinessTravel", "Department", "Gender", "JobRole", "OverTime"]).table


@on_profile("e3_applied_codes")
def _(people):
    known = people.where("Department <> 'BUILDING'")
    codes = encode.fit_codes(known, ["Department", "JobRole"])
    wanted = people.select("EmployeeID", "Department", "JobRole", "Gender")
    return encode.apply_codes(wanted, codes, ["Department", "JobRole", "Gender"])


@on_profile("e4_scaled")
def _(people):
    moments = encode.fit_scale(people, METERS)
    return encode.apply_scale(people.select("EmployeeID", *METERS), moments)


@on_profile("e5_aligned")
def _(people):
    return encode.align(people.drop("Age", "Gender"), ["Department", "Age", "JobLevel", "MonthlyRate"], ("EmployeeID",))


@on_profile("e6_not_fitted_guard")
def _(people):
    try:
        encode.apply_encoding(_keyed(people), None)
        raised = False
    except encode.NotFittedError:
        raised = True
    return people.sparkSession.createDataFrame([(raised,)], "raised boolean")


@on_profile("e8_feature_names")
def _(people):
    names = features.feature_columns(encode.extract_label(_keyed(features.engineer(people))))
    return people.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(c for c in names if c != "label")], "position int, feature string"
    )


@on_raw("e7_prepared_features")
def _(raw):
    return Preparation().fit_transform(raw).features


# Filters, joins, sorts, windows ----------------------------------------------------------------------


@on_profile("q1_equality_filter")
def _(people):
    kept = people.where((F.col("Attrition") == "Yes") & (F.col("OverTime") == "Yes") & (F.col("Gender") == "Female"))
    return kept.select("EmployeeID", "Department", "JobRole")


@on_profile("q2_range_filter")
def _(people):
    return rates.label_rate_by(people, ["NumCompaniesWorked"]).where("NumCompaniesWorked <= 8")


@on_raw("q3_record_lookup")
def _(raw):
    cleaned = cleaning.clean(raw)
    return report.lookup(raw, cleaned, raw.select("EmpID"), "EmpID").select(
        "asked_id", "row_id", "Department", "MonthlyIncome", "found"
    )


@on_profile("q4_column_pick")
def _(people):
    """The wanted columns that the table has, in the wanted order."""
    return people.select(*report.present(people, ("OverTime", "EmployeeID", "StockOptionLevel", "Age")))


@on_profile("j1_department_join")
def _(people):
    stats = rates.label_rate_by(people, ["Department"])
    income = people.groupBy("Department").agg(F.avg("MonthlyIncome").alias("avg_income"))
    return rounded(stats.join(income, "Department"), 4)


@on_profile("j2_group_value_on_rows", places=4)
def _(people):
    out = rates.with_group_total(people, "JobLevel", F.avg("MonthlyIncome"), "level_income")
    return out.select("EmployeeID", "JobLevel", "level_income")


@on_profile("u1_appended_rows")
def _(people):
    by_role = rates.label_rate_by(people, ["JobRole"]).select(F.col("JobRole").alias("group"), "total", "positives")
    by_travel = rates.label_rate_by(people, ["BusinessTravel"]).select(
        F.col("BusinessTravel").alias("group"), "total", "positives"
    )
    return by_role.unionByName(by_travel)


@on_profile("o1_sorted_rates")
def _(people):
    return rates.rate_ranking(people, "JobRole", ascending=False)


@on_profile("o2_top_earners")
def _(people):
    return people.orderBy(F.col("MonthlyIncome").desc(), "EmployeeID").limit(50).select("EmployeeID", "MonthlyIncome")


@on_profile("o3_top_role")
def _(people):
    return rates.top_group(people, "JobRole")


@on_profile("d1_distinct_roles")
def _(people):
    return rates.distinct_values(people, "JobRole")


@on_profile("d1_distinct_counts")
def _(people):
    return rates.distinct_counts(people, ["Department", "JobRole", "BusinessTravel", "Age"])


# Dashboard aggregations ------------------------------------------------------------------------------

on_profile("a1_kpi_row", places=4)(rates.kpi_row)
on_profile("a2_status_card")(rates.status_card)
on_profile("a3_class_shares")(rates.class_shares)
on_profile("a4_department_counts")(lambda people: rates.pair_counts(people, ["Department", "Attrition"]))
on_profile("a5_age_histogram")(lambda people: distribution.histogram(people, "Age", ["Attrition"]))
on_profile("a6_income_boxes", places=4)(
    lambda people: distribution.box_stats(people, "MonthlyIncome", ["Department", "Attrition"])
)
on_profile("a6_order_count_outliers")(
    lambda people: distribution.box_outliers(people, "NumCompaniesWorked", ["Department", "Attrition"], "EmployeeID")
)
on_profile("a7_satisfaction_rates")(rates.satisfaction_rates)


@on_profile("a7_satisfaction_grid")
def _(people):
    grid = rates.satisfaction_grid(people)
    return grid.withColumnsRenamed({str(i): f"score_{i}" for i in (1, 2, 3, 4)})


on_profile("a8_overtime_counts")(lambda people: rates.pair_counts(people, ["OverTime", "Attrition"]))
on_profile("a9_tenure_curve")(rates.tenure_curve)
on_profile("a10_role_rates")(lambda people: rates.rate_ranking(people, "JobRole"))
on_profile("a11_promotion_boxes")(
    lambda people: distribution.box_stats(people, "YearsSinceLastPromotion", ["Attrition"])
)
on_profile("a11_promotion_histogram")(
    lambda people: distribution.histogram(people, "YearsSinceLastPromotion", ["Attrition"])
)
on_profile("a12_gender_counts")(rates.gender_counts)
on_profile("a13_top_department")(rates.top_group)
on_profile("a14_overtime_risk")(rates.overtime_risk)
on_profile("a15_income_gap", places=4)(rates.income_gap)
on_profile("a16_overview")(rates.overview)
on_profile("a17_department_summary")(rates.department_summary)
on_profile("a18_role_summary")(rates.role_summary)


# The same operators on the larger tables ---------------------------------------------------------------


@query("a4_line_return_rates")
def _(spark, folder):
    return rounded(rates.label_rate_by(lines(spark, folder), ["l_suppkey"], "l_returnflag", "R"))


@query("a5_line_price_histogram")
def _(spark, folder):
    return rounded(distribution.histogram(lines(spark, folder), "l_extendedprice", ["l_returnflag"]), 4)


@query("a6_line_price_boxes")
def _(spark, folder):
    return rounded(distribution.box_stats(lines(spark, folder), "l_extendedprice", ["l_returnflag", "l_linestatus"]), 4)


@query("a10_document_quality_rates")
def _(spark, folder):
    labelled = tables.read_table(spark, folder, "labels").join(
        tables.read_table(spark, folder, "documents").select("doc_id", "lang", "source"), "doc_id"
    )
    texts = labelled.withColumn("quality", F.col("quality").cast("string"))
    return rounded(rates.label_rate_by(texts, ["lang", "source"], "quality", "1"))


@query("f1_line_price_ratio")
def _(spark, folder):
    ratio = features.income_to_level(lines(spark, folder), level="l_linenumber", income="l_extendedprice")
    return rounded(ratio.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.avg("IncomeToLevelRatio").alias("avg_ratio"),
        F.max("IncomeToLevelRatio").alias("max_ratio"),
    ))


@query("c11_line_quantiles_by_range")
def _(spark, folder):
    """Quantiles through the ranged path, which larger tables take."""
    found = exact_quantiles(
        lines(spark, folder), "l_extendedprice", [0.01, 0.25, 0.5, 0.99], ["l_returnflag"], rows_per_range=2000
    )
    return rounded(found.select("l_returnflag", *[F.col("quantiles")[i].alias(f"q{i}") for i in range(4)]), 4)


@query("m1_order_split")
def _(spark, folder):
    orders = tables.read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("label")
    )
    train, test = split.stratified_split(orders)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("m10_line_auc")
def _(spark, folder):
    return rounded(metrics.roc_auc(workforce.scored_lines(spark, folder)))


@query("m10_line_auc_by_range")
def _(spark, folder):
    """The curve's area through the ranged path, which larger tables take."""
    return rounded(metrics.roc_auc(workforce.scored_lines(spark, folder), rows_per_range=2000))


@query("m11_line_roc")
def _(spark, folder):
    return _roc_shown(metrics.roc_curve(workforce.scored_lines(spark, folder)))


@query("m11_line_roc_by_range")
def _(spark, folder):
    return _roc_shown(metrics.roc_curve(workforce.scored_lines(spark, folder), rows_per_range=2000))


# Modelling and evaluation -------------------------------------------------------------------------------


def _roc_shown(curve: DataFrame) -> DataFrame:
    shown = F.when(F.col("threshold") == float("inf"), F.lit(None)).otherwise(F.col("threshold"))
    return rounded(curve.withColumn("threshold", shown))


def _model_scores(people: DataFrame) -> DataFrame:
    """Three deterministic scored models, the later ones weaker."""
    one = workforce.scored(people)
    parts = []
    for name, pull in (("one", 1.0), ("two", 0.6), ("three", 0.4)):
        value = F.bround(F.lit(pull) * F.col("score") + F.lit((1.0 - pull) * 0.5), 4)
        parts.append(
            F.struct(F.lit(name).alias("model"), F.when(F.col("row_id") % 7 < 7 * pull, value).otherwise(F.lit(0.25)).alias("score"))
        )
    return (
        one.select("row_id", "label", F.explode(F.array(*parts)).alias("m"))
        .select("row_id", "label", "m.*")
        .withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    )


def _xy(people: DataFrame) -> DataFrame:
    return encode.extract_label(_keyed(people))


@on_profile("m1_split")
def _(people):
    train, test = split.stratified_split(_xy(people).select("row_id", "label"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def employees_as_numbers(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """A generated employee per customer, the label and all 28 features as numbers (texts as codes), and the features."""
    people = generator.employees_for(tables.read_table(spark, folder, "customer"), "c_custkey").withColumnRenamed("EmployeeID", "row_id")
    features_ = [c for c in people.columns if c not in ("row_id", "Attrition")]
    texts = [c for c, kind in people.dtypes if kind == "string" and c != "Attrition"]
    labelled = encode.extract_label(materialise(people, "people"))
    return encode.apply_codes(labelled, encode.fit_codes(labelled, texts), texts), features_


@query("m2_oversampled")
def _(spark, folder):
    return oversample.smote(*employees_as_numbers(spark, folder))


@query("m2_neighbour_recall")
def _(spark, folder):
    """The forest on all 28 features with leaves far smaller than the table, against the exact distances of a sample."""
    people, used = employees_as_numbers(spark, folder)
    points = people.groupBy(F.array(*[F.col(c).cast("double") for c in used]).alias("vec")).agg(F.min("row_id").alias("row_id"))
    points = materialise(points.select("row_id", "vec"), "points")
    rows = points.count()
    # leaves that grow with the table would make the work quadratic
    best = forest.forest_candidates(points, "row_id", 5, leaf_rows=min(forest.LEAF_ROWS, max(64, rows // 64)))
    truth = forest.true_distances(points, "row_id", 5)
    counts = best.join(F.broadcast(truth.drop("n")), "row_id", "left").agg(  # a row per probe
        F.count("within").alias("probes"), F.count(F.lit(1)).alias("points"), F.sum(F.size("best")).alias("found")
    )
    return counts.withColumn("recall_reached", F.lit(forest.found_share(best, truth, "row_id") >= 0.9))


@query("m2_probe_distances")
def _(spark, folder):
    """The exact distances that the recall is measured by."""
    people, used = employees_as_numbers(spark, folder)
    points = people.groupBy(F.array(*[F.col(c).cast("double") for c in used]).alias("vec")).agg(F.min("row_id").alias("row_id"))
    return forest.true_distances(materialise(points.select("row_id", "vec"), "points"), "row_id", 5).select("row_id", "within")


@on_profile("m2_oversampled_in_blocks")
def _(people):
    """On four features by the exact search in small blocks."""
    return oversample.smote(_xy(people), NEIGHBOUR_FEATURES, block_rows=96)


@on_profile("m2_oversampled_on_measures")
def _(people):
    """On four features by the forest, whose only leaf makes it exact here."""
    return oversample.smote(_xy(people), NEIGHBOUR_FEATURES)


@on_profile("m2_nearest_neighbours")
def _(people):
    points = _xy(people).select("row_id", F.array(*[F.col(c).cast("double") for c in NEIGHBOUR_FEATURES]).alias("vec"))
    distinct = points.groupBy("vec").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("weight"))
    found = nearest(distinct, "row_id", 5, block_rows=256)
    gap = F.aggregate(F.zip_with("near", "vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return found.select("row_id", "weight", "vec", F.posexplode("neighbours").alias("place", "near")).select(
        "row_id", "weight", "place", gap.alias("d2")
    )


def _encoded(people: DataFrame) -> tuple[encode.FittedEncoding, DataFrame]:
    """The engineered view, written once, with its fitted encoding and the encoded table."""
    engineered = materialise(features.engineer(_keyed(people)), "engineered")
    encoding, table = encode.fit_encoding(engineered)
    return encoding, materialise(table, "encoded")


MODEL_NAMES = (models.LOGISTIC, models.FOREST, models.BOOSTED)
FOLDS = models.Settings().folds


@dataclass(frozen=True)
class Fit:
    """A model of default size, fitted on the training part of the encoded view."""

    name: str
    encoding: encode.FittedEncoding
    table: DataFrame
    train: DataFrame
    test: DataFrame
    model: object

    @property
    def features(self) -> list[str]:
        return self.encoding.features


_kept: dict[tuple, object] = {}


def kept(spark: SparkSession, folder: str, what: object, make: Callable[[], object]):
    """What was fitted once in a session for a folder of tables; queries that show the same model share it."""
    key = (spark.sparkContext.applicationId, folder, what)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def encoded_parts(spark: SparkSession, folder: str):
    encoding, table = kept(spark, folder, "encoded", lambda: _encoded(workforce.profile(spark, folder)))
    return encoding, table, *split.stratified_split(table)


def fitted(spark: SparkSession, folder: str, name: str) -> Fit:
    def make() -> Fit:
        encoding, table, train, test = encoded_parts(spark, folder)
        return Fit(name, encoding, table, train, test, models.fit_model(models.assemble(train, encoding.features), name))

    return kept(spark, folder, name, make)


def compared(spark: SparkSession, folder: str) -> models.Trained:
    def make() -> models.Trained:
        encoding, _, train, test = encoded_parts(spark, folder)
        return models.train_all(train, test, encoding.features)

    return kept(spark, folder, "compared", make)


def _test_scores(name: str) -> Query:
    def run(spark, folder):
        fit = fitted(spark, folder, name)
        return rounded(models.score(fit.model, fit.test, fit.features).select("row_id", "label", "score", "prediction"))

    return run


def _walked(name: str) -> Query:
    """Whether each held-out row's score equals that of the node tables, walked by joins."""

    def run(spark, folder):
        fit = fitted(spark, folder, name)
        scored = models.score(fit.model, fit.test, fit.features).select("row_id", "label", "score")
        walked = treewalk.walked_scores(fit.test, fit.features, fit.model)
        return scored.join(walked, "row_id").select("row_id", "label", (F.abs(F.col("score") - F.col("walked")) < 1e-9).alias("same"))

    return run


QUERIES["m3_logistic_scores"] = _test_scores(models.LOGISTIC)
QUERIES["m4_forest_scores"] = _test_scores(models.FOREST)
QUERIES["m5_boosted_scores"] = _test_scores(models.BOOSTED)
QUERIES["m4_forest_walk"] = _walked(models.FOREST)
QUERIES["m5_boosted_walk"] = _walked(models.BOOSTED)


@query("m3_logistic_convergence")
def _(spark, folder):
    """Whether the penalised loss is flat at the fitted parameters: its gradient's length is below 1e-6."""
    fit = fitted(spark, folder, models.LOGISTIC)
    table = models.weighted(models.assemble(fit.train, fit.features), models.LOGISTIC)
    gradient = models.logistic_gradient(fit.model, table)
    return spark.createDataFrame([(models.LOGISTIC, fit.train.count(), gradient < 1e-6)], "model string, rows bigint, converged boolean")


@query("m5_training_loss")
def _(spark, folder):
    """The training loss after every 50 trees, recomputed from scores, and whether it fell."""
    fit = fitted(spark, folder, models.BOOSTED)
    table = materialise(models.weighted(models.assemble(fit.train, fit.features), models.BOOSTED), "weighted")
    rows, last = [], float("inf")
    for n in range(0, len(fit.model.trees) + 1, 50):
        part = replace(fit.model, trees=fit.model.trees[:n])
        models.score(part, table).select("label", "weight", "score").createOrReplaceTempView("scored_rows")
        loss = spark.sql(
            "SELECT sum(-weight * CASE WHEN label = 1 THEN ln(score) ELSE ln(1 - score) END) / sum(weight) AS loss FROM scored_rows"
        ).first()["loss"]
        rows.append((n, loss < last))
        last = loss
    return spark.createDataFrame(rows, "trees int, fell boolean")


@query("m5_tree_columns")
def _(spark, folder):
    """Per tree how many columns were drawn, and whether it splits on none outside its draw."""
    nodes = fitted(spark, folder, models.BOOSTED).model.node_table(spark)
    within = F.every((F.col("left") < 0) | F.array_contains("drawn", F.col("feature")))
    return nodes.groupBy("tree").agg(F.max(F.size("drawn")).alias("drawn"), within.alias("within_draw"))


@on_profile("m6_class_weights")
def _(people):
    return split.class_weights(_xy(people).select("row_id", "label"))


QUERIES["m7_trained_comparison"] = lambda spark, folder: rounded(compared(spark, folder).evaluated)


@query("m7_comparison_recomputed")
def _(spark, folder):
    """Per model the held-out rows, and whether accuracy and AUC equal those that SQL computes from the written scores."""
    trained = compared(spark, folder)
    trained.scored.createOrReplaceTempView("held_out_scores")
    again = spark.sql("""SELECT model, count(*) AS rows, avg(CAST(prediction = label AS INT)) AS accuracy2,
        (sum(CASE WHEN label = 1 THEN place END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) AS auc2
        FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS place
        FROM held_out_scores) GROUP BY model""")
    same = (F.abs(F.col("accuracy") - F.col("accuracy2")) < 1e-9) & (F.abs(F.col("roc_auc") - F.col("auc2")) < 1e-9)
    return trained.evaluated.join(again, "model").select("model", "rows", same.alias("same"))


on_profile("m8_confusion")(lambda people: metrics.confusion_matrix(_model_scores(people), ["model"]))
on_profile("m9_threshold_metrics")(lambda people: metrics.threshold_metrics(_model_scores(people), ["model"]))
on_profile("m10_auc")(lambda people: metrics.roc_auc(_model_scores(people), ["model"]))
QUERIES["m11_roc_curve"] = lambda spark, folder: _roc_shown(
    metrics.roc_curve(_model_scores(workforce.profile(spark, folder)), ["model"])
)


@on_profile("m12_folds")
def _(people):
    return split.stratified_folds(_xy(people).select("row_id", "label"))


@query("m12_cross_validation")
def _(spark, folder):
    return rounded(compared(spark, folder).evaluated.select("model", F.col("cv_auc_mean").alias("mean"), F.col("cv_auc_std").alias("std")))


@query("m12_fold_aucs")
def _(spark, folder):
    """Per model and fold the scored rows, and whether the fold's AUC equals the one that SQL computes from the written scores."""
    trained = compared(spark, folder)
    trained.fold_scores.createOrReplaceTempView("fold_scores")
    again = spark.sql("""SELECT model, fold, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives,
        (sum(CASE WHEN label = 1 THEN place END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) AS auc2
        FROM (SELECT *, rank() OVER (PARTITION BY model, fold ORDER BY score) + (count(*) OVER (PARTITION BY model, fold, score) - 1) / 2 AS place
        FROM fold_scores) GROUP BY model, fold""")
    joined = models.fold_aucs(trained.fold_scores).join(again, ["model", "fold"])
    return joined.select("model", "fold", "rows", "positives", (F.abs(F.col("roc_auc") - F.col("auc2")) < 1e-9).alias("same"))


on_profile("m13_metrics_table")(lambda people: metrics.metrics_table(metrics.evaluate(_model_scores(people))))


@on_profile("m14_best_model")
def _(people):
    best = metrics.best_model(metrics.metrics_table(metrics.evaluate(_model_scores(people))))
    return people.sparkSession.createDataFrame([(best,)], "model string")


def _batch_scores(spark, folder, name):
    fit = fitted(spark, folder, name)
    people = workforce.profile(spark, folder)
    return fit, scoring.Scorer(fit.encoding, fit.model, lookup_table(features.level_medians(people))), _keyed(people)


@query("m15_batch_scores")
def _(spark, folder):
    _, scorer, records = _batch_scores(spark, folder, models.LOGISTIC)
    return rounded(scorer(records))


@query("m15_batch_walk")
def _(spark, folder):
    """Whole records scored in one batch by both tree models; each score equals that of the node tables."""
    shown = []
    for name in (models.FOREST, models.BOOSTED):
        fit, scorer, records = _batch_scores(spark, folder, name)
        walked = treewalk.walked_scores(scorer.features(records), fit.features, fit.model)
        same = scorer(records).join(walked, "row_id").select("row_id", (F.abs(F.col("score") - F.col("walked")) < 1e-9).alias("same"))
        shown.append(same.withColumn("model", F.lit(name)))
    return shown[0].unionByName(shown[1])


@query("m16_feature_importance")
def _(spark, folder):
    tables_ = [
        models.feature_importance(fit.model, fit.features, spark).withColumn("model", F.lit(fit.name))
        for fit in (fitted(spark, folder, name) for name in MODEL_NAMES)
    ]
    return rounded(tables_[0].unionByName(tables_[1]).unionByName(tables_[2]))


on_profile("m17_radar")(lambda people: metrics.best_flags(metrics.metrics_table(metrics.evaluate(_model_scores(people)))))


@on_profile("m18_risk_bands")
def _(people):
    return workforce.scored(people).select(
        "row_id", "score", scoring.risk_band(F.col("score")).alias("band"),
        scoring.gauge_band(F.col("score")).alias("gauge"),
    )


@on_profile("m19_scoring_defaults")
def _(people):
    filled = scoring.out_of_bounds(scoring.fill_defaults(people.drop("Attrition", "Gender")))
    return filled.select(
        "EmployeeID", "Attrition", "Gender", "MaritalStatus", "MonthlyRate", "StockOptionLevel",
        F.array_join("invalid_fields", ",").alias("invalid_fields"),
    )


# Explanation --------------------------------------------------------------------------------------------


def _explained(people: DataFrame) -> DataFrame:
    keyed = _keyed(people)
    means = explain.feature_means(keyed, list(LINEAR_WEIGHTS))
    return explain.linear_attribution(keyed, LINEAR_WEIGHTS, means, LINEAR_INTERCEPT)


@on_profile("x1_background")
def _(people):
    return explain.background(people, "EmployeeID").select("EmployeeID", "Age", "JobRole")


@on_profile("x2_linear_attribution")
def _(people):
    return _explained(people).select("row_id", "base_value", F.explode("contributions").alias("c")).select(
        "row_id", "base_value", "c.feature", "c.value", "c.shap"
    )


def _additive(explained: DataFrame, scored: DataFrame, margin) -> DataFrame:
    """Whether base value and attributions add up to the model's output, per row."""
    total = F.aggregate("contributions", F.col("base_value"), lambda sum_, c: sum_ + c["shap"])
    totals = explained.select("row_id", total.alias("_total"))  # the join moves sums, not contributions
    return totals.join(scored, "row_id").select("row_id", (F.abs(F.col("_total") - margin) < 1e-6).alias("additive"))


def _tree_additive(name: str) -> Query:
    def run(spark, folder):
        fit = fitted(spark, folder, name)
        scored = models.score(fit.model, fit.table, fit.features).select("row_id", "score")
        log_odds = F.log(F.col("score") / (1 - F.col("score")))
        explained = explain.tree_attribution(fit.table, fit.model, fit.features)
        return _additive(explained, scored, log_odds if name == models.BOOSTED else F.col("score"))

    return run


def _shown(explained: DataFrame) -> DataFrame:
    return explained.select("row_id", "base_value", F.explode("contributions").alias("c")).select(
        "row_id", "base_value", "c.feature", "c.value", "c.shap"
    )


def _tree_explained(name: str) -> Query:
    def run(spark, folder):
        fit = fitted(spark, folder, name)
        return rounded(_shown(explain.tree_attribution(fit.table, fit.model, fit.features)))

    return run


QUERIES["x3_forest_attribution"] = _tree_explained(models.FOREST)
QUERIES["x3_boosted_attribution"] = _tree_explained(models.BOOSTED)
QUERIES["x3_forest_additivity"] = _tree_additive(models.FOREST)
QUERIES["x3_boosted_additivity"] = _tree_additive(models.BOOSTED)

# A tree whose attributions SQL computes by enumerating coalitions: node: (feature, threshold, left, right, value, cover).
SMALL_TREE_FEATURES = ["Age", "JobLevel", "YearsAtCompany", "DistanceFromHome"]
SMALL_TREE = [
    (0, 35.0, 1, 2, 0.0, 100.0), (1, 2.0, 3, 4, 0.0, 60.0), (2, 3.0, 5, 6, 0.0, 40.0), (3, 10.0, 7, 8, 0.0, 24.0), (-1, 0.0, -1, -1, -0.4, 36.0),
    (0, 50.0, 9, 10, 0.0, 10.0), (-1, 0.0, -1, -1, -1.1, 30.0), (-1, 0.0, -1, -1, 0.2, 15.0), (-1, 0.0, -1, -1, 0.9, 9.0),
    (-1, 0.0, -1, -1, 0.5, 6.0), (-1, 0.0, -1, -1, -0.7, 4.0),
]


@on_profile("x3_small_tree_values")
def _(people):
    tree = boosting.Tree([0, 1, 2, 3])
    for feature, threshold, left, right, value, cover in SMALL_TREE:
        at = tree.add(value, cover)
        tree.feature[at], tree.threshold[at], tree.left[at], tree.right[at] = feature, threshold, left, right
    model = boosting.BoostedTrees([tree], 4, 3, base=0.25)
    return _shown(explain.tree_attribution(_keyed(people), model, SMALL_TREE_FEATURES))


KERNEL_FEATURES = [
    "Age", "DistanceFromHome", "EnvironmentSatisfaction", "JobLevel", "JobSatisfaction", "NumCompaniesWorked", "TotalWorkingYears",
    "WorkLifeBalance", "YearsAtCompany", "YearsSinceLastPromotion",
]


def _kernel_fit(spark, folder, name):
    def make():
        table = materialise(_xy(workforce.profile(spark, folder)).select("row_id", "label", *KERNEL_FEATURES), "xy")
        return table, models.fit_model(models.assemble(table, KERNEL_FEATURES), name), explain.feature_means(table, KERNEL_FEATURES)

    return kept(spark, folder, ("kernel", name), make)


def _compared_attributions(fit: DataFrame, defined: DataFrame, names: list[str]) -> DataFrame:
    """Per row and feature whether both attributions agree. Rows meet before their features are listed: both sides are grouped by row
    already, and a broadcast would be chosen by a size that does not count what an explode adds."""
    shaps = fit.select("row_id", F.col("contributions.value").alias("value"), F.col("contributions.shap").alias("shap"))
    both = shaps.join(defined.select("row_id", F.col("contributions.shap").alias("defined")).hint("merge"), "row_id")
    listed = F.arrays_zip(F.array(*[F.lit(f) for f in names]).alias("feature"), "value", "shap", "defined")
    return both.select("row_id", F.explode(listed).alias("c")).select(
        "row_id", "c.feature", "c.value", (F.abs(F.col("c.shap") - F.col("c.defined")) < 1e-6).alias("equal")
    )


def _kernel(name: str) -> Query:
    """Whether the weighted coalitions' fit equals the Shapley values by definition, for each row and feature."""

    def run(spark, folder):
        table, model, means = _kernel_fit(spark, folder, name)
        ground = np.array([means[f] for f in KERNEL_FEATURES])
        fit = explain.kernel_attribution(table, model, KERNEL_FEATURES, ground)
        defined = explain.kernel_attribution(table, model, KERNEL_FEATURES, ground, plan=explain.shapley_shares(len(KERNEL_FEATURES)))
        return _compared_attributions(fit, defined, KERNEL_FEATURES)

    return run


QUERIES["x4_kernel_logistic"] = _kernel(models.LOGISTIC)
QUERIES["x4_kernel_forest"] = _kernel(models.FOREST)
QUERIES["x4_kernel_boosted"] = _kernel(models.BOOSTED)


def _sampled(spark: SparkSession, folder: str):
    table, model, means = _kernel_fit(spark, folder, models.LOGISTIC)
    explained = explain.sampled_attribution(table, model, KERNEL_FEATURES, means)
    return models.score(model, table, KERNEL_FEATURES), explained


@query("x4_sampled_additivity")
def _(spark, folder):
    scored, explained = _sampled(spark, folder)
    return _additive(explained, scored.select("row_id", "score"), F.col("score"))


@query("x4_sampled_attribution")
def _(spark, folder):
    return rounded(_shown(_sampled(spark, folder)[1]))


on_profile("x5_global_importance")(lambda people: explain.global_importance(_explained(people)))
on_profile("x6_row_explanations")(lambda people: explain.explain_rows(_explained(people)))
on_profile("x7_top_factors")(lambda people: explain.top_factors(_explained(people)))


@on_profile("x8_narratives")
def _(people):
    scored = workforce.scored(people).select("row_id", "score", "prediction")
    return explain.narrative(_explained(people).join(scored, "row_id"))


on_profile("x9_waterfall")(lambda people: explain.waterfall(_explained(people), 10))


@on_profile("x10_top_importance")
def _(people):
    importance = explain.global_importance(_explained(people)).withColumnRenamed("mean_abs_shap", "importance")
    return models.top_importance(importance, 15)


@on_raw("l3_predicted_and_explained")
def _(raw):
    study = lifecycle.run_study(raw)
    return lifecycle.predict_and_explain(study, study.prepared.cleaned).select("row_id", "score", "prediction", "risk", "explanation")


# Reports ------------------------------------------------------------------------------------------------

on_profile("r1_executive_summary")(lambda people: report.executive_summary(people).drop("text"))
on_profile("r2_department_analysis")(report.department_analysis)
on_profile("r3_role_analysis")(report.role_analysis)
on_profile("r4_leavers")(report.leavers)


@on_profile("r5_riskiest")
def _(people):
    scores = workforce.scored(people).select(F.col("row_id").alias("EmployeeID"), "score")
    return report.riskiest(people, scores)
