"""Reports that appear whole or not at all, digests instead of rows, and uniqueness in one exchange."""

import pytest
from pyspark.sql import functions as F

from stayscope.operators import clean as C, profile as P
from stayscope.session import materialise, scratch_path
from stayscope.sources import tables


def test_a_failed_report_leaves_the_earlier_one(spark, people, monkeypatch):
    folder = scratch_path(spark, "report")
    assert tables.read_report(spark, folder) == {}
    tables.write_report(people, folder)
    before = {name: sheet.count() for name, sheet in tables.read_report(spark, folder).items()}
    whole = tables.report_tables

    def breaks(df, *rest):
        sheets = whole(df.limit(5), *rest)
        bad = df.select(F.raise_error(F.lit("lost")).cast("string").alias("x"))
        return {**{k: v for k, v in list(sheets.items())[:2]}, "Job Role Analysis": bad, **dict(list(sheets.items())[3:])}

    monkeypatch.setattr(tables, "report_tables", breaks)
    with pytest.raises(Exception, match="lost"):
        tables.write_report(people, folder)
    assert {name: sheet.count() for name, sheet in tables.read_report(spark, folder).items()} == before
    monkeypatch.setattr(tables, "report_tables", whole)
    tables.write_report(people.limit(7), folder, importance=people.select(F.lit("Age").alias("feature"), F.lit(1.0).alias("importance")).limit(1))
    again = tables.read_report(spark, folder)
    assert list(again) == [*before, "Feature Importance"] and again["Executive Summary"].where("metric = 'Total Employees'").first()["value"] == 7


def rows(spark, n=300):
    made = [(i, i % 40 if i % 3 else i, None if i % 5 == 0 else "a", -0.0 if i % 2 else 0.0) for i in range(n)]
    return materialise(spark.createDataFrame(made, "row_id long, x long, y string, z double").repartition(4), "copies")


@pytest.mark.parametrize("most", [10**6, 3])
def test_digests_and_rows_remove_the_same_copies(spark, most):
    df = rows(spark)
    kept = {}
    for r in df.collect():
        kept.setdefault((r.x, r.y), []).append(r.row_id)
    got = C.drop_duplicate_rows(df, most=most)
    assert sorted(r.row_id for r in got.collect()) == sorted(min(ids) for ids in kept.values())
    assert got.columns == df.columns


def test_rows_without_a_copy_are_not_exchanged(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id").withColumn("x", F.col("row_id") * 2)
    assert C.drop_duplicate_rows(materialise(df, "unique"))._jdf.queryExecution().toString().count("Exchange") == 0
    assert C.drop_duplicate_rows(df.limit(0)).count() == 0


def test_uniqueness_of_many_columns_is_one_exchange(spark):
    df = materialise(spark.range(3000).select(
        "id", (F.col("id") % 2999).alias("late"), (F.col("id") % 7).alias("often"), (F.col("id") * 1.5).alias("scaled"), F.concat(F.lit("k"), "id").alias("text")
    ), "columns")
    assert P.all_unique(df, df.columns, head=100) == ["id", "scaled", "text"]
    assert P.first_unique(df, ["often", "late", "scaled", "id"], head=100) == "scaled"
    assert P.first_unique(df, ["often", "late"]) is None and P.all_unique(df, []) == []
    jobs = []
    for names in (["id"], ["id", "scaled", "text"]):
        spark.sparkContext.setJobGroup(f"unique {len(names)}", "")
        P.repeating(df, names)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"unique {len(names)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_a_summary_without_a_label_warns(spark):
    with pytest.warns(UserWarning, match="no label column"):
        P.summarise(spark.createDataFrame([("a", 5), ("b", 6)], "n string, k int"))
