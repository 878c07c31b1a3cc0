"""Reading and writing personnel tables and reports."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from stayscope.operators.report import leavers, report_tables, riskiest


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, row_id: str | None = None
) -> DataFrame:
    """A CSV with a header. Give the schema to spare the pass that infers it.

    ``row_id`` adds a key column numbered by file position, for tables without one. It follows
    the file splits, so it is stable while the files and the split size stay the same.
    """
    reader = spark.read.option("header", True).option("nanValue", "NaN")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = without_nan(reader.csv(path))
    return df if row_id is None else df.withColumn(row_id, F.monotonically_increasing_id())


def without_nan(df: DataFrame) -> DataFrame:
    """Not-a-number becomes null, the only notion of missing here."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.option("header", True).mode(mode).csv(path)


def write_risk_list(df: DataFrame, path: str, scores: DataFrame | None = None, key: str = "EmployeeID") -> None:
    """The leavers, or with scores the people at highest predicted risk, as CSV."""
    rows = leavers(df) if scores is None else riskiest(df, scores, key)
    write_csv(rows, path)


def write_report(
    df: DataFrame, folder: str, metrics: DataFrame | None = None, importance: DataFrame | None = None,
    generated_at: str | None = None, file_format: str = "parquet",
) -> dict[str, str]:
    """Write every report sheet below ``folder``; returns sheet name to path.

    A report appears whole or not at all: the sheets go to a folder of this attempt, and the manifest, one small file that
    names them, is written last. Readers follow the newest manifest, so a failure on the way leaves the
    report before it as it was.
    """
    spark, folder = df.sparkSession, folder.rstrip("/")
    attempt = f"{folder}/attempt-{uuid.uuid4().hex}"
    paths = {}
    for name, sheet in report_tables(df, metrics, importance, generated_at).items():
        slug = re.sub(r"[^a-z0-9]+", "_", name.lower())
        paths[name] = f"{attempt}/{slug}"
        sheet.write.format(file_format).option("header", True).save(paths[name])
    earlier = _manifest(spark, folder)
    number = 1 if earlier is None else (earlier.agg(F.max("report")).first()[0] or 0) + 1
    rows = [(number, place, name, path, file_format) for place, (name, path) in enumerate(paths.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return paths


MANIFEST = "report bigint, place int, sheet string, path string, format string"


def _manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(MANIFEST).parquet(path.toString())


def read_report(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The sheets of the newest whole report below ``folder``, in order; none if no report was finished."""
    manifest = _manifest(spark, folder)
    if manifest is None:
        return {}
    newest = manifest.agg(F.max("report")).first()[0]
    rows = manifest.where(F.col("report") == newest).orderBy("place").collect()
    return {row["sheet"]: spark.read.format(row["format"]).option("header", True).load(row["path"]) for row in rows}
