"""Histograms and box statistics per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stayscope.functions.ranges import SINGLE_RANGE_ROWS, null_safe_join, quantiles_of_counts, value_counts
from stayscope.session import lookup_table

FENCE = 1.5


def histogram(df: DataFrame, value: str, by: Sequence[str], bins: int = 25) -> DataFrame:
    """Counts in ``bins`` equal-width bins over the table-wide range: ``by``, ``bin``, edges, ``n``."""
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    width = (high - low) / bins if high > low else 1.0
    x = F.col(value).cast("double")
    number = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = df.where(x.isNotNull()).groupBy(*by, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumns(
        {"bin_low": F.lit(low) + F.col("bin") * F.lit(width), "bin_high": F.lit(low) + (F.col("bin") + 1) * F.lit(width)}
    )


def quartiles(counted: DataFrame, by: Sequence[str], rows_per_range: int = SINGLE_RANGE_ROWS) -> DataFrame:
    """``by``, ``q1``, ``median``, ``q3`` and the fences 1.5 quartile ranges away, from counted values."""
    found = quantiles_of_counts(counted, [0.25, 0.5, 0.75], by, rows_per_range).select(
        *by, *[F.col("quantiles")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    )
    reach = FENCE * (F.col("q3") - F.col("q1"))
    return found.withColumns({"low_fence": F.col("q1") - reach, "high_fence": F.col("q3") + reach})


def box_stats(df: DataFrame, value: str, by: Sequence[str], rows_per_range: int = SINGLE_RANGE_ROWS) -> DataFrame:
    """Quartiles, whiskers (outermost values inside the fences) and counts per group.

    The table is read once to count (group, value); all else comes from the counts.
    """
    counted = value_counts(df, value, by)
    boxes = lookup_table(quartiles(counted, by, rows_per_range))
    inside = F.col("_v").between(F.col("low_fence"), F.col("high_fence"))
    return null_safe_join(counted, boxes, list(by)).groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.min("q1").alias("q1"),
        F.min("median").alias("median"),
        F.min("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("_v"))).alias("high_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outliers"),
    )


def box_outliers(
    df: DataFrame, value: str, by: Sequence[str], key: str, rows_per_range: int = SINGLE_RANGE_ROWS
) -> DataFrame:
    """The rows outside their group's fences."""
    x = F.col(value).cast("double")
    boxes = lookup_table(quartiles(value_counts(df, value, by), by, rows_per_range))
    rows = null_safe_join(df.select(key, *by, value).where(F.col(value).isNotNull()), boxes, list(by))
    return rows.where(~x.between(F.col("low_fence"), F.col("high_fence"))).select(key, *by, value)
