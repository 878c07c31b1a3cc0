"""Places and running totals over a whole table, without a window that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stayscope.session import materialise


def running(df: DataFrame, by: str, order: list[Column], value: str, label: str = "laid") -> DataFrame:
    """``df`` with ``_place`` (from 1) and ``_before`` (sum of ``value`` over the earlier rows) within each ``by``.

    ``by`` and ``value`` are long columns without nulls, ``order`` must tell rows apart that matter. Rows are dealt by
    ranges of (by, order), so a group that fills a third of the table spans many tasks; each task adds up its own rows, and
    what earlier tasks hold of a group is added afterwards. At most one group crosses from a task to the next, so the
    table of these offsets has fewer rows than there are partitions and is broadcast. ``df`` is read twice (once to
    sample the ranges) and should have been written. An empty table stays empty.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*df.schema.fields, *[StructField(name, LongType()) for name in ("_part", "_place", "_before")]])
    arrow_names = df.columns
    by_at, value_at = arrow_names.index(by), arrow_names.index(value)

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        group, place, total = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = batch.column(by_at).to_numpy(zero_copy_only=False)
            values = batch.column(value_at).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1])
            lengths = np.diff(np.concatenate([starts, [n]]))
            before = np.cumsum(values) - values
            before -= np.repeat(before[starts], lengths)
            places = np.arange(1, n + 1) - np.repeat(starts, lengths)
            if group is not None and groups[0] == group:
                before[: lengths[0]] += total
                places[: lengths[0]] += place
            group, place, total = groups[-1], int(places[-1]), int(before[-1] + values[-1])
            columns = [*batch.columns, pa.array(np.full(n, part), pa.int64()), pa.array(places, pa.int64()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*arrow_names, "_part", "_place", "_before"])

    laid = df.repartitionByRange(parts, F.col(by), *order).sortWithinPartitions(F.col(by), *order).mapInArrow(add_up, schema)
    laid = materialise(laid, label)
    pieces = laid.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_at")).agg(
        F.max("_place").alias("rows"), F.sum(value).alias("sum")
    )
    earlier = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("_by", "_at", F.sum("rows").over(earlier).alias("_rows"), F.sum("sum").over(earlier).alias("_sum")).filter("_rows > 0")
    return (
        laid.join(F.broadcast(offsets), (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_at")), "left")
        .withColumn("_place", F.col("_place") + F.coalesce("_rows", F.lit(0)))
        .withColumn("_before", F.col("_before") + F.coalesce("_sum", F.lit(0)))
        .drop("_by", "_at", "_rows", "_sum", "_part")
    )
