"""Order-based results (running totals, exact quantiles) without a single-task window.

A global window sorts everything in one task. Here the order column is cut into ranges at
approximate quantiles, each range is processed on its own, and the small table of range totals
supplies what came before. Cut points only steer the work: results are exact for any cuts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from stayscope.functions.expr import about_distinct
from stayscope.functions.hashing import digest
from stayscope.session import lookup_table, materialise

SINGLE_RANGE_ROWS = 1_000_000
MAX_RANGES = 1024
SKETCH_ACCURACY = 10_000


def range_cuts(
    df: DataFrame, order: str, rows_per_range: int = SINGLE_RANGE_ROWS, distinct: int | None = None
) -> list[float]:
    """Ascending cut points of a numeric column, none when one range can hold every distinct value.

    Both sketches have a fixed size.
    """
    if distinct is None:
        distinct = df.agg(about_distinct(F.col(order))).first()[0]
    ranges = min(MAX_RANGES, -(-distinct // rows_per_range))
    if ranges <= 1:
        return []
    grid = [i / ranges for i in range(1, ranges)]
    marks = df.agg(F.percentile_approx(F.col(order).cast("double"), grid, SKETCH_ACCURACY)).first()[0]
    return sorted(set(marks or []))


def text_cuts(df: DataFrame, order: str, ranges: int = 256) -> list[str]:
    """Cut points of a text column of distinct values, from a sample of bounded size."""
    sample = df.select(order).orderBy(digest("cuts", F.col(order)), order).limit(ranges * 16).collect()
    values = sorted({row[0] for row in sample})
    return values[16::16]


def with_range(df: DataFrame, order: str, cuts: Sequence[float] | Sequence[str]) -> DataFrame:
    """Add ``_range``: how many cut points lie at or below the value."""
    if not cuts:
        return df.withColumn("_range", F.lit(0.0))
    if isinstance(cuts[0], str):
        marks = F.array(*[F.lit(cut) for cut in cuts])
        return df.withColumn("_range", F.size(F.filter(marks, lambda cut: cut <= F.col(order))).cast("double"))
    splits = [float("-inf"), *cuts, float("inf")]
    bucketed = Bucketizer(
        splits=splits, inputCol="_order", outputCol="_range", handleInvalid="keep"
    ).transform(df.withColumn("_order", F.col(order).cast("double")))
    return bucketed.drop("_order")


def running_totals(
    df: DataFrame,
    order: str,
    totals: dict[str, str],
    by: Sequence[str] = (),
    cuts: Sequence[float] | Sequence[str] = (),
) -> DataFrame:
    """Add, per ``by`` group and ascending ``order``, the total of the rows strictly before.

    ``df`` has one row per (by, order). ``totals`` maps a new column to the summed column.
    """
    by = list(by)
    if not cuts:
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({new: F.coalesce(F.sum(old).over(before), F.lit(0)) for new, old in totals.items()})
    ranged = with_range(materialise(df, "totals"), order, cuts)
    ends = ranged.groupBy(*by, "_range").agg(*[F.sum(old).alias(f"_t_{new}") for new, old in totals.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = lookup_table(ends.select(
        *by, "_range",
        *[F.coalesce(F.sum(f"_t_{new}").over(earlier), F.lit(0)).alias(f"_s_{new}") for new in totals],
    ))
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return null_safe_join(ranged, starts, [*by, "_range"]).withColumns(
        {new: F.coalesce(F.sum(old).over(inside), F.lit(0)) + F.col(f"_s_{new}") for new, old in totals.items()}
    ).drop("_range", *[f"_s_{new}" for new in totals])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    condition = None
    for key in keys:
        term = left[key].eqNullSafe(renamed[f"_r_{key}"])
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    rows_per_range: int = SINGLE_RANGE_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``by`` group: columns ``by``, ``quantiles``.

    Values are counted first, so a value that fills a third of the table is one row afterwards.
    A column with few distinct values goes through the built-in ``percentile`` with those counts.
    Otherwise the values at the wanted positions are selected range by range, so no task holds
    or sorts a whole group.
    """
    return quantiles_of_counts(value_counts(df, value, by), probs, by, rows_per_range)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``_v`` (a number) and ``_n``: how often each value occurs, written. The one read of ``df``."""
    by = list(by)
    return materialise(
        df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")),
        "value-counts",
    )


def quantiles_of_counts(
    counted: DataFrame, probs: Sequence[float], by: Sequence[str] = (), rows_per_range: int = SINGLE_RANGE_ROWS
) -> DataFrame:
    """``by``, ``quantiles`` from ``value_counts``."""
    by, probs = list(by), [float(p) for p in probs]
    distinct = counted.agg(about_distinct(F.col("_v"))).first()[0]
    if distinct <= rows_per_range:
        return counted.groupBy(*by).agg(
            F.percentile("_v", F.array(*[F.lit(p) for p in probs]), F.col("_n")).alias("quantiles")
        )
    return _selected_quantiles(counted, by, probs, range_cuts(counted, "_v", rows_per_range, distinct))


def _selected_quantiles(counted: DataFrame, by: list[str], probs: list[float], cuts: Sequence[float]) -> DataFrame:
    ranged = with_range(counted, "_v", cuts)
    ends = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_rows"))
    group = Window.partitionBy(*by)
    starts = ends.select(
        *by, "_range", "_rows",
        F.sum("_rows").over(group).alias("_total"),
        (F.sum("_rows").over(group.orderBy("_range")) - F.col("_rows")).alias("_start"),
    )
    position = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_p") + 1) * (F.col("_total") - 1)
    wanted = (
        starts.withColumn("_p", F.explode(F.array(*[F.lit(i) for i in range(len(probs))])))
        .withColumn("_pos", position)
        .withColumns({"_low": F.floor("_pos"), "_high": F.ceil("_pos")})
    )
    end = F.col("_start") + F.col("_rows")
    touches = ((F.col("_low") >= F.col("_start")) & (F.col("_low") < end)) | (
        (F.col("_high") >= F.col("_start")) & (F.col("_high") < end)
    )
    # One row per range that holds a wanted position: few, whatever the number of values.
    targets = lookup_table(
        wanted.where(touches).groupBy(*by, "_range").agg(
            F.min("_start").alias("_start"),
            F.collect_list(F.struct("_p", "_pos", "_low", "_high")).alias("_targets"),
        )
    )
    inside = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        null_safe_join(ranged, targets, [*by, "_range"])
        .withColumn("_upto", F.sum("_n").over(inside) + F.col("_start"))
        .select(*by, "_v", "_n", "_upto", F.explode("_targets").alias("_t"))
    )
    first = F.col("_upto") - F.col("_n")

    def holds(rank: str) -> Column:
        return (F.col(f"_t.{rank}") >= first) & (F.col(f"_t.{rank}") < F.col("_upto"))

    per_prob = hits.where(holds("_low") | holds("_high")).groupBy(*by, F.col("_t._p").alias("_p")).agg(
        F.max(F.when(holds("_low"), F.col("_v"))).alias("_lv"),
        F.max(F.when(holds("_high"), F.col("_v"))).alias("_hv"),
        F.max("_t._pos").alias("_pos"),
    )
    share = F.col("_pos") - F.floor("_pos")
    answer = F.when(F.col("_lv") == F.col("_hv"), F.col("_lv")).otherwise(
        F.col("_lv") * (1 - share) + F.col("_hv") * share
    )
    packed = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("_p"), answer.alias("q")))), lambda pair: pair["q"]
    )
    return per_prob.groupBy(*by).agg(packed.alias("quantiles"))


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], rows_per_range: int = SINGLE_RANGE_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float] | None]:
    """Exact table-wide quantiles of several numeric columns; None for a column without values. NaN counts as missing.

    Two reads whatever the number of columns. The first merges rank sketches of fixed size, a reducer per column, and
    brackets each wanted position between two values. The second counts, for all columns together, the rows below, between
    and above the brackets, and the values inside them. A bracket holds about 6 / ``accuracy`` of a column's
    rows, one row per distinct value; only there positions are looked up, range by range.
    """
    if not columns:
        return {}
    probs = [float(p) for p in probs]
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    sizes, spans = _brackets(df, values, probs, accuracy)
    found: dict[str, list[float] | None] = {c: None for i, c in enumerate(columns) if i not in sizes}
    left = set(sizes)
    while left:
        ranks = {
            i: sorted({r for p in probs for r in (math.floor(p * (sizes[i] - 1)), math.ceil(p * (sizes[i] - 1)))}) for i in left
        }
        at = _values_at(df, {i: values[i] for i in left}, {i: spans[i] for i in left}, ranks, rows_per_range)
        for i in sorted(left):
            if any((i, rank) not in at for rank in ranks[i]):
                spans[i] = [(-math.inf, math.inf)]  # outside a sketch's promise: look at all values
                continue
            left.discard(i)
            found[columns[i]] = [_between(at, i, p * (sizes[i] - 1)) for p in probs]
    return found


def _between(at: dict[tuple[int, int], float], i: int, position: float) -> float:
    low, high = math.floor(position), math.ceil(position)
    if at[i, low] == at[i, high]:
        return at[i, low]
    return (high - position) * at[i, low] + (position - low) * at[i, high]


def _unpivoted(df: DataFrame, fields: dict[int, list[Column]]) -> DataFrame:
    """A row per row and column, with the column's number and its fields."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("column"), *made) for i, made in fields.items()])).alias("at")).select("at.*")


def _brackets(
    df: DataFrame, values: list[Column], probs: list[float], accuracy: int
) -> tuple[dict[int, int], dict[int, list[tuple[float, float]]]]:
    """Rows with a value, and disjoint ascending (low, high) around the wanted positions, per column that has values."""
    slack = 3.0 / accuracy
    marks = [m for p in probs for m in (max(0.0, p - slack), min(1.0, p + slack))]
    long = _unpivoted(df, {i: [v.alias("value")] for i, v in enumerate(values)}).where("value is not null")
    rows = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", marks, accuracy).alias("at")).collect()
    spans: dict[int, list[tuple[float, float]]] = {}
    for row in rows:
        kept: list[tuple[float, float]] = []
        for j, p in enumerate(sorted(probs)):
            at = 2 * sorted(range(len(probs)), key=probs.__getitem__)[j]
            low = -math.inf if p <= slack or row["n"] <= accuracy else row["at"][at]
            high = math.inf if p >= 1 - slack or row["n"] <= accuracy else row["at"][at + 1]
            if kept and low <= kept[-1][1]:
                kept[-1] = (kept[-1][0], max(high, kept[-1][1]))
            else:
                kept.append((low, high))
        spans[row["column"]] = kept
    return {row["column"]: row["n"] for row in rows}, spans


def _values_at(
    df: DataFrame, values: dict[int, Column], spans: dict[int, list[tuple[float, float]]], ranks: dict[int, list[int]],
    rows_per_range: int,
) -> dict[tuple[int, int], float]:
    """The value at each wanted rank (from 0) that lies inside a bracket of its column."""
    fields = {}
    for i, v in values.items():
        # Even outside the brackets, odd inside: 0 below the first, 1 in it, 2 after it, and so on.
        region = sum(((v >= low).cast("int") + (v > high).cast("int") for low, high in spans[i]), F.lit(0))
        fields[i] = [v.isNotNull().alias("there"), region.alias("region"), F.when(region % 2 == 1, v).alias("value")]
    counted = materialise(
        _unpivoted(df, fields).where("there").groupBy("column", "region", "value").agg(F.count(F.lit(1)).alias("n")), "brackets"
    )
    totals = counted.groupBy("column", "region").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).orderBy("column", "region").collect()
    wanted, ends = [], dict.fromkeys(values, 0)
    for row in totals:
        i, start = row["column"], ends[row["column"]]
        ends[i] += row["n"]
        if row["region"] % 2:
            wanted += [(i, row["region"], rank, rank - start) for rank in ranks[i] if start <= rank < ends[i]]
    inside = counted.where("region % 2 = 1")
    many = sum(row["distinct"] for row in totals if row["region"] % 2)
    cuts = range_cuts(inside, "value", rows_per_range, many) if many > rows_per_range else []
    placed = running_totals(inside, "value", {"before": "n"}, ["column", "region"], cuts)
    asked = df.sparkSession.createDataFrame(wanted, "column int, region int, rank bigint, place bigint")
    near = placed.join(F.broadcast(asked), ["column", "region"])  # two rows a column and probability at most
    hits = near.where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
    return {(row["column"], row["rank"]): row["value"] for row in hits.collect()}
