"""Exact stratified splits and folds as a row-local expression.

Rows are ordered within their class by a digest of their key. The digest value at each wanted
position is looked up once; afterwards a row's part follows from comparing its own digest with
those few values, so no class is sorted or gathered and re-running a task gives the same parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayscope.functions.hashing import digest

PREFIX_DIGITS = 4


@dataclass(frozen=True)
class HashCuts:
    """Per class: the greatest digest of every part but the last."""

    by: str | None
    key: str
    seed: object
    bounds: tuple[tuple[object, tuple[str, ...]], ...]

    def part(self) -> Column:
        own = digest(self.seed, F.col(self.key))

        def number(ends: tuple[str, ...]) -> Column:
            return sum(((own > F.lit(end)).cast("int") for end in ends), F.lit(0))

        if self.by is None:
            return number(self.bounds[0][1])
        chosen = F.lit(0)
        for value, ends in self.bounds:
            chosen = F.when(F.col(self.by).eqNullSafe(F.lit(value)), number(ends)).otherwise(chosen)
        return chosen


def hash_cuts(
    df: DataFrame, key: str, seed: object, by: str | None = None,
    shares: Sequence[float] = (), counts: Sequence[int] = (),
) -> HashCuts:
    """Find where the cumulative ``shares`` (rounded) or ``counts`` of each class end.

    First pass: rows per class and digest prefix, at most 65,536 prefixes. Second pass: only the
    prefixes that hold a cut are ordered, about one row in 65,536 each.
    """
    group = F.col(by) if by else F.lit(0)
    hashed = df.select(group.alias("_by"), digest(seed, F.col(key)).alias("_digest")).withColumn(
        "_prefix", F.substring("_digest", 1, PREFIX_DIGITS)
    )
    per_prefix = hashed.groupBy("_by", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_by")
    spans = per_prefix.select(
        "_by", "_prefix",
        (F.sum("_n").over(whole.orderBy("_prefix")) - F.col("_n")).alias("_start"),
        F.sum("_n").over(whole.orderBy("_prefix")).alias("_end"),
        F.sum("_n").over(whole).alias("_total"),
    )
    if shares:
        ranks = F.array(*[F.round(F.lit(float(s)) * F.col("_total")).cast("bigint") for s in shares])
    else:
        ranks = F.array(*[F.lit(int(c)).cast("bigint") for c in counts])
    cuts = len(shares or counts)
    held = spans.select("*", F.posexplode(ranks).alias("_cut", "_rank"))
    rows = held.where(
        ((F.col("_rank") > F.col("_start")) & (F.col("_rank") <= F.col("_end")))
        | ((F.col("_rank") <= 0) & (F.col("_start") == 0))
    ).collect()
    classes = {row["_by"] for row in rows}
    ends: dict[object, list[str]] = {value: ["g"] * cuts for value in classes}
    for row in rows:
        if row["_rank"] <= 0:
            ends[row["_by"]][row["_cut"]] = ""
    wanted = [row for row in rows if row["_rank"] > 0]
    if wanted:
        place = F.row_number().over(Window.partitionBy("_by", "_prefix").orderBy("_digest"))
        near = hashed.where(F.col("_prefix").isin(*{row["_prefix"] for row in wanted}))
        asked = df.sparkSession.createDataFrame(
            [(row["_by"], row["_prefix"], row["_cut"], row["_rank"] - row["_start"]) for row in wanted],
            f"_by2 {hashed.schema['_by'].dataType.simpleString()}, _prefix2 string, _cut int, _place bigint",
        )
        found = near.withColumn("_p", place).join(
            F.broadcast(asked),  # one row per class and cut
            F.col("_by").eqNullSafe(F.col("_by2")) & (F.col("_prefix") == F.col("_prefix2")) & (F.col("_p") == F.col("_place")),
        )
        for row in found.select("_by", "_cut", "_digest").collect():
            ends[row["_by"]][row["_cut"]] = row["_digest"]
    return HashCuts(by, key, seed, tuple((value, tuple(e)) for value, e in ends.items()))


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "row_id", test_share: float = 0.2, seed: object = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): within each class exactly round((1 - share) * n) rows train."""
    part = hash_cuts(df, key, seed, label, shares=[1 - test_share]).part()
    return df.where(part == 0), df.where(part == 1)


def stratified_folds(
    df: DataFrame, k: int = 5, label: str = "label", key: str = "row_id", seed: object = 42
) -> DataFrame:
    """Add ``fold`` 0..k-1; fold sizes within a class differ by at most one."""
    cuts = hash_cuts(df, key, seed, label, shares=[(i + 1) / k for i in range(k - 1)])
    return df.withColumn("fold", cuts.part())


def class_counts(df: DataFrame, label: str = "label") -> dict[float, int]:
    return {row[label]: row["count"] for row in df.groupBy(label).count().collect()}


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (classes * n of the class): every class weighs the same in total."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, size in counts.items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(n / (len(counts) * size))).otherwise(weight)
    return df.withColumn("weight", weight)
