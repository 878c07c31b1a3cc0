"""Synthetic minority oversampling: grow the smaller class to the size of the larger one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stayscope.functions.hashing import digest, pick, uniform
from stayscope.operators.forest import nearest_by_forest
from stayscope.operators.neighbours import nearest
from stayscope.operators.split import class_counts, hash_cuts
from stayscope.session import materialise

COPIES_PER_TASK_ROW = 10_000


def synthetic_rows(
    df: DataFrame, features: list[str], minority: float, missing: int, label: str = "label",
    key: str = "row_id", k: int = 5, seed: object = 42, block_rows: int | None = None,
    copies_per_row: int = COPIES_PER_TASK_ROW,
) -> DataFrame:
    """Exactly ``missing`` new minority rows, each between a minority row and one of its k nearest.

    Every minority row is a parent equally often; the remainder goes to the rows with the least
    digests. Rows with equal features share one neighbour search. A point with very many copies
    to make is cut into portions first, so it does not fall to one task.

    Neighbours come from a forest, whose work grows in proportion to the rows in any number of dimensions. With
    ``block_rows`` they come from the exact search in blocks of so many rows, which suits few dimensions.
    """
    rows = df.where(F.col(label) == F.lit(minority))
    n = rows.count()
    if n <= k:
        raise ValueError(f"{n} minority rows; more than k = {k} are needed")
    base, rest = divmod(missing, n)
    extra = (hash_cuts(rows, key, seed, counts=[rest]).part() == 0).cast("bigint") if rest else F.lit(0).cast("bigint")
    vec = F.array(*[F.col(c).cast("double") for c in features])
    points = materialise(
        rows.select(F.col(key), vec.alias("vec"), (F.lit(base) + extra).alias("copies"))
        .groupBy("vec")
        .agg(F.min(key).alias(key), F.count(F.lit(1)).alias("weight"), F.sum("copies").alias("copies"))
        .select(key, "vec", "weight", "copies"),
        "points",
    )
    parents = points.where("copies > 0").select(key, "copies")
    vectors = points.select(key, "vec", "weight")
    near = nearest(vectors, key, k, block_rows) if block_rows else nearest_by_forest(vectors, key, k)
    found = near.join(parents, key)
    most = points.agg(F.max("copies")).first()[0]
    if most > copies_per_row:
        portions = F.ceil(F.col("copies") / F.lit(copies_per_row)).cast("bigint")
        found = (
            found.withColumn("_portion", F.explode(F.sequence(F.lit(0).cast("bigint"), portions - 1)))
            .repartition(F.col(key), F.col("_portion"))
        )
        first = F.col("_portion") * copies_per_row + 1
        last = F.least((F.col("_portion") + 1) * copies_per_row, F.col("copies"))
    else:
        first, last = F.lit(1).cast("bigint"), F.col("copies")
    drawn = found.withColumn("_copy", F.explode(F.sequence(first, last)))
    draw = digest(seed, F.col(key), F.col("_copy"))
    mixed = F.zip_with(
        "vec", F.element_at(F.col("neighbours"), F.col("_which") + 1),
        lambda x, y: x + F.col("_u") * (y - x),
    )
    return (
        drawn.withColumns({"_u": uniform(draw, 0), "_which": pick(draw, k, 1)})
        .withColumn("_mixed", mixed)
        .select(
            F.lit(minority).cast("double").alias(label),
            *[F.col("_mixed")[i].alias(c) for i, c in enumerate(features)],
        )
    )


def smote(
    df: DataFrame, features: list[str], label: str = "label", key: str = "row_id",
    k: int = 5, seed: object = 42, block_rows: int | None = None,
) -> DataFrame:
    """The table with both classes equally large. New rows have a null key and ``synthetic`` set."""
    counts = class_counts(df, label)
    if len(counts) != 2:
        raise ValueError(f"two classes are needed, found {sorted(counts)}")
    minority = min(counts, key=lambda value: (counts[value], -value))
    missing = max(counts.values()) - counts[minority]
    original = df.select(
        key, F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in features]
    ).withColumn("synthetic", F.lit(False))
    if missing == 0:
        return original
    new = synthetic_rows(df, features, minority, missing, label, key, k, seed, block_rows)
    return original.unionByName(new.withColumn("synthetic", F.lit(True)), allowMissingColumns=True)
