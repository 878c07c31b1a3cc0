"""Mixing sources to target weights by capped water-filling.

A source that would be repeated more than ``epochs`` times is clamped there, and what it leaves is shared by weight among the
others until no source is above its cap. A source's documents are then repeated a whole number of times, and a
seeded sample of them once more.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stayscope.llm.ordering import running
from stayscope.session import lookup_table, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Documents after a source's prefix that may fill the rest of its quota.
FILL = 4096


def targets(sources: DataFrame, epochs: float = 3.0) -> tuple[float, int]:
    """The level and how many sources are clamped: a source's target is the smaller of level x weight and its cap.

    ``sources`` has source_size and weight. Each round clamps the sources above their cap and shares the rest of
    the total anew; the level only rises, so a clamped source stays clamped and the rounds end.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = F.col("source_size") * epochs < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, F.col("source_size") * epochs)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if row[0] == clamped or not row[2]:
            return level, row[0]
        clamped, level = row[0], (total - (row[1] or 0.0)) / row[2]


def fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source's next documents those that still fit, in order; then the smallest one if that ends nearer to the quota."""
    rows = rows.sort_values("_place")
    gap, chosen, rest = float(rows["_gap"].iloc[0]), [], []
    for place, size in zip(rows["_place"], rows["size"]):
        if size <= gap:
            gap -= size
            chosen.append(place)
        else:
            rest.append((size, place))
    if rest and min(rest)[0] < 2 * gap:
        chosen.append(min(rest)[1])
    return pd.DataFrame({"_source": rows["_source"].iloc[0], "_taken": chosen}).astype("int64")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, key: str = "doc_id", text: str = "text",
    source: str = "source", seed: int = 12,
) -> DataFrame:
    """Per row of ``docs``: key, size (words), source, source_size, target (of the source), repeats and taken (size x repeats).

    Sources in code-point order, null last as a source of its own, weigh ``weights`` in turn and share the words of all
    documents; none gets more than ``epochs`` times its own. A document is repeated floor(target / source_size) times, and once
    more if it belongs to the seeded sample that fills the rest: in the order of a digest of the key, the longest run of documents
    that fits, then of the next 4,096 those that still fit, then one more if that ends nearer. Documents are
    never cut, so a source ends within half its smallest remaining document of its target. Rows equal in digest and size
    (repeated rows, null keys) are interchangeable; which of them is repeated does not show. Null and empty
    texts have size 0. Long texts count whole. An empty table gives no rows. Other columns take no part.

    Only keys and sizes move. A source of any share is dealt over many tasks; sources are a table, not a list on the driver.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))))
    sized = materialise(docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), size.alias("size"),
        F.conv(F.substring(drawn, 1, 15), 16, 10).cast("long").alias("_draw"),
    ), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).select("*", F.lit(0).cast("long").alias("_all"), F.lit(1).cast("long").alias("_one"))
    placed = running(materialise(sums, "sources"), "_all", [F.col("source").asc_nulls_last()], "_one", "source-order")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    placed = materialise(placed.select(
        "source", "source_size", F.col("_place").alias("_source"), F.element_at(turn, (F.pmod(F.col("_place") - 1, len(weights)) + 1).cast("int")).alias("weight")
    ), "weighted")
    level, _ = targets(placed, float(epochs))
    target = F.least(F.col("source_size").cast("double") * float(epochs), F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = placed.withColumn("target", target).withColumn("_whole", whole.cast("long"))
    aims = materialise(aims.withColumn("_quota", F.col("target") - F.col("_whole") * F.col("source_size")), "aims")

    side = lookup_table(aims.select(F.col("source").alias("_name"), "_source", "source_size", "target", "_whole", "_quota"))
    joined = sized.join(side, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    laid = running(materialise(joined, "aimed"), "_source", [F.col("_draw"), F.col("size")], "size", "drawn")
    fits = F.col("_before") + F.col("size") <= F.col("_quota")
    ends = laid.filter(~fits).groupBy("_source").agg(
        F.min("_place").alias("_end"), F.max(F.col("_quota") - F.col("_before")).alias("_gap")
    )
    ends = lookup_table(ends)
    near = laid.join(ends, "_source").filter((F.col("_place") >= F.col("_end")) & (F.col("_place") < F.col("_end") + FILL) & (F.col("size") > 0))
    filled = lookup_table(
        near.filter("_gap > 0").select("_source", "_place", "size", "_gap").groupBy("_source").applyInPandas(fill, "_source long, _taken long")
    )
    out = laid.join(filled.withColumnRenamed("_source", "_of"), (F.col("_source") == F.col("_of")) & (F.col("_place") == F.col("_taken")), "left")
    repeats = F.col("_whole") + F.when((fits & (F.col("size") > 0)) | F.col("_taken").isNotNull(), 1).otherwise(0)
    return out.select(
        F.col("key").alias(key), F.col("size"), F.col("source").alias(source), "source_size", "target",
        repeats.cast("long").alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"),
    )


def repeat_rows(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` says; ``key`` must tell the rows of both apart (null keys are left out)."""
    counts = mixed.filter("repeats > 0").select(F.col(key).alias("_key"), "repeats")
    joined = docs.join(counts, F.col(f"`{key}`") == F.col("_key")).withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    return joined.drop("_key", "repeats", "_again")
