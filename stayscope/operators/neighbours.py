"""Exact k nearest neighbours within one table.

Points are grouped around pivots and each group is cut into blocks of bounded size. A point's own
block yields an upper bound for the distance to its k-th neighbour; the triangle inequality then
rules out whole groups. Only the remaining (block, block) pairs meet, each in one task that holds
two blocks, and only distances within the bound leave it. No pair of groups is crossed wholesale
and nothing is dropped: the result equals a full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from stayscope.functions.hashing import digest
from stayscope.session import materialise

BLOCK_ROWS = 4096
MAX_PIVOTS = 1024
CHUNK = 256
SLACK = 1.0 + 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed one dimension at a time (no cancellation)."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def _kth_bound(queries: pd.DataFrame, base: pd.DataFrame, k: int) -> np.ndarray:
    """Distance within which each query has k neighbours in ``base``; copies count, itself not."""
    qx, bx = _matrix(queries["vec"]), _matrix(base["vec"])
    weights = base["weight"].to_numpy()
    bounds = np.full(len(queries), np.inf)
    near = min(len(base), k + 1)
    for start in range(0, len(queries), CHUNK):
        d2 = _squared(qx[start : start + CHUNK], bx)
        picked = np.argpartition(d2, near - 1, axis=1)[:, :near] if near < len(base) else np.argsort(d2, axis=1)
        for i, row in enumerate(picked):
            row = row[np.argsort(d2[i, row], kind="stable")]
            seen = np.cumsum(weights[row]) - 1
            enough = np.nonzero(seen >= k)[0]
            if len(enough):
                bounds[start + i] = np.sqrt(d2[i, row[enough[0]]])
    return bounds


def nearest(
    points: DataFrame, key: str, k: int, block_rows: int = BLOCK_ROWS, seed: object = "pivots"
) -> DataFrame:
    """The k nearest neighbours of every point: ``key``, ``vec``, ``neighbours`` (k vectors).

    ``points`` has ``key``, ``vec`` (array of doubles, distinct) and ``weight`` (how many rows share
    the vector). Further copies of the point itself come first, then other vectors by distance and
    key, each as often as its weight.
    """
    n = points.count()
    groups = min(MAX_PIVOTS, -(-n // block_rows))
    pivots = np.array(
        [row["vec"] for row in points.orderBy(digest(seed, F.col(key)), key).limit(groups).select("vec").collect()]
    )
    key_type = points.schema[key].dataType
    grouped = _assign(points, pivots)
    if groups > 1:
        grouped = materialise(grouped, "groups")
        sizes = {r["group"]: (r["n"], r["radius"]) for r in grouped.groupBy("group").agg(
            F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).collect()}
    else:
        sizes = {0: (n, 0.0)}
    blocks = np.array([max(1, -(-sizes.get(g, (0, 0.0))[0] // block_rows)) for g in range(len(pivots))])
    radii = np.array([sizes.get(g, (0, -1.0))[1] for g in range(len(pivots))])
    many = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("group") + 1)
    spread = F.pmod(F.xxhash64(key), many).cast("int") if blocks.max() > 1 else F.lit(0)
    blocked = grouped.withColumn("block", spread).drop("reach")

    vec = T.ArrayType(T.DoubleType())
    bounded_schema = T.StructType(
        [T.StructField(key, key_type), T.StructField("vec", vec), T.StructField("group", T.IntegerType()),
         T.StructField("block", T.IntegerType()), T.StructField("bound", T.DoubleType())]
    )

    def bound(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[[key, "vec", "group", "block"]].assign(bound=_kth_bound(rows, rows, k))

    bounded = blocked.groupBy("group", "block").applyInPandas(bound, bounded_schema)

    targeted_schema = T.StructType(bounded_schema.fields + [T.StructField("to_group", T.IntegerType())])
    targeted = bounded.mapInPandas(_target_groups(pivots, radii), targeted_schema)
    many_to = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("to_group") + 1)
    asked = targeted.withColumn("to_block", F.explode(F.sequence(F.lit(0), many_to - 1)))
    if groups > 1:
        asked = materialise(asked, "asked")
    meeting = ["group", "block", "to_group", "to_block"]
    visit = [f"visit_{c}" for c in meeting]
    pairs = asked.select(*[F.col(c).alias(v) for c, v in zip(meeting, visit)]).distinct()
    offered = pairs.join(
        blocked.select(
            F.col(key), "vec", "weight", F.col("group").alias("visit_to_group"), F.col("block").alias("visit_to_block")
        ),
        ["visit_to_group", "visit_to_block"],
    )
    hit_schema = T.StructType(
        [T.StructField(key, key_type), T.StructField("d2", T.DoubleType()), T.StructField("other", key_type),
         T.StructField("weight", T.LongType()), T.StructField("other_vec", vec)]
    )

    def meet(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        return _within_bounds(queries, base, key, k)

    hits = asked.groupBy(*meeting).cogroup(offered.groupBy(*visit)).applyInPandas(meet, hit_schema)
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("d2", "other", "weight", "other_vec"))), 1, k)
    merged = hits.groupBy(key).agg(ordered.alias("found"))
    copies = F.transform("found", lambda h: F.array_repeat(h["other_vec"], F.least(h["weight"], F.lit(k)).cast("int")))
    own = F.array_repeat(F.col("vec"), F.least(F.col("weight") - 1, F.lit(k)).cast("int"))
    others = F.coalesce(F.flatten(copies), F.array().cast("array<array<double>>"))
    return blocked.select(key, "vec", "weight").join(merged, key, "left").withColumn(
        "neighbours", F.slice(F.concat(own, others), 1, k)
    ).drop("found")


def _assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``group`` (nearest pivot) and ``reach`` (distance to it)."""
    schema = T.StructType(
        points.schema.fields + [T.StructField("group", T.IntegerType()), T.StructField("reach", T.DoubleType())]
    )

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d2 = _squared(_matrix(batch["vec"]), pivots)
            group = d2.argmin(axis=1)
            yield batch.assign(group=group.astype("int32"), reach=np.sqrt(d2[np.arange(len(batch)), group]))

    return points.mapInPandas(assign, schema)


def _target_groups(pivots: np.ndarray, radii: np.ndarray):
    """For each query, the groups that may hold a point within its bound."""
    between = np.sqrt(_squared(pivots, pivots))

    def target(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            to_pivot = np.sqrt(_squared(_matrix(batch["vec"]), pivots))
            own = batch["group"].to_numpy()
            bound = batch["bound"].to_numpy()[:, None] * SLACK + 1e-12
            home = to_pivot[np.arange(len(batch)), own][:, None]
            gap = between[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(gap > 0, (to_pivot**2 - home**2) / (2 * gap), 0.0)
            possible = (radii >= 0) & (to_pivot - radii * SLACK <= bound) & (plane <= bound)
            possible[np.arange(len(batch)), own] = True
            rows, groups = np.nonzero(possible)
            yield batch.iloc[rows].assign(to_group=groups.astype("int32"))

    return target


def _within_bounds(queries: pd.DataFrame, base: pd.DataFrame, key: str, k: int) -> pd.DataFrame:
    """Per query, its k nearest base points within the bound (all ties of the k-th included)."""
    out: list[pd.DataFrame] = []
    if len(queries) and len(base):
        qx, bx = _matrix(queries["vec"]), _matrix(base["vec"])
        keys, names = queries[key].to_numpy(), base[key].to_numpy()
        limit = (queries["bound"].to_numpy() * SLACK + 1e-12) ** 2
        for start in range(0, len(queries), CHUNK):
            d2 = _squared(qx[start : start + CHUNK], bx)
            d2[keys[start : start + CHUNK, None] == names[None, :]] = np.inf
            if d2.shape[1] > k:
                cap = np.minimum(limit[start : start + CHUNK], np.partition(d2, k - 1, axis=1)[:, k - 1])
            else:
                cap = limit[start : start + CHUNK]
            i, j = np.nonzero((d2 <= cap[:, None]) & np.isfinite(d2))
            out.append(pd.DataFrame({
                key: keys[start + i], "d2": d2[i, j], "other": names[j],
                "weight": base["weight"].to_numpy()[j], "other_vec": base["vec"].to_numpy()[j],
            }))
    if not out:
        return pd.DataFrame({key: [], "d2": [], "other": [], "weight": [], "other_vec": []})
    return pd.concat(out, ignore_index=True)
