"""Nearest neighbours in many dimensions by a forest of random-projection trees.

In a few dozen dimensions the triangle inequality rules out hardly any group, and an exact search compares nearly all
points with one another. Here each tree halves the points along random directions until a leaf holds about ``leaf_rows``;
a point meets only the points of its leaves, one per tree, keeps the nearest of each leaf, and the trees' candidates are
merged. Work, exchanged rows and written rows grow in proportion to the points and the trees. Trees are added until the
recall, measured against all points for a sample of bounded size, reaches its goal.

Trees grow from samples of bounded size, up to six levels a round, all nodes of all trees side by side; the cut
values are a table that is joined to the points, so no tree has to fit into one task or the driver. Up to ``leaf_rows`` points
are one leaf, and then the result is exact.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from stayscope.functions.hashing import digest, uniform
from stayscope.operators.neighbours import CHUNK, _matrix, _squared
from stayscope.session import materialise

LEAF_ROWS = 2048
#: Trees that are added at a time, and at most.
TREES, MOST_TREES = 8, 64
RECALL = 0.95
#: Points whose neighbours are also looked for among all points, to measure the recall.
PROBES = 256
LEVELS = 6
#: Points of a node that its cuts are chosen by: 64 for each of its up to 64 children.
SAMPLE_ROWS = 4096
#: A leaf may hold so much more than ``leaf_rows``, as cuts come from samples.
SPARE = 1.25


def directions(dims: int, tree: int, round_: int) -> np.ndarray:
    """The directions that all nodes of a tree are cut along in one round, one column a level."""
    return np.random.default_rng([42, tree, round_]).standard_normal((dims, LEVELS))


def median_cuts(projected: np.ndarray, depth: int) -> list[float]:
    """Cut values of a binary tree in level order: each node's median along its level's direction."""
    cuts, nodes = [], [np.arange(len(projected))]
    for level in range(depth):
        below = []
        for rows in nodes:
            values = projected[rows, level]
            cut = float(np.median(values)) if len(rows) else 0.0
            cuts.append(cut)
            below += [rows[values <= cut], rows[values > cut]]
        nodes = below
    return cuts


def descend(projected: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    """Which of the 2^depth children each row falls into; ``cuts`` has a row of cut values per row."""
    child = np.zeros(len(projected), np.int64)
    rows = np.arange(len(projected))
    for level in range(depth):
        child = 2 * child + (projected[:, level] > cuts[rows, (1 << level) - 1 + child])
    return child


def leaves(points: DataFrame, key: str, leaf_rows: int = LEAF_ROWS, trees: range = range(TREES)) -> DataFrame:
    """``points`` once per tree, with ``tree`` and ``node``: the leaf, unique within its tree."""
    dims = points.select(F.size("vec").alias("n")).first()
    each = F.explode(F.array(*[F.lit(tree) for tree in trees]))
    spread = points.withColumn("tree", each).withColumn("node", F.lit(0).cast("long"))
    if dims is None:
        return spread
    for round_ in range(64 // LEVELS):
        sizes = spread.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("rows"))
        large = materialise(sizes.where(F.col("rows") > (SPARE * leaf_rows if round_ else leaf_rows)), "large-nodes")
        if large.isEmpty():
            break
        cuts = _cut(spread, large, key, round_, dims["n"], leaf_rows)
        spread = materialise(_fall(spread, cuts, round_, dims["n"]), "leaves")
    return spread


def _cut(spread: DataFrame, large: DataFrame, key: str, round_: int, dims: int, leaf_rows: int) -> DataFrame:
    """(tree, node, depth, cuts) of the nodes that are too large."""

    def choose(sample: pd.DataFrame) -> pd.DataFrame:
        tree, node, rows = int(sample["tree"].iloc[0]), int(sample["node"].iloc[0]), int(sample["rows"].iloc[0])
        depth = min(LEVELS, int(np.ceil(np.log2(rows / leaf_rows))))
        projected = _matrix(sample["vec"]) @ directions(dims, tree, round_)
        return pd.DataFrame({"tree": [tree], "node": [node], "depth": [depth], "cuts": [median_cuts(projected, depth)]})

    draw = uniform(digest(f"cut {round_}", F.col(key), F.col("tree")))
    sample = spread.select(key, "vec", "tree", "node").join(large, ["tree", "node"]).where(draw * F.col("rows") < SAMPLE_ROWS)
    chosen = sample.groupBy("tree", "node").applyInPandas(choose, "tree int, node long, depth int, cuts array<double>")
    return materialise(chosen, "cuts")


def _fall(spread: DataFrame, cuts: DataFrame, round_: int, dims: int) -> DataFrame:
    """Every point moves to its child; a node without cuts keeps its points in its first child."""
    joined = spread.join(cuts, ["tree", "node"], "left")
    schema = spread.schema

    def fall(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            child = np.zeros(len(batch), np.int64)
            depths = batch["depth"].fillna(0).to_numpy().astype(int)
            for tree, depth in {*zip(batch["tree"], depths)}:
                rows = np.flatnonzero((batch["tree"].to_numpy() == tree) & (depths == depth))
                if depth:
                    projected = _matrix(batch["vec"].iloc[rows]) @ directions(dims, int(tree), round_)
                    child[rows] = descend(projected, np.stack(batch["cuts"].iloc[rows].to_numpy()), depth)
            yield batch.assign(node=(batch["node"].to_numpy() << LEVELS) | child)[schema.names]

    return joined.mapInPandas(fall, schema)


def nearest_by_forest(
    points: DataFrame, key: str, k: int, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, trees: int = TREES,
    most_trees: int = MOST_TREES,
) -> DataFrame:
    """The k nearest neighbours found for every point: ``key``, ``vec``, ``weight``, ``neighbours`` (k vectors).

    ``points`` is written and has ``key``, ``vec`` (array of doubles, distinct) and ``weight`` (rows that share the vector).
    Further copies of the point come first, then other vectors by distance and key, each as often as its weight. If
    ``most_trees`` do not reach ``recall``, a warning says what was reached.
    """
    best = forest_candidates(points, key, k, leaf_rows, recall, trees, most_trees)
    chosen = best.select(F.col(key).alias("_of"), F.explode("best").alias("near")).select("_of", "near.d2", "near.other")
    fetched = chosen.join(
        points.select(F.col(key).alias("other"), F.col("vec").alias("other_vec"), F.col("weight").alias("other_weight")), "other"
    )
    ordered = F.array_sort(F.collect_list(F.struct("d2", "other", "other_weight", "other_vec")))
    lists = fetched.groupBy(F.col("_of").alias(key)).agg(ordered.alias("found"))
    copies = F.transform("found", lambda h: F.array_repeat(h["other_vec"], F.least(h["other_weight"], F.lit(k)).cast("int")))
    own = F.array_repeat(F.col("vec"), F.least(F.col("weight") - 1, F.lit(k)).cast("int"))
    others = F.coalesce(F.flatten(copies), F.array().cast("array<array<double>>"))
    return points.select(key, "vec", "weight").join(lists, key, "left").withColumn(
        "neighbours", F.slice(F.concat(own, others), 1, k)
    ).drop("found")


def forest_candidates(
    points: DataFrame, key: str, k: int, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, trees: int = TREES,
    most_trees: int = MOST_TREES,
) -> DataFrame:
    """``key`` and ``best``: the k nearest other points found, (d2, other) by distance and key. Written."""
    key_type = points.schema[key].dataType
    found_schema = T.StructType([
        T.StructField(key, key_type), T.StructField("d2", T.ArrayType(T.DoubleType())), T.StructField("others", T.ArrayType(key_type)),
    ])

    def meet(leaf: pd.DataFrame) -> pd.DataFrame:
        return _nearest_in_leaf(leaf, key, k)

    plain, one_leaf = points.select(key, "vec"), points.count() <= leaf_rows
    truth = None if one_leaf else materialise(true_distances(plain, key, k), "probes")
    best, grown = None, 0
    while True:
        more = range(grown, grown + (1 if one_leaf else min(trees, most_trees - grown)))
        placed = leaves(plain, key, leaf_rows, more)
        pairs = F.zip_with("d2", "others", lambda d2, other: F.struct(d2.alias("d2"), other.alias("other")))
        met = placed.groupBy("tree", "node").applyInPandas(meet, found_schema).select(key, pairs.alias("met"))
        if best is not None:
            met = met.unionByName(best.select(key, F.col("best").alias("met")))
        # A point has one list per tree of this round, and the one kept so far.
        merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("met")))), 1, k)
        best, grown = materialise(met.groupBy(key).agg(merged.alias("best")), "candidates"), more.stop
        reached = 1.0 if one_leaf else found_share(best, truth, key)
        if reached >= recall:
            return best
        if grown >= most_trees:
            warnings.warn(f"{grown} trees reach a recall of {reached:.3f}, not {recall}", stacklevel=2)
            return best


def true_distances(points: DataFrame, key: str, k: int, probes: int = PROBES) -> DataFrame:
    """``key`` and ``within``: for a sample of points, the exact distance of the k-th nearest other point (squared)."""
    asked = points.orderBy(digest("probe", F.col(key)), key).limit(probes).toPandas()
    vecs, names = _matrix(asked["vec"]), asked[key].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = np.full((len(vecs), k), np.inf)
        for batch in batches:
            others, other_names = _matrix(batch["vec"]), batch[key].to_numpy()
            for start in range(0, len(batch), CHUNK):
                d2 = _squared(vecs, others[start: start + CHUNK])
                d2[names[:, None] == other_names[None, start: start + CHUNK]] = np.inf
                near = np.sort(np.concatenate([near, d2], axis=1), axis=1)[:, :k]
        rows, places = np.nonzero(np.isfinite(near))
        yield pd.DataFrame({key: names[rows], "d2": near[rows, places]})

    schema = T.StructType([points.schema[key], T.StructField("d2", T.DoubleType())])
    # k rows a probe and task
    nearest_k = F.slice(F.array_sort(F.collect_list("d2")), 1, k)
    return points.mapInPandas(scan, schema).groupBy(key).agg(nearest_k.alias("near")).select(
        key, F.element_at("near", -1).alias("within"), F.size("near").alias("n")
    )


def found_share(best: DataFrame, truth: DataFrame, key: str) -> float:
    """Share of the probes' nearest points that were found; points at equal distance stand for one another."""
    joined = best.join(F.broadcast(truth), key)  # a row per probe
    hits = F.least(F.size(F.filter("best", lambda b: b["d2"] <= F.col("within"))), F.col("n"))
    row = joined.agg(F.sum(hits), F.sum("n")).first()
    return row[0] / row[1] if row[1] else 1.0


def _nearest_in_leaf(leaf: pd.DataFrame, key: str, k: int) -> pd.DataFrame:
    """For each point of a leaf its k nearest others there, by distance and key."""
    leaf = leaf.sort_values(key)
    vecs, names = _matrix(leaf["vec"]), leaf[key].to_numpy()
    distances, others = [], []
    for start in range(0, len(leaf), CHUNK):
        rows, places, d2 = _near_pairs(vecs, start, k)
        ends = np.searchsorted(rows, np.arange(1, min(CHUNK, len(leaf) - start)))
        distances += np.split(d2, ends)
        others += np.split(names[places], ends)
    return pd.DataFrame({key: names, "d2": distances, "others": others})


def _near_pairs(vecs: np.ndarray, start: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, squared distance) of the k nearest others of a chunk of rows, by row, distance and place.

    A matrix product rules out what is too far whatever its rounding; the distances of the rest are summed one dimension at a time.
    """
    asked = vecs[start: start + CHUNK]
    norms = np.einsum("ij,ij->i", vecs, vecs)
    if np.isfinite(norms).all():
        rough = norms[start: start + CHUNK, None] + norms - 2 * (asked @ vecs.T)
        spare = 1e-15 * (vecs.shape[1] + 8) * 16 * norms.max(initial=0.0) + np.finfo(float).tiny
    else:
        rough, spare = _squared(asked, vecs), 0.0
    own = np.arange(len(asked))
    rough[own, start + own] = np.inf
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1: k] if len(vecs) > k else np.inf
    rows, places = np.nonzero((rough <= limit + spare) & np.isfinite(rough))
    d2 = np.zeros(len(rows))
    for dim in range(vecs.shape[1]):
        gap = asked[rows, dim] - vecs[places, dim]
        d2 += gap * gap
    order = np.lexsort((places, d2, rows))
    rows, places, d2 = rows[order], places[order], d2[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], places[first], d2[first]
