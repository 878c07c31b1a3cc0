"""Path-dependent attributions for tree ensembles.

A leaf pays its value when a row meets the conditions on its path. If a feature is unknown, its
conditions hold with the share of training weight that went that way. For one leaf this is a
product game over the path's distinct features, so its Shapley values depend only on which of them the
row meets, and follow in polynomial time.

For many rows the leaves below a node are looked up together: what they pay depends on which conditions of the node's path a row
meets and on which way it goes at the inner nodes below. These bits number a case, and each case is computed once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from stayscope.operators.boosting import BoostedTrees
from stayscope.session import scratch_path

BLOCK_CELLS = 1 << 21
#: Leaves x rows that look their cases up at a time.
CASE_CELLS = 1 << 16
#: Bits of a case of leaves that are looked up together, and rows from which computing all cases pays; fewer rows take leaves one by one.
CASE_BITS, CASE_ROWS = 10, 1 << 12
#: Rows that go down a tree at a time, so that what they carry stays in the cache.
WALK_ROWS = 1 << 13


@dataclass
class Leaf:
    features: tuple[int, ...]
    low: np.ndarray  # a row meets feature j when low < x <= high
    high: np.ndarray
    share: np.ndarray
    value: float


@dataclass
class LeafGroup:
    """Leaves of one tree whose paths use the same number of distinct features."""

    features: np.ndarray  # leaves x d
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    def add(self, x: np.ndarray, phi: np.ndarray) -> None:
        """Add the attributions of these leaves for the rows ``x`` to ``phi``.

        They depend only on which of a leaf's features a row meets. Where that leaves fewer cases than there are rows,
        each case is computed once and rows look theirs up.
        """
        d = self.features.shape[1]
        cases = 1 << d if d < 32 and 1 << d <= len(x) else 0
        step = max(1, BLOCK_CELLS // ((cases or len(x)) * d))
        for at in range(0, len(self.value), step):
            some = slice(at, at + step)
            if cases:
                self._add_by_case(x, phi, some)
                continue
            seen = x[:, self.features[some]]
            met = ((seen > self.low[some]) & (seen <= self.high[some])).astype(float)
            gain = (_gains(self.share[some], met) * self.value[some, None]).reshape(len(x), -1)
            flat = self.features[some].ravel()
            for feature in np.unique(flat):
                phi[:, feature] += gain[:, flat == feature].sum(axis=1)

    def _add_by_case(self, x: np.ndarray, phi: np.ndarray, some: slice) -> None:
        used, low, high, value = self.features[some], self.low[some], self.high[some], self.value[some]
        leaves, d = used.shape
        met = (np.arange(1 << d)[:, None, None] >> np.arange(d) & 1).astype(float)
        # by place on the path: leaf and case to gain, and leaf to feature
        gains = np.ascontiguousarray((_gains(self.share[some], np.repeat(met, leaves, axis=1)) * value[:, None]).transpose(2, 1, 0)).reshape(d, -1)
        owner = (np.arange(x.shape[1])[:, None, None] == used.T).astype(float)
        rows = max(1, CASE_CELLS // leaves)
        for start in range(0, len(x), rows):
            columns = np.ascontiguousarray(x[start: start + rows].T)
            bits = np.zeros((leaves, columns.shape[1]), np.uint32)
            for j in range(d):
                seen = columns[used[:, j]]
                bits |= ((seen > low[:, j, None]) & (seen <= high[:, j, None])).astype(np.uint32) << np.uint32(j)
            case = (np.arange(leaves) << d)[:, None] + bits
            for j in range(d):
                phi[start: start + rows] += (owner[:, j] @ gains[j].take(case)).T


def _gains(share: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Shapley values of the product games: leaves x features of shares, cases x leaves x features of what is met.

    The weights of a product game are an integral over t in [0, 1] of the other features' factors
    share * (1 - t) + met * t. It is a polynomial of degree d - 1, so Gauss-Legendre quadrature with half
    as many points is exact: the work is leaves x d^2 for any depth, in blocks of bounded size.
    """
    points, weights = _quadrature((share.shape[-1] + 1) // 2)
    total = np.zeros_like(met)
    for t, weight in zip((points + 1) / 2, weights / 2):
        factor = share * (1 - t) + met * t
        before, after = np.ones_like(factor), np.ones_like(factor)
        before[..., 1:] = np.cumprod(factor[..., :-1], axis=-1)
        after[..., :-1] = np.cumprod(factor[..., :0:-1], axis=-1)[..., ::-1]
        total += weight * before * after
    return (met - share) * total


@lru_cache(maxsize=None)
def _quadrature(points: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(points)


@dataclass
class PathTree:
    """One tree. A row goes left if x <= threshold; a leaf's left child is -1; ``share`` is a node's part of its parent's training weight."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    value: np.ndarray

    def inner(self, at: int) -> list[int]:
        """The inner nodes from ``at`` down, a node before those below it."""
        found, waiting = [], [at]
        while waiting:
            node = waiting.pop()
            if self.left[node] >= 0:
                found.append(node)
                waiting += [int(self.right[node]), int(self.left[node])]
        return found

    def subtrees(self) -> list[Subtree]:
        """The largest subtrees whose cases have at most CASE_BITS bits; they hold every leaf once."""
        found: list[Subtree] = []
        waiting: list[tuple[int, dict[int, float]]] = [(0, {})]
        while waiting:
            at, path = waiting.pop()
            inner = self.inner(at)
            if len(path) + len(inner) <= CASE_BITS:
                found.append(Subtree(at, path, inner))
                continue
            waiting += [(int(child), self.below(path, at, child)) for child in (self.left[at], self.right[at])]
        return found

    def below(self, path: dict[int, float], at: int, child: int) -> dict[int, float]:
        """The distinct features on a child's path, in the order they are met, with their shares."""
        feature = int(self.feature[at])
        return {**path, feature: path.get(feature, 1.0) * self.share[child]}

    def add(self, columns: np.ndarray, phi: np.ndarray) -> None:
        """Add the tree's attributions to ``phi``; both have a row per feature, and all values are numbers above -inf."""
        ends = {one.root: (one, *self._table(one)) for one in self.subtrees()}
        for start in range(0, columns.shape[1], WALK_ROWS):
            self._walk(columns[:, start: start + WALK_ROWS], phi[:, start: start + WALK_ROWS], ends)

    def _walk(self, columns: np.ndarray, phi: np.ndarray, ends: dict) -> None:
        paid = np.empty(columns.shape[1])
        waiting: list[tuple[int, tuple[int, ...], np.ndarray]] = [(0, (), np.zeros(columns.shape[1], np.uint16))]
        while waiting:
            at, path, case = waiting.pop()
            if at in ends:
                one, used, table = ends[at]
                for place, node in enumerate(one.inner, len(path)):
                    case = case | self._goes_left(columns, node, place)
                spot = case.astype(np.intp)
                for feature, gains in zip(used, table):
                    phi[feature] += gains.take(spot, out=paid, mode="clip")
                continue
            feature = int(self.feature[at])
            place = path.index(feature) if feature in path else len(path)
            lefts, bit = self._goes_left(columns, at, place), np.uint16(1 << place)
            if place == len(path):
                path, cases = (*path, feature), (case | lefts, case | (lefts ^ bit))
            else:  # a condition that was not met stays so
                cases = case & (lefts | ~bit), case & ~lefts
            waiting += [(int(self.left[at]), path, cases[0]), (int(self.right[at]), path, cases[1])]

    def _goes_left(self, columns: np.ndarray, node: int, place: int) -> np.ndarray:
        return (columns[self.feature[node]] <= self.threshold[node]).astype(np.uint16) << np.uint16(place)

    def _table(self, one: Subtree) -> tuple[list[int], np.ndarray]:
        """The features that a subtree's leaves pay, and by feature and case what they pay together."""
        bits = len(one.path) + len(one.inner)
        number = np.arange(1 << bits)
        is_set = [(number >> place & 1).astype(bool) for place in range(bits)]
        met = {feature: is_set[place] for place, feature in enumerate(one.path)}
        place_of = {node: place for place, node in enumerate(one.inner, len(one.path))}
        used = sorted({*one.path, *(int(self.feature[node]) for node in one.inner)})
        table = np.zeros((len(used), 1 << bits))
        waiting = [(one.root, one.path, met)]
        leaves: dict[int, list[tuple]] = {}
        while waiting:
            at, path, met = waiting.pop()
            if self.left[at] < 0:
                leaves.setdefault(len(path), []).append((at, path, met))
                continue
            feature = int(self.feature[at])
            lefts = is_set[place_of[at]]
            for child, goes in ((int(self.left[at]), lefts), (int(self.right[at]), ~lefts)):
                waiting.append((child, self.below(path, at, child), {**met, feature: met[feature] & goes if feature in met else goes}))
        row = {feature: at for at, feature in enumerate(used)}
        for d, same in leaves.items():
            if d:
                gains = _case_gains(np.array([[*path.values()] for _, path, _ in same])) * self.value[[at for at, *_ in same]]
                for leaf, (_, path, met) in enumerate(same):
                    case = np.zeros(1 << bits, np.intp)
                    for j, feature in enumerate(path):
                        case |= met[feature].astype(np.intp) << j
                    for j, feature in enumerate(path):
                        table[row[feature]] += gains[j, :, leaf].take(case)
        return used, table


@dataclass
class Subtree:
    """Leaves that are looked up together: the distinct features above their root, with their shares, and the inner nodes from there on."""

    root: int
    path: dict[int, float]
    inner: list[int]


def _case_gains(share: np.ndarray) -> np.ndarray:
    """Shapley values of product games (games x features) as features x cases x games; bit j of a case says whether condition j is met."""
    games, d = share.shape
    met = (np.arange(1 << d)[:, None, None] >> np.arange(d) & 1).astype(float)
    return np.ascontiguousarray(_gains(share, np.repeat(met, games, axis=1)).transpose(2, 0, 1))


@dataclass
class TreeTables:
    """All leaves as arrays with the ensemble's expected output. As large as the model."""

    groups: list[LeafGroup]
    base_value: float
    constant: float = 0.0  # what every row is paid: the start of boosting and trees of a single leaf
    trees: list[PathTree] = field(default_factory=list)  # those of ``groups``

    def attribute(self, x: np.ndarray, width: int) -> np.ndarray:
        phi = np.zeros((len(x), width))
        # a value that is no number meets no condition, whichever way it is sent
        usual = (x > -np.inf).all(axis=1)
        if self.trees and usual.sum() >= CASE_ROWS:
            columns = np.ascontiguousarray(x[usual].T)
            sums = np.zeros((width, columns.shape[1]))
            for tree in self.trees:
                tree.add(columns, sums)
            phi[usual] = sums.T
            if not usual.all():
                phi[~usual] = self._by_leaf(x[~usual], width)
            return phi
        return self._by_leaf(x, width)

    def _by_leaf(self, x: np.ndarray, width: int) -> np.ndarray:
        phi = np.zeros((len(x), width))
        for group in self.groups:
            group.add(x, phi)
        return phi


def _node_rows(model: Model | BoostedTrees, spark: SparkSession) -> tuple[dict[int, dict[int, dict]], float, bool]:
    """Nodes per tree, what a tree's leaves are scaled by, and whether it is boosted."""
    if isinstance(model, BoostedTrees):
        boosted = {
            number: {
                i: {
                    "left": tree.left[i], "right": tree.right[i], "feature": tree.feature[i], "threshold": tree.threshold[i],
                    "categories": -1, "prediction": tree.value[i], "cover": tree.cover[i],
                }
                for i in range(len(tree.value))
            }
            for number, tree in enumerate(model.trees)
        }
        return boosted, 1.0, True
    trees: dict[int, dict[int, dict]] = {}
    for row in forest_nodes(model, spark).collect():
        trees.setdefault(row["tree"], {})[row["id"]] = row.asDict()
    return trees, 1.0 / len(trees), False


def forest_nodes(model: Model, spark: SparkSession) -> DataFrame:
    """A row per node of a Spark ML forest, as the saved model holds them."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("nodeData.split.numCategories").alias("categories"),
        F.col("nodeData.prediction").alias("prediction"),
        F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda a, v: a + v).alias("cover"),
        F.col("nodeData.impurityStats").alias("stats"),
    )


def _leaf_value(node: dict, boosted: bool) -> float:
    if boosted:
        return node["prediction"]
    return node["stats"][1] / node["cover"] if node["cover"] else 0.0


def _leaves(nodes: dict[int, dict], scale: float, boosted: bool) -> list[Leaf]:
    found: list[Leaf] = []
    waiting = [(0, {})]
    while waiting:
        at, path = waiting.pop()
        node = nodes[at]
        if node["left"] < 0:
            used = tuple(path)
            found.append(Leaf(
                used,
                np.array([path[f][0] for f in used]), np.array([path[f][1] for f in used]),
                np.array([path[f][2] for f in used]), scale * _leaf_value(node, boosted),
            ))
            continue
        if node["categories"] != -1:
            raise ValueError("categorical splits are not supported; features here are continuous")
        low, high, share = path.get(node["feature"], (-np.inf, np.inf, 1.0))
        for child, interval in (
            (node["left"], (low, min(high, node["threshold"]))),
            (node["right"], (max(low, node["threshold"]), high)),
        ):
            part = nodes[child]["cover"] / node["cover"]
            waiting.append((child, {**path, node["feature"]: (*interval, share * part)}))
    return found


def _grouped(leaves: list[Leaf]) -> list[LeafGroup]:
    """The leaves of one tree by number of distinct features on their path."""
    groups = []
    for d in sorted({len(leaf.features) for leaf in leaves} - {0}):
        same = [leaf for leaf in leaves if len(leaf.features) == d]
        groups.append(LeafGroup(
            np.array([leaf.features for leaf in same]),
            np.array([leaf.low for leaf in same]),
            np.array([leaf.high for leaf in same]),
            np.array([leaf.share for leaf in same]),
            np.array([leaf.value for leaf in same]),
        ))
    return groups


def _path_tree(nodes: dict[int, dict], scale: float, boosted: bool) -> PathTree:
    numbers = sorted(nodes)
    place = {number: at for at, number in enumerate(numbers)} | {-1: -1}
    rows = [nodes[number] for number in numbers]
    share = np.ones(len(rows))
    for row in rows:
        for child in (row["left"], row["right"]):
            if child >= 0:
                share[place[child]] = nodes[child]["cover"] / row["cover"]
    inner = [row["left"] >= 0 for row in rows]
    return PathTree(
        np.array([row["feature"] if is_inner else 0 for row, is_inner in zip(rows, inner)]),
        np.array([row["threshold"] if is_inner else 0.0 for row, is_inner in zip(rows, inner)], float),
        np.array([place[row["left"]] if is_inner else -1 for row, is_inner in zip(rows, inner)]),
        np.array([place[row["right"]] if is_inner else -1 for row, is_inner in zip(rows, inner)]),
        share, np.array([0.0 if is_inner else scale * _leaf_value(row, boosted) for row, is_inner in zip(rows, inner)]),
    )


def tree_tables(model: Model | BoostedTrees, spark: SparkSession) -> TreeTables:
    """Flatten a forest (probability of class 1) or boosted trees (log-odds of class 1)."""
    trees, scale, boosted = _node_rows(model, spark)
    groups: list[LeafGroup] = []
    paths: list[PathTree] = []
    short = True  # no path has more features than a case has bits
    base = constant = model.base if boosted else 0.0
    for number in sorted(trees):
        leaves = _leaves(trees[number], scale, boosted)
        constant += sum(leaf.value for leaf in leaves if not leaf.features)
        base += sum(leaf.value * float(np.prod(leaf.share)) for leaf in leaves)
        groups += _grouped(leaves)
        if max(len(leaf.features) for leaf in leaves) > CASE_BITS:
            short = False
        paths.append(_path_tree(trees[number], scale, boosted))
    return TreeTables(groups, base, constant, paths if short else [])
