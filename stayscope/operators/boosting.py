"""Boosted classification trees whose columns are drawn once per tree.

Spark ML draws columns anew for every node. Here a tree sees one draw: its rows and columns are fixed before it grows.
Features are binned once; for each level of a tree the tasks add up gradient histograms of their rows, the sums are
merged and searched node by node in the executors, and only each node's best cut reaches the driver. Rows stay in packed
blocks in the shared folder and are kept by the executors between passes; a lost executor reads them again. Fits that are
made together share each pass. A table that one task holds, ``BLOCK_ROWS`` rows and ``BLOCK_BYTES`` at most, grows all its trees in that
task: there a pass costs more in starting tasks and handing blocks over than in adding.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql import types as T

from stayscope.session import materialise

#: What a task holds to grow all trees of a fit; a row has a byte a feature and five numbers.
BLOCK_ROWS, BLOCK_BYTES = 1 << 20, 128 << 20
#: Rows that are packed and added up at a time.
PACKED_ROWS = 65_536
BINS = 64
#: Trees after which the rows' margins are written anew; until then the executors keep those that the last tree moved.
REBASE = 20
#: Up to so many partitions send their histograms to the driver: a pass then needs no exchange.
DIRECT = 2
NODES = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()), T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()), T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("value", T.DoubleType()), T.StructField("cover", T.DoubleType()), T.StructField("gain", T.DoubleType()),
    T.StructField("drawn", T.ArrayType(T.IntegerType())),
])


@dataclass
class Tree:
    """Nodes as lists, the root first. A leaf has no children (-1) and a value; a row goes left if x <= threshold."""

    drawn: list[int]
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, start in ((self.feature, -1), (self.threshold, 0.0), (self.bin, -1), (self.left, -1), (self.right, -1),
                              (self.value, value), (self.cover, cover), (self.gain, 0.0)):
            column.append(start)
        return len(self.value) - 1

    def places(self, columns: np.ndarray, cuts: list, levels: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The node of each row (or of ``rows``) after ``levels`` steps; ``columns`` has a row per feature, ``cuts`` what they are
        compared with. A leaf leads to itself, and a right child follows its left one."""
        left, feature = np.array(self.left), np.array(self.feature)
        leaf, flat, width = left < 0, columns.ravel(), columns.shape[1]
        most = np.iinfo(columns.dtype).max if columns.dtype.kind == "u" else np.inf
        left, first = np.where(leaf, np.arange(len(left)), left), np.where(leaf, 0, feature) * width
        cut = np.where(leaf, most, cuts).astype(columns.dtype)
        rows = np.arange(width) if rows is None else rows
        node = np.zeros(len(rows), np.int64)
        for _ in range(levels if not leaf.all() else 0):
            node = left[node] + (flat[first[node] + rows] > cut[node])
        return node


def _noise(draws: np.ndarray, number: int) -> np.ndarray:
    """A number in [0, 1) from a row's hash and the tree's number."""
    with np.errstate(over="ignore"):
        x = draws.astype(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


@dataclass
class BoostedTrees:
    """A fitted ensemble. Margins are log-odds: ``base`` plus the leaves' values (step included)."""

    trees: list[Tree]
    n_features: int
    depth: int
    base: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        """All trees go down together; a leaf leads to itself, and a right child follows its left one."""
        sizes = [len(tree.value) for tree in self.trees]
        roots = np.cumsum([0, *sizes])[:-1].astype(np.int64)
        if not sizes:
            return np.full(len(x), self.base)
        left, feature, threshold, value = (np.concatenate([np.array(getattr(tree, c)) for tree in self.trees]) for c in ("left", "feature", "threshold", "value"))
        leaf = left < 0
        left = np.where(leaf, np.arange(len(left)), left + np.repeat(roots, sizes))
        feature, threshold = np.where(leaf, 0, feature), np.where(leaf, np.inf, threshold)
        out = np.empty(len(x))
        for start in range(0, len(x), 256):
            part = x[start: start + 256]
            flat, first = part.ravel(), (np.arange(len(part)) * part.shape[1])[:, None]
            node = np.tile(roots, (len(part), 1))
            for _ in range(self.depth):
                node = left[node] + (flat[first + feature[node]] > threshold[node])
            out[start: start + 256] = value[node].sum(axis=1)
        return self.base + out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add rawPrediction (half the log-odds, as Spark's boosted trees do), probability and prediction. Map-only."""
        model = self

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            return pd.Series(model.margins(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        m = F.col("_margin")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-m))
        return (
            df.withColumn("_margin", margin(vector_to_array("features")))
            .withColumn("rawPrediction", array_to_vector(F.array(-m / 2, m / 2)))
            .withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
            .withColumn("prediction", (m > 0).cast("double")).drop("_margin")
        )

    @property
    def featureImportances(self) -> DenseVector:
        """Mean gain of a feature's splits, scaled to a sum of 1."""
        total, splits = np.zeros(self.n_features), np.zeros(self.n_features)
        for tree in self.trees:
            inner = np.array(tree.left) >= 0
            np.add.at(total, np.array(tree.feature)[inner], np.array(tree.gain)[inner])
            np.add.at(splits, np.array(tree.feature)[inner], 1)
        mean = total / np.maximum(splits, 1)
        return Vectors.dense(mean / mean.sum() if mean.sum() else mean)

    def node_table(self, spark: SparkSession) -> DataFrame:
        """A row per node: as large as the model."""
        rows = [
            (t, i, tree.feature[i], tree.threshold[i], tree.left[i], tree.right[i], tree.value[i], tree.cover[i], tree.gain[i], tree.drawn)
            for t, tree in enumerate(self.trees) for i in range(len(tree.value))
        ]
        return spark.createDataFrame(rows, NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        table = self.node_table(spark).withColumns({
            "n_features": F.lit(self.n_features), "depth": F.lit(self.depth), "base": F.lit(self.base)
        })
        table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        trees: dict[int, Tree] = {}
        row = None
        for row in spark.read.parquet(path).orderBy("tree", "node").toLocalIterator():
            tree = trees.setdefault(row["tree"], Tree(list(row["drawn"])))
            at = tree.add(row["value"], row["cover"])
            tree.feature[at], tree.threshold[at], tree.left[at], tree.right[at], tree.gain[at] = (
                row["feature"], row["threshold"], row["left"], row["right"], row["gain"]
            )
        if row is None:
            raise ValueError(f"no trees in {path}")
        return BoostedTrees(list(trees.values()), row["n_features"], row["depth"], row["base"])


@dataclass(frozen=True)
class BoostedTreesClassifier:
    """Second-order boosting of the logistic loss.

    Expects ``features`` (vector), ``label`` (0 or 1) and ``weight``. Each tree is grown on ``sample`` of the rows and ``columns`` of
    the features, both drawn once for it. A node is split where the gain is largest (ties: the first column, the lowest cut),
    as long as both sides hold ``least`` of the loss's curvature; leaves pay -gradient / (curvature + penalty) x step.
    Equal rows share their draws, so results do not depend on partitioning but for the last digits of sums.
    """

    rounds: int = 300
    depth: int = 5
    step: float = 0.05
    sample: float = 0.8
    columns: float = 0.8
    penalty: float = 1.0
    least: float = 1.0
    seed: int = 42

    def getMaxIter(self) -> int:
        return self.rounds

    def getMaxDepth(self) -> int:
        return self.depth

    def getStepSize(self) -> float:
        return self.step

    def getSubsamplingRate(self) -> float:
        return self.sample

    def fit(self, df: DataFrame) -> BoostedTrees:
        return fit_together([(self, df)])[0]

    def _grow_all(self, blocks: list[tuple], draws: list[list[int]], cuts: list[np.ndarray]) -> Iterator[Tree]:
        """All trees of a table that its task holds. Margins move as those of larger tables do, digit by digit."""
        for number, drawn in enumerate(draws):
            growth, found = self._growth(number, drawn, cuts), None
            try:
                while True:
                    asked = growth.send(found)
                    found = dict(enumerate(self._search(one, asked.ends) for one in self._block_sums(blocks, asked)))
            except StopIteration as grown:
                tree = grown.value
            yield tree
            again = (number + 1) % REBASE == 0
            blocks = [
                (*kept, margin + moved, np.zeros(len(moved))) if again else (*kept, margin, moved)
                for *kept, margin, moved in (_moved_block(block, tree, self.depth) for block in blocks)
            ]

    def _growth(self, number: int, drawn: list[int], cuts: list[np.ndarray]) -> Generator[Level, dict[int, tuple], Tree]:
        """A tree; yields each level whose open nodes' best cuts it needs, and is sent them by place among the nodes."""
        tree = Tree(drawn)
        # the drawn columns' bins lie side by side: column j has those from ends[j] on
        ends = np.cumsum([0, *(len(cuts[feature]) + 1 for feature in drawn)])
        open_ = [tree.add(0.0, 0.0)]
        for level in range(self.depth):
            found = yield Level(tree, open_, number, level, ends)
            opened = []
            for at, node in enumerate(open_):
                total, gain, cell, lower = found[at]
                if level == 0:
                    tree.value[node], tree.cover[node] = self._leaf(*total), float(total[1])
                if gain <= 1e-12:
                    continue
                children = [tree.add(self._leaf(*side), float(side[1])) for side in (lower, total - lower)]
                column = int(np.searchsorted(ends, cell, side="right")) - 1
                feature, place = drawn[column], int(cell - ends[column])
                tree.feature[node], tree.bin[node], tree.threshold[node] = feature, place, float(cuts[feature][place])
                tree.left[node], tree.right[node], tree.gain[node] = *children, gain
                opened += children
            open_ = opened
            if not open_:
                break
        return tree

    def _leaf(self, gradient: float, curvature: float) -> float:
        return float(-gradient / (curvature + self.penalty) * self.step)

    def _best(self, sums: np.ndarray, total: np.ndarray, ends: np.ndarray) -> tuple[float, int, np.ndarray]:
        """The best cut of a node from its histogram (bins x 2): gain, bin, and the sums on its lower side."""
        running = sums.cumsum(axis=0)
        before = np.concatenate([np.zeros((1, 2)), running])[ends[:-1]]
        below = running - np.repeat(before, np.diff(ends), axis=0)
        above = total - below

        def worth(part: np.ndarray) -> np.ndarray:
            return part[..., 0] ** 2 / (part[..., 1] + self.penalty)

        usable = (below[:, 1] >= self.least) & (above[:, 1] >= self.least)
        usable[ends[1:] - 1] = False  # beyond the last cut of a column
        gain = np.where(usable, worth(below) + worth(above) - worth(total), -np.inf)
        cell = int(gain.argmax())
        return float(gain[cell]), cell, below[cell]

    def _search(self, sums: np.ndarray, ends: np.ndarray) -> tuple:
        """A node's sums and its best cut, from its histogram."""
        total = sums[: ends[1]].sum(axis=0)
        return total, *self._best(sums, total, ends)

    @staticmethod
    def _cuts_of(held: RDD, asked: dict[int, Asked]) -> dict[int, dict[int, tuple]]:
        """By fit, by place among its open nodes: their sums, and their best cut, over the drawn rows of all its blocks."""
        parts = held.mapPartitions(lambda blocks: [_part_sums(blocks, asked)])

        def search(fit: int, one: np.ndarray) -> tuple:
            return asked[fit].classifier._search(one, asked[fit].level.ends)

        if held.getNumPartitions() <= DIRECT:
            sums = parts.reduce(lambda a, b: a | {fit: a[fit] + one if fit in a else one for fit, one in b.items()})
            return {fit: dict(enumerate(search(fit, one) for one in all_)) for fit, all_ in sums.items()}

        nodes = [(fit, at) for fit, one in asked.items() for at in range(len(one.level.open))]
        first = {fit: nodes.index((fit, 0)) for fit in asked}

        def merge(key: int, sums: Iterable[tuple[int, np.ndarray]]) -> tuple:
            return search(nodes[key][0], reduce(np.add, [one for _, one in sorted(sums, key=itemgetter(0))]))

        # one histogram a node, merged in the partitions' order where it is searched; some nodes a task, as starting tasks takes longer
        keyed = parts.mapPartitionsWithIndex(lambda number, part: (
            (first[fit] + at, (number, one)) for sums in part for fit, all_ in sums.items() for at, one in enumerate(all_)
        ))
        found: dict[int, dict[int, tuple]] = {fit: {} for fit in asked}
        for key, best in keyed.groupByKey(-(-len(nodes) // (8 if len(asked) == 1 else 32))).map(lambda x: (x[0], merge(*x))).collect():
            fit, at = nodes[key]
            found[fit][at] = best
        return found

    def _block_sums(self, blocks: Iterable[tuple], asked: Level) -> np.ndarray:
        """Gradient and curvature by open node and bin over the drawn rows of blocks."""
        slot = np.full(len(asked.tree.value), -1)
        slot[asked.open] = np.arange(len(asked.open))
        sums = np.zeros((len(asked.open), int(asked.ends[-1]), 2))
        for block in blocks:
            self._add_block(sums, block, asked, slot)
        return sums

    def _add_block(self, sums: np.ndarray, block: tuple, asked: Level, slot: np.ndarray) -> None:
        """Add a block's drawn rows to the histograms, a column at a time so that what is added to stays in the cache."""
        bins, label, weight, draws, margin, since = block
        rows = np.flatnonzero(_noise(draws, asked.number) < self.sample)
        at = slot[asked.tree.places(bins, asked.tree.bin, asked.level, rows)]
        rows, at = rows[at >= 0], at[at >= 0]
        p = 1.0 / (1.0 + np.exp(-margin[rows] - since[rows]))
        amounts = weight[rows] * (p - label[rows]), weight[rows] * p * (1 - p)
        for feature, start, end in zip(asked.tree.drawn, asked.ends[:-1], asked.ends[1:]):
            cell = at * (end - start) + bins[feature][rows]
            for k, amount in enumerate(amounts):
                sums[:, start:end, k] += np.bincount(cell, amount, len(sums) * (end - start)).reshape(len(sums), -1)


@dataclass(frozen=True)
class Level:
    """What a growing tree asks of the rows: the best cuts of its open nodes."""

    tree: Tree
    open: list[int]
    number: int
    level: int
    ends: np.ndarray


@dataclass(frozen=True)
class Asked:
    """A level of one of the fits that grow together."""

    classifier: BoostedTreesClassifier
    level: Level


@dataclass(frozen=True)
class _Fit:
    """A fit that is under way."""

    classifier: BoostedTreesClassifier
    cuts: list[np.ndarray]
    rows: int
    blocks: DataFrame
    draws: list[list[int]]
    model: BoostedTrees

    @staticmethod
    def begin(classifier: BoostedTreesClassifier, df: DataFrame) -> _Fit:
        table = materialise(df.select(
            vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight")
        ), "boosting-rows")
        width = table.select(F.size("x")).first()[0]
        cuts = _cut_values(table, width)
        # no more tasks than blocks: passes over small tables are mostly the cost of starting tasks
        rows, size = table.count(), min(PACKED_ROWS, BLOCK_ROWS)
        blocks = materialise(_blocks(table.coalesce(max(1, -(-rows // size))), cuts, size), "boosting-blocks")
        generator = np.random.default_rng(classifier.seed)
        drawn = max(1, round(classifier.columns * width))
        draws = [sorted(generator.choice(width, drawn, replace=False).tolist()) for _ in range(classifier.rounds)]
        return _Fit(classifier, cuts, rows, blocks, draws, BoostedTrees([], width, classifier.depth))


def fit_together(work: list[tuple[BoostedTreesClassifier, DataFrame]]) -> list[BoostedTrees]:
    """Fit each classifier to its table. A pass serves a level of all fits, so that its tasks are started once; each
    fit's trees are those it grows alone, but for the last digits of sums."""
    spark = work[0][1].sparkSession
    with ThreadPoolExecutor(max_workers=len(work)) as pool:
        fits = [begun.result() for begun in [pool.submit(inheritable_thread_target(spark)(_Fit.begin), *one) for one in work]]
    small = {at: fit for at, fit in enumerate(fits) if fit.rows <= BLOCK_ROWS and fit.rows * (fit.model.n_features + 40) <= BLOCK_BYTES}
    if small:  # a task each: their levels need not be asked for one by one
        # a task a table
        kept = spark.sparkContext.union([_held(_numbered({at: fit}).coalesce(1)) for at, fit in small.items()])
        plan = {at: (fit.classifier, fit.draws, fit.cuts) for at, fit in small.items()}

        def grow_all(part: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int, Tree]]:
            blocks = list(part)
            for at in {at for at, _ in blocks}:
                classifier, draws, cuts = plan[at]
                yield from ((at, tree) for tree in classifier._grow_all([block for _, block in blocks], draws, cuts))

        for at, tree in kept.mapPartitions(grow_all).collect():
            fits[at].model.trees.append(tree)
    large = {at: fit for at, fit in enumerate(fits) if at not in small}
    if large:
        _grow_in_passes(spark, large)
    return [fit.model for fit in fits]


def _grow_in_passes(spark: SparkSession, fits: dict[int, _Fit]) -> None:
    """Grow the fits' trees side by side: a pass a level, for all of them."""
    blocks = _numbered(fits)
    # more tasks than cores would only be started for nothing
    parts = min(blocks.rdd.getNumPartitions(), max(DIRECT + 1, spark.sparkContext.defaultParallelism))
    held, before = _held(blocks.coalesce(parts)).persist(StorageLevel.MEMORY_AND_DISK), None
    based = 0
    rounds = max(len(fit.draws) for fit in fits.values())
    for number in range(rounds):
        growing = {at: fit.classifier._growth(number, fit.draws[number], fit.cuts) for at, fit in fits.items() if number < len(fit.draws)}
        grown, found = set(growing), dict.fromkeys(growing)
        while growing:
            asked = {}
            for at, growth in list(growing.items()):
                try:
                    asked[at] = Asked(fits[at].classifier, growth.send(found[at]))
                except StopIteration as end:
                    fits[at].model.trees.append(end.value)
                    del growing[at]
            if asked:
                found = BoostedTreesClassifier._cuts_of(held, asked)
        if before is not None:  # the margins it led to have been read by now
            before.unpersist()
        if number + 1 == rounds:
            break
        if number + 1 - based == REBASE:
            later = {at: (fit.model.trees[based:], fit.classifier.depth) for at, fit in fits.items()}
            blocks = materialise(_moved(blocks, later), "boosting-blocks")
            held.unpersist()
            before, held, based = None, _held(blocks.coalesce(parts)).persist(StorageLevel.MEMORY_AND_DISK), number + 1
        else:
            before, held = held, _after(held, {at: (fits[at].model.trees[-1], fits[at].classifier.depth) for at in grown})
    held.unpersist()


def _part_sums(blocks: Iterable[tuple[int, tuple]], asked: dict[int, Asked]) -> dict[int, np.ndarray]:
    """The histograms of a partition's blocks, by fit."""
    sums: dict[int, np.ndarray] = {}
    for fit, block in blocks:
        if fit in asked:
            one = asked[fit].classifier._block_sums([block], asked[fit].level)
            sums[fit] = sums[fit] + one if fit in sums else one
    return sums


def _sum_of(trees: list[Tree], bins: np.ndarray, depth: int) -> np.ndarray:
    total = np.zeros(bins.shape[1])
    for tree in trees:
        total += np.array(tree.value)[tree.places(bins, tree.bin, depth)]
    return total


def _cut_values(table: DataFrame, width: int) -> list[np.ndarray]:
    """Ascending cut values per feature, at most BINS - 1, from rank sketches: a reducer per feature."""
    marks = [i / BINS for i in range(1, BINS)]
    long = table.select(F.posexplode("x").alias("feature", "value"))
    rows = long.groupBy("feature").agg(F.percentile_approx("value", marks, 10_000).alias("cuts")).collect()
    found = {row["feature"]: np.unique(row["cuts"] or []) for row in rows}
    return [found.get(f, np.zeros(0)) for f in range(width)]


_BLOCK = "bins binary, label binary, weight binary, draws binary, margin binary"
_BLOCK_NAMES = ["bins", "label", "weight", "draws", "margin"]


def _blocks(table: DataFrame, cuts: list[np.ndarray], size: int) -> DataFrame:
    """Rows packed by column in blocks of about ``size`` rows."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= size:
                yield _packed(pa.Table.from_batches(kept), cuts)
                kept, rows = [], 0
        if rows:
            yield _packed(pa.Table.from_batches(kept), cuts)

    return table.select("x", "label", "weight", F.xxhash64("x", "label").alias("draw")).mapInArrow(pack, _BLOCK)


def _packed(rows: pa.Table, cuts: list[np.ndarray]) -> pa.RecordBatch:
    x = rows["x"].combine_chunks()
    values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    bins = np.stack([np.searchsorted(c, values[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.uint8)
    label, weight, draws = (rows[c].to_numpy() for c in ("label", "weight", "draw"))
    made = [bins, label, weight, draws, np.zeros(len(label))]
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in made], names=_BLOCK_NAMES)


def _unpacked(block: Row | dict) -> tuple:
    label, weight, margin = (np.frombuffer(block[c], np.float64) for c in ("label", "weight", "margin"))
    return np.frombuffer(block["bins"], np.uint8).reshape(-1, len(label)), label, weight, np.frombuffer(block["draws"], np.int64), margin


def _numbered(fits: dict[int, _Fit]) -> DataFrame:
    """The blocks of all fits, with the fit's number."""
    return reduce(DataFrame.unionByName, [fit.blocks.withColumn("fit", F.lit(at)) for at, fit in fits.items()])


def _held(blocks: DataFrame) -> RDD:
    """Unpacked blocks by fit, with a sum of later trees; what is lost is read from the written table again."""

    def start(block: Row) -> tuple:
        unpacked = _unpacked(block)
        return block["fit"], (*unpacked, np.zeros(len(unpacked[-1])))

    return blocks.rdd.map(start)


def _after(held: RDD, last: dict[int, tuple[Tree, int]]) -> RDD:
    """Kept blocks after one more tree of each fit, kept as well. Sums since the margins were written stay apart, so digits are as if summed anew."""
    return held.map(lambda kept: (kept[0], _moved_block(kept[1], *last[kept[0]]) if kept[0] in last else kept[1])).persist(StorageLevel.MEMORY_AND_DISK)


def _moved_block(block: tuple, tree: Tree, depth: int) -> tuple:
    *kept, since = block
    return *kept, since + _sum_of([tree], block[0], depth)


def _moved(blocks: DataFrame, later: dict[int, tuple[list[Tree], int]]) -> DataFrame:
    """Blocks with the margins after more trees."""

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                bins, *_, margin = _unpacked(block)
                block["margin"] = (margin + _sum_of(later[block["fit"]][0], bins, later[block["fit"]][1])).tobytes()
                yield pa.RecordBatch.from_pylist([block], schema=batch.schema)

    return blocks.mapInArrow(move, f"{_BLOCK}, fit int")


def log_loss(score: Column, label: Column, weight: Column) -> Column:
    """The weighted mean logistic loss, as an aggregate."""
    p = F.least(F.greatest(score, F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.sum(-weight * F.when(label == 1, F.log(p)).otherwise(F.log(1 - p))) / F.sum(weight)
