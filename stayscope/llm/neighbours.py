"""Approximate nearest neighbours (largest inner product) over balanced posting lists.

Index: vectors get one more coordinate that makes all lengths equal, so the largest inner product is the
smallest distance. Centroids are fitted on a bounded sample (``SAMPLE`` distinct vectors and ``SAMPLE_BYTES``, by hash):
k-means with centroids brought to the vectors' length, then every cluster with more than its share is cut in two, so lists
are balanced. The number of lists follows the square root of the number of distinct vectors. Every vector goes to its nearest list
and, if it lies near a border, to up to ``REPLICAS`` lists whose centroid is at most ``BORDER`` times as far and
nearer to the vector than to the centroids chosen before.

Search: a graph over the centroids, held in memory by each worker (at most ``CENTROIDS`` of them, so its
size is bounded), is walked from its middle towards a query; the walk goes on as long as it finds centroids
within a distance ratio of the nearest, and these lists are read. The ratio is measured when the index is fitted: it is the least that
reaches the share ``RECALL`` of the true neighbours of ``PROBES`` sampled vectors within the sample.

Lists are read in rounds, the nearest list first, then ``GROWTH`` times as many in each further round. Lists and the queries that
read them meet by an equality join of bounded blocks. A block returns the best of each query only, and after the first round only
what reaches the query's worst score so far, so what is sent on grows with the queries and not with the lists.

Equal vectors are one entry that keeps the smallest ids, k + 1 of them, which is exact as ties go to smaller ids. A vector
that fills a third of the table is thus one entry, and its queries are answered once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stayscope.session import materialise

SAMPLE = 65_536
SAMPLE_BYTES = 64 << 20
CENTROIDS = 8_192
LIST_SCALE = 2.5
REPLICAS = 3
BORDER = 1.1
RECALL = 0.96
GROWTH = 8
PROBES = 512
BLOCK = 4_096
STRIP = 1_024
DEGREE = 16
SALTS = 64


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components that is not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    """Centroids with the extra coordinate, their graph, and the length that all vectors are brought to."""

    centroids: np.ndarray
    graph: list[list[int]]
    start: int
    radius: float
    ratio: float = 1.0

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.radius ** 2 - (vectors ** 2).sum(axis=1), 0))
        return np.column_stack([vectors, rest])

    def lists(self, vectors: np.ndarray, replicas: int = REPLICAS, border: float = BORDER) -> list[list[int]]:
        """The nearest list of each vector and those across a near border."""
        out: list[list[int]] = []
        few = min(4 * replicas, len(self.centroids))
        for at in range(0, len(vectors), STRIP):
            far = _distances(self.lift(vectors[at: at + STRIP]), self.centroids)
            near = np.argpartition(far, few - 1, axis=1)[:, :few]
            far = np.take_along_axis(far, near, axis=1)
            order = np.lexsort((near, far), axis=1)
            near, far = np.take_along_axis(near, order, axis=1), np.take_along_axis(far, order, axis=1)
            taken = np.zeros(near.shape, bool)
            taken[:, 0] = True
            for j in range(1, few):
                gap = np.linalg.norm(self.centroids[near[:, j], None] - self.centroids[near[:, :j]], axis=2)
                apart = (~taken[:, :j] | (gap > far[:, j, None])).all(axis=1)
                taken[:, j] = apart & (far[:, j] <= border * far[:, 0]) & (taken.sum(axis=1) < replicas)
            out += [row[kept].tolist() for row, kept in zip(near, taken)]
        return out

    def goals(self, queries: np.ndarray) -> np.ndarray:
        """Queries in the lifted space, at the common length."""
        return np.column_stack([queries * (self.radius / np.linalg.norm(queries, axis=1))[:, None], np.zeros(len(queries))])

    def measured(self, sample: np.ndarray, k: int, recall: float = RECALL) -> Index:
        """This index with the ratio that finds ``recall`` of the ``k`` best of sampled queries in the sample."""
        queries = np.arange(0, len(sample), max(1, len(sample) // PROBES))
        few = min(k, len(sample) - 1)
        if few < 1:
            return self
        strips = []
        for at in range(0, len(queries), 32):
            own = queries[at: at + 32]
            scores = -(sample[own] @ sample.T)
            scores[np.arange(len(own)), own] = np.inf
            strips.append(np.argpartition(scores, few - 1, axis=1)[:, :few])
        best = np.concatenate(strips)
        holders = dict(zip(wanted := np.unique(best), self.lists(sample[wanted])))
        far = _distances(self.goals(sample[queries]), self.centroids)
        far /= np.maximum(far.min(axis=1, keepdims=True), 1e-12)
        needed = np.sort([far[i, holders[j]].min() for i, row in enumerate(best) for j in row])
        self.ratio = float(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1e-9
        return self

    def probe(self, query: np.ndarray) -> list[int]:
        """Lists whose centroid is within the ratio of the nearest one that the walk finds, nearest first."""
        ratio = self.ratio
        scale = np.linalg.norm(query)
        goal = np.append(query * (self.radius / scale), 0.0)
        far = {self.start: float(np.linalg.norm(self.centroids[self.start] - goal))}
        heap = [(far[self.start], self.start)]
        best = heap[0][0]
        misses = 0
        while heap:
            distance, at = heapq.heappop(heap)
            misses = misses + 1 if distance > ratio * best else 0
            if misses > DEGREE:
                break
            fresh = [c for c in self.graph[at] if c not in far]
            if fresh:
                found = np.linalg.norm(self.centroids[fresh] - goal, axis=1)
                best = min(best, float(found.min()))
                for c, d in zip(fresh, found.tolist()):
                    far[c] = d
                    heapq.heappush(heap, (d, c))
        return [c for d, c in sorted((d, c) for c, d in far.items() if d <= ratio * best)]


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    square = (left ** 2).sum(axis=1)[:, None] + (right ** 2).sum(axis=1) - 2 * left @ right.T
    return np.sqrt(np.maximum(square, 0))


def _kmeans(points: np.ndarray, count: int, radius: float, draw: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = points[draw.choice(len(points), count, replace=False)]
    for _ in range(rounds):
        own = _closest(points, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 0, total * (radius / np.where(length > 0, length, 1)), centres)
    return centres


def _closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(points[a: a + STRIP], centres).argmin(axis=1) for a in range(0, len(points), STRIP)])


def build_index(sample: np.ndarray, rows: int, radius: float, list_rows: int | None = None) -> Index:
    """Balanced centroids for about ``list_rows`` of ``rows`` each (by default in step with the square root), and their neighbour graph."""
    list_rows = list_rows or max(1, round(LIST_SCALE * rows ** 0.5))
    draw = np.random.default_rng(11)
    empty = Index(np.zeros((0, sample.shape[1] + 1)), [], 0, radius)
    points = empty.lift(sample)
    count = max(1, min(CENTROIDS // 2, -(-rows // list_rows), len(points)))
    centres = list(_kmeans(points, count, radius, draw))
    share = max(2.0, 1.5 * len(points) / count)
    own = _closest(points, np.array(centres))
    open_lists = list(range(count))
    while open_lists and len(centres) < CENTROIDS:
        at = open_lists.pop()
        members = np.flatnonzero(own == at)
        if len(members) <= share:
            continue
        halves = _kmeans(points[members], 2, radius, draw)
        side = _distances(points[members], halves).argmin(axis=1)
        if side.min() == side.max():
            continue
        centres[at] = halves[0]
        own[members[side == 1]] = len(centres)
        open_lists += [at, len(centres)]
        centres.append(halves[1])
    centroids = np.array(centres)
    graph: list[set[int]] = [set() for _ in centroids]
    for a in range(0, len(centroids), STRIP):
        near = np.argsort(_distances(centroids[a: a + STRIP], centroids), axis=1)[:, : DEGREE + 1]
        for i, row in enumerate(near, a):
            for j in map(int, row):
                if i != j:
                    graph[i].add(j)
                    graph[j].add(i)
    for i, j in enumerate(draw.permutation(len(centroids)).tolist()):  # long links keep the graph in one piece
        k = (i + 1) % len(centroids)
        for a, b in ((i, j), (i, k)):
            if a != b:
                graph[a].add(b)
                graph[b].add(a)
    start = int(_distances(centroids.mean(axis=0)[None], centroids).argmin())
    return Index(centroids, [sorted(g) for g in graph], start, radius)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            recall: float = RECALL, list_rows: int | None = None) -> DataFrame:
    """(query_id, rank, ``key``, score) of the ``k`` best other rows found for each row that ``is_query`` marks.

    Rows with a null key, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part. Vectors of different lengths have no product: each length has an index of its own, and a query meets
    the vectors of its length. Ties go to the smaller key. A key that repeats with
    equal vectors is one row; a query never meets rows of its own key. With fewer than ``k`` candidates all that are found
    are returned; an empty table gives no rows. Other columns are left out.
    """
    spark = vectors.sparkSession
    exact = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(f"array<{exact}>").alias("v"), is_query.alias("asks")
    ).filter(F.col("id").isNotNull() & usable(F.col("v")))
    found = spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    sizes = [r.size for r in rows.select(F.size("v").alias("size")).distinct().orderBy("size").collect()]  # a row per length
    for size in sizes:
        found = found.unionByName(_search(rows.filter(F.size("v") == size), size, exact, k, recall, list_rows))
    if len(sizes) > 1:  # a key may have vectors of several lengths
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(key), "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best (id, score) of every ``ask``."""
    once = found.groupBy("ask", "id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "id"))
    return once.withColumn("n", place).filter(F.col("n") <= k + 1).drop("n")


def _search(rows: DataFrame, size: int, exact: str, k: int, recall: float, list_rows: int | None) -> DataFrame:
    """(query_id, vec_id, score): the best of each query among ``rows`` (id, v, asks) of one length, k at least if there are as many."""
    spark = rows.sparkSession
    salted = Window.partitionBy("v", F.pmod("id", F.lit(SALTS))).orderBy("id")
    few = rows.groupBy("v", "id").agg(F.lit(1)).withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= k + 1)
    entries = few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    entries = materialise(entries.withColumn("entry", F.col("ids")[0]), "entries")
    square = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    facts = entries.agg(F.count("*").alias("n"), F.max(square).alias("square")).first()
    limit = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * size)))
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(limit).select("v").toArrow().column("v").combine_chunks()
    points = _matrix(sample)
    index = build_index(points, facts["n"], float(np.sqrt(facts["square"])), list_rows).measured(points, k, recall)
    shared = spark.sparkContext.broadcast(index)

    def posting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = shared.value.lists(_matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [shared.value.probe(q) for q in _matrix(batch.column("q"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    postings = entries.select("entry", "v", "ids").mapInArrow(posting, f"entry bigint, v array<{exact}>, ids array<bigint>, lists array<int>")
    postings = materialise(postings.withColumn("list", F.explode("lists")).drop("lists"), "postings")
    asking = rows.filter("asks").join(entries.select(F.col("v").alias("v2"), "entry"), F.col("v") == F.col("v2")).select("id", "entry", "v")
    asking = materialise(asking.dropDuplicates(["id", "entry"]), "asking")
    questions = asking.groupBy("entry").agg(F.first("v").alias("q")).withColumnRenamed("entry", "ask")
    questions = materialise(questions.mapInArrow(probing, f"ask bigint, q array<{exact}>, lists array<int>"), "questions")
    facing = postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))

    def best(asked: pa.Table, listed: pa.Table) -> pa.Table:
        found = {"ask": [], "id": [], "score": []}
        if asked.num_rows and listed.num_rows:
            v = _matrix(listed.column("v").combine_chunks())
            ids = listed.column("ids").to_pylist()
            asks = asked.column("ask").to_pylist()
            q = _matrix(asked.column("q").combine_chunks())
            floors = asked.column("floor").to_numpy()
            few = min(k + 9, len(v))
            for at in range(0, len(q), 256):
                products = q[at: at + 256] @ v.T
                near = np.argpartition(-products, few - 1, axis=1)[:, :few]
                for i, picked in enumerate(near, at):
                    scores = (v[picked] * q[i]).sum(axis=1)
                    kept = np.flatnonzero(scores >= floors[i])
                    pairs = ((-s, j) for s, e in zip(scores[kept].tolist(), picked[kept]) for j in ids[e])
                    ranked = heapq.nsmallest(k + 1, pairs)
                    found["ask"] += [asks[i]] * len(ranked)
                    found["id"] += [j for _, j in ranked]
                    found["score"] += [-s for s, _ in ranked]
        return pa.table({"ask": pa.array(found["ask"], pa.int64()), "id": pa.array(found["id"], pa.int64()), "score": pa.array(found["score"], pa.float64())})

    most = questions.agg(F.max(F.size("lists"))).first()[0] or 0
    first, width, found = 0, 1, None
    keys = ["list", "part", "side"]
    while first < most:
        asked = questions.select("ask", "q", F.explode(F.slice("lists", first + 1, width)).alias("list"))
        if found is None:
            asked = asked.withColumn("floor", F.lit(float("-inf")))
        else:
            floor = F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf"))
            floors = found.groupBy("ask").agg(floor.alias("floor"))
            asked = asked.join(floors, "ask", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        sides = questions.select(F.explode(F.slice("lists", first + 1, width)).alias("list")).groupBy("list")
        blocks = F.broadcast(facing.join(sides.agg(F.ceil(F.count("*") / BLOCK).alias("sides")), "list"))  # CENTROIDS rows at most

        def dealt(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
            here, there = ("part", "side") if own == "parts" else ("side", "part")
            spread = side.join(blocks, "list").withColumn(here, F.pmod(F.xxhash64(name), F.col(own)).cast("int"))
            return spread.withColumn(there, F.explode(F.sequence(F.lit(0), (F.col(other) - 1).cast("int"))))

        left = dealt(asked, "ask", "sides", "parts").select(*keys, "ask", "q", "floor")
        right = dealt(postings, "entry", "parts", "sides").select(*keys, "v", "ids")
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "ask bigint, id bigint, score double")
        found = materialise(_best(hits if found is None else found.unionByName(hits), k), "found")
        first, width = first + width, width * GROWTH
    if found is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    # A key with several vectors asks with each of them; the best of them count.
    mine = asking.select(F.col("id").alias("query_id"), F.col("entry").alias("ask")).join(found, "ask")
    pairs = mine.filter("id <> query_id").select("query_id", F.col("id").alias("vec_id"), "score")
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
