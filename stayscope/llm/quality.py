"""Quality classification by support vectors on naive Bayes features.

Features are indicators of word n-grams and of n-grams over word shapes (letters of one case, digits
and punctuation as classes), hashed into ``SLOTS``. All labelled rows are counted, in Spark, into one
log-count ratio per slot, a table of fixed size. The ratios scale the indicators; a linear hinge-loss
model is fitted by dual coordinate descent on a bounded sample (``SAMPLE`` labelled rows,
half of each class, by a hash of the text), and a logistic curve fitted on rows kept out of the descent
turns margins into probabilities at the true class shares. Scoring is map-only.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stayscope.llm.common import slices, utf8
from stayscope.session import materialise

SLOTS = 1 << 18
SAMPLE = 8_000
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 20
THRESHOLD = 0.3
_SHAPES = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 if c in (9, 11, 12, 13) else c
    for c in range(256)
)
_RUNS = re.compile(rb"([Aa0])\1+")
_MANY = re.compile(rb"([^Aa0\s])\1{2,}")


def features(text: bytes) -> np.ndarray:
    """Sorted slots of the indicators that a text has."""
    words = text.lower().split()
    shapes = _MANY.sub(rb"\1\1\1", _RUNS.sub(rb"\1", text.translate(_SHAPES))).replace(b"\n", b" \n ").split(b" ")
    shapes = [s for s in shapes if s]
    grams: set[bytes] = {b"b"}
    grams.update(b"w" + w for w in set(words))
    grams.update(b"v" + a + b" " + b for a, b in set(zip(words, words[1:])))
    grams.update(b"s" + s for s in set(shapes))
    grams.update(b"t" + a + b" " + b for a, b in set(zip(shapes, shapes[1:])))
    grams.update(b"u" + b" ".join(g) for g in set(zip(shapes, shapes[1:], shapes[2:])))
    repeats = Counter(zip(words, words[1:], words[2:], words[3:]))
    if repeats:  # an n-gram that returns is an indicator of its own, by how much of the text its kind fills
        again = sum(n for n in repeats.values() if n > 1)
        grams.add(b"r%d" % (8 * again // repeats.total()))
        grams.add(b"m%d" % max(repeats.values()).bit_length())
    if len(words) > 1:  # the bigrams that say a word twice, likewise
        twice = sum(a == b for a, b in zip(words, words[1:]))
        grams.add(b"d%d" % (8 * twice // (len(words) - 1)))
    return np.unique(np.fromiter(map(zlib.crc32, grams), np.int64, len(grams)) % SLOTS)


def slot_counts(rows: DataFrame) -> DataFrame:
    """(slot, good, bad): labelled texts with the indicator, over all ``rows`` (text, label); slot -1 has the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SLOTS + 1), np.int64)
        for part in slices(batches, "text"):
            for value, label in zip(utf8(part.column("text")), part.column("label").to_pylist()):
                counts[label, features(value)] += 1
                counts[label, SLOTS] += 1
        slots = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(slots == SLOTS, -1, slots)), pa.array(counts[1, slots]), pa.array(counts[0, slots])],
            names=["slot", "good", "bad"],
        )

    return rows.mapInArrow(run, "slot bigint, good bigint, bad bigint").groupBy("slot").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")
    )


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, ratios: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights over slots of min |w|^2/2 + sum of cost * hinge, by coordinate descent on the dual."""
    weights, alphas = np.zeros(len(ratios)), np.zeros(len(rows))
    values = [ratios[r] for r in rows]
    norms = np.array([v @ v for v in values])
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            if norms[i] == 0:
                continue
            gradient = signs[i] * (weights[rows[i]] @ values[i]) - 1
            new = min(max(alphas[i] - gradient / norms[i], 0.0), costs[i])
            if new != alphas[i]:
                weights[rows[i]] += (new - alphas[i]) * signs[i] * values[i]
                moved = max(moved, abs(new - alphas[i]) * norms[i])
                alphas[i] = new
        if moved < 1e-3:
            break
    return weights


def calibrate(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton steps, labels smoothed as Platt does."""
    good, bad = max(1, (labels == 1).sum()), max(1, (labels == 0).sum())
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    theta = np.array([1.0, np.log(weights[labels == 1].sum() + 1e-9) - np.log(weights[labels == 0].sum() + 1e-9)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        slope = x.T @ (weights * (p - target)) + 1e-3 * (theta - [1, 0])
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        theta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


@dataclass
class QualityModel:
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, text: bytes) -> float:
        margin = float(self.weights[features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Fit on the rows of ``docs`` that ``labels`` marks 0 or 1.

    Null keys, null labels and keys with contradicting labels teach nothing; a null text is an empty
    one. With no label of one class the model is constant: the share of label 1, 0.5 without labels.
    """
    marks = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").cast("int").alias("label"))
    marks = marks.filter("label in (0, 1) and _key is not null").groupBy("_key").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    marks = marks.filter("label = most").drop("most")
    # the same join at every size: left to itself it is a broadcast for few labels and a sort-merge join beyond
    counts = slot_counts(texts.join(marks.hint("merge"), "_key").select("text", "label")).toPandas()
    rows = counts[counts.slot == -1]
    good, bad = (int(rows.good.sum()), int(rows.bad.sum()))
    if not good or not bad:
        share = good / (good + bad) if good + bad else 0.5
        return QualityModel(np.zeros(SLOTS), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    counts = counts[counts.slot >= 0]
    have = np.full((2, SLOTS), SMOOTHING)
    have[1, counts.slot], have[0, counts.slot] = counts.good + SMOOTHING, counts.bad + SMOOTHING
    ratios = np.log(have[1] / have[1].sum()) - np.log(have[0] / have[0].sum())
    ratios[(have == SMOOTHING).all(axis=0)] = 0.0
    picked = None
    for value in (0, 1):
        part = marks.filter(F.col("label") == value).orderBy(F.xxhash64("_key"), "_key").limit(sample // 2)
        picked = part if picked is None else picked.unionByName(part)
    chosen = docs.sparkSession.createDataFrame(picked.collect(), "_key " + dict(marks.dtypes)["_key"] + ", label int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            packed = [features(v).astype("<u4").tobytes() for v in utf8(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(packed, pa.binary())], names=["label", "slots"])

    seen = texts.join(F.broadcast(chosen), "_key").select("text", "label").mapInArrow(run, "label int, slots binary")
    rows = sorted((bytes(r.slots), r.label) for r in seen.toLocalIterator())
    # copies of one text teach once, with their number as weight
    weight: Counter = Counter(rows)
    slots = [np.frombuffer(s, "<u4").astype(np.int64) for s, _ in weight]
    marked = np.array([m for _, m in weight])
    times = np.array(list(weight.values()), float)
    true = np.where(marked == 1, good / (times @ (marked == 1)), bad / (times @ (marked == 0))) / (good + bad)
    cost = times * true * len(times)
    outside = np.arange(len(slots)) % 5 == 0
    inside = np.flatnonzero(~outside)
    scale = ratios / max(1e-9, np.sqrt(np.mean([ratios[s] @ ratios[s] for s in slots])))
    weights = scale * dual_descent([slots[i] for i in inside], np.where(marked[inside] == 1, 1.0, -1.0), COST * 100 * cost[inside], scale)
    margins = np.array([weights[s].sum() for s in slots])
    held = outside if len(set(marked[outside])) == 2 else np.ones(len(slots), bool)
    slope, offset = calibrate(margins[held], marked[held], cost[held])
    return QualityModel(weights, slope, offset)


def classify(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",),
             threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns, ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` (score >= threshold).

    Null and empty texts get the score of a text without n-grams. Repeated rows stay repeated, an
    empty table gives no rows, other columns are left out.
    """
    kept = docs.select(*keep, F.col(f"`{text}`").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in kept.dtypes[:-1]), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "_text"):
            scores = np.array([model.score(value) for value in utf8(part.column("_text"))], float)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=[*part.schema.names[:-1], "score", "predicted"],
            )

    return kept.mapInArrow(run, schema)
