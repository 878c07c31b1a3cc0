"""Importance resampling towards a target corpus, with features counted once per distinct line.

Features are runs of one to ``grams`` consecutive words, hashed into buckets. Newlines separate words, so they cut a
text into lines: equal lines are brought together, the features of a distinct line are hashed once and
multiplied by the number of its occurrences, and the runs that cross from a line into later ones are added per document.
The same holds for the gains: a distinct line's sum is computed once and joined to the documents by the line's digest.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from stayscope.llm.common import slices, utf8
from stayscope.llm.ordering import running
from stayscope.session import materialise

#: Bytes that a step of a task works on at once.
SLICE = 1 << 20
#: A line that holds more than one in HOT of all line occurrences is looked up from a broadcast table: HOT lines at most.
HOT = 4096
#: Capital letters become small ones, what cannot be part of a word becomes a blank; newlines stay.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c == 10 else 32 for c in range(256)
)


def lines_of(text: bytes) -> list[list[bytes]]:
    """The words of each line that has any."""
    return [words for words in map(bytes.split, text.translate(LETTERS).split(b"\n")) if words]


def hashes_within(words: list[bytes], grams: int) -> list[int]:
    """crc32 of every run of one to ``grams`` words, each continued from the run that is one word shorter."""
    shorter = [zlib.crc32(word) for word in words]
    found = list(shorter)
    spaced = [b" " + word for word in words]
    for n in range(1, grams):
        shorter = [zlib.crc32(word, so_far) for word, so_far in zip(spaced[n:], shorter)]
        found += shorter
    return found


def hashes_across(lines: list[list[bytes]], grams: int) -> list[int]:
    """crc32 of every run of up to ``grams`` words that begins in one line and ends in a later one."""
    found: list[int] = []
    for at in range(len(lines) - 1):
        left, right = lines[at][-(grams - 1):] if grams > 1 else [], []
        for line in lines[at + 1:]:
            right += line[: grams - 1 - len(right)]
            if len(right) >= grams - 1:
                break
        for start in range(len(left)):
            so_far = zlib.crc32(b" ".join(left[start:]))
            for word in right[: grams - (len(left) - start)]:
                so_far = zlib.crc32(b" " + word, so_far)
                found.append(so_far)
    return found


def _pack(hashes: list[int], buckets: int) -> bytes:
    return (np.array(hashes, np.uint32) % buckets).astype("<u2" if buckets <= 1 << 16 else "<u4").tobytes()


def _unpack(packed: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows one after the other, and how many each row has."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    values = [value or b"" for value in packed.to_pylist()]
    return np.frombuffer(b"".join(values), kind), np.array([len(value) // kind.itemsize for value in values], np.int64)


def _mapped(df: DataFrame, schema: StructType, make: Callable[[pa.RecordBatch, int], list], column: str) -> DataFrame:
    """``make`` gives the output columns of a bounded slice and the row number of its first row."""
    types = [_ARROW[field.dataType.simpleString()] if field.name in _MADE else None for field in schema.fields]

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, column, SLICE):
            columns = [c if kind is None else pa.array(c, kind) for c, kind in zip(make(batch, row), types)]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=[field.name for field in schema.fields])

    return df.mapInArrow(apply, schema)


_ARROW = {"bigint": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<bigint>": pa.list_(pa.int64())}
_MADE = {"_row", "_words", "_runs", "_across", "_lines", "_times", "line", "digest", "packed", "times"}


def outline(docs: DataFrame, grams: int, buckets: int) -> DataFrame:
    """Per row of ``docs`` (key, text): _row, key, _words, _runs, the packed buckets of runs across lines, the distinct lines' digests and times."""
    key = docs.schema["key"]
    schema = StructType([
        StructField("_row", LongType()), key, StructField("_words", LongType()), StructField("_runs", LongType()),
        StructField("_across", BinaryType()), StructField("_lines", ArrayType(BinaryType())), StructField("_times", ArrayType(LongType())),
    ])

    def make(batch: pa.RecordBatch, row: int) -> list:
        out: list[list] = [[], [], [], [], []]
        for text in utf8(batch.column("text")):
            lines = lines_of(text)
            words = sum(map(len, lines))
            out[0].append(words)
            out[1].append(sum(max(0, words - n) for n in range(grams)))
            out[2].append(_pack(hashes_across(lines, grams), buckets))
            times = Counter(b" ".join(line) for line in lines)
            out[3].append([hashlib.md5(line).digest() for line in times])
            out[4].append(list(times.values()))
        return [list(range(row, row + batch.num_rows)), batch.column("key"), *out]

    return _mapped(docs, schema, make, "text")


def distinct_lines(docs: DataFrame, grams: int, buckets: int) -> DataFrame:
    """Each distinct line of ``docs`` once: its digest, the packed buckets of its runs, and the times it occurs."""

    def cut(batch: pa.RecordBatch, row: int) -> list:
        return [[b" ".join(line) for text in utf8(batch.column("text")) for line in lines_of(text)]]

    def hashed(batch: pa.RecordBatch, row: int) -> list:
        lines = batch.column("line").to_pylist()
        return [
            [hashlib.md5(line).digest() for line in lines],
            [_pack(hashes_within(line.split(b" "), grams), buckets) for line in lines], batch.column("times").to_pylist(),
        ]

    lines = _mapped(docs.select("text"), StructType([StructField("line", BinaryType())]), cut, "text")
    counted = lines.groupBy("line").agg(F.count("*").alias("times"))
    schema = StructType([StructField("digest", BinaryType()), StructField("packed", BinaryType()), StructField("times", LongType())])
    return _mapped(counted, schema, hashed, "line")


def bucket_counts(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, times) over rows of (packed, times). A task adds up its rows and sends one row per bucket at most."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches, "packed", SLICE):
            found, lengths = _unpack(batch.column("packed"), buckets)
            times = np.repeat(batch.column("times").to_numpy(zero_copy_only=False), lengths)
            counts += np.bincount(found, times, buckets).astype(np.int64)
        kept = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(counts[kept], pa.int64())], names=["bucket", "times"])

    found = packed.select("packed", "times").mapInArrow(add, "bucket long, times long")
    return found.groupBy("bucket").agg(F.sum("times").alias("times"))


def _counts(outlined: DataFrame, lines: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences per bucket over whole documents; ``buckets`` rows come to the driver."""
    across = outlined.select(F.col("_across").alias("packed"), F.lit(1).cast("long").alias("times"))
    out = np.zeros(buckets, np.int64)
    for row in bucket_counts(lines.select("packed", "times").unionByName(across), buckets).toLocalIterator():
        out[row.bucket] = row.times
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln) of its smoothed share in the target over that in the source."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((int(t) + 1) * (all_source + buckets) / ((int(s) + 1) * (all_target + buckets))))
        for s, t in zip(source, target)
    ], np.int64)


def _summed(df: DataFrame, packed: str, schema: StructType, table, buckets: int) -> DataFrame:
    """Replace the packed buckets of each row by the sum of their gains."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in slices(batches, packed, SLICE):
            found, lengths = _unpack(batch.column(packed), buckets)
            ends = np.cumsum(lengths)
            so_far = np.concatenate([[0], np.cumsum(gain[found])])
            rest = [batch.column(name) for name in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(so_far[ends] - so_far[ends - lengths], pa.int64())], names=schema.names)

    return df.mapInArrow(add, schema)


def weigh(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", grams: int = 2, buckets: int = 10_000) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_features and the floored mean gain of its features (0 where it has none).

    Texts do not move but for one exchange of distinct lines (equal lines of a task are combined before it). Lines that
    fill more than one in 4,096 of all occurrences are looked up from a broadcast table; no other line is frequent
    enough to fill a join task.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    goal = target.select(F.lit(None).cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    outlined = materialise(outline(plain, grams, buckets), "outline")
    lines = materialise(distinct_lines(plain, grams, buckets), "lines")
    gain = gains(_counts(outlined, lines, buckets), _counts(outline(goal, grams, buckets), distinct_lines(goal, grams, buckets), buckets))
    shared = spark.sparkContext.broadcast(gain)

    line_schema = StructType([StructField("digest", BinaryType()), StructField("times", LongType()), StructField("gain", LongType())])
    often = (lines.agg(F.sum("times")).first()[0] or 0) // HOT
    hot = _summed(lines.filter(F.col("times") > often).select("digest", "times", "packed"), "packed", line_schema, shared, buckets)
    hot = hot.select(F.col("digest").alias("_hot"), F.col("gain").alias("_gain"))
    rare = _summed(lines.filter(F.col("times") <= often).select("digest", "times", "packed"), "packed", line_schema, shared, buckets)
    rare = rare.select("digest", "gain")

    row_schema = StructType([*outlined.schema.fields[:4], StructField("_across_gain", LongType())])
    rows = _summed(outlined, "_across", row_schema, shared, buckets)
    pairs = outlined.select("_row", F.explode(F.arrays_zip("_lines", "_times")).alias("at")).select(
        "_row", F.col("at._lines").alias("digest"), F.col("at._times").alias("times")
    )
    looked_up = pairs.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left")
    kept = looked_up.filter("_hot IS NOT NULL").select("_row", (F.col("_gain") * F.col("times")).alias("gain"))
    joined = looked_up.filter("_hot IS NULL").join(rare, "digest").select("_row", (F.col("gain") * F.col("times")).alias("gain"))
    across = rows.select("_row", F.col("_across_gain").alias("gain"))
    sums = kept.unionByName(joined).unionByName(across).groupBy("_row").agg(F.sum("gain").alias("_sum"))
    weighed = outlined.select("_row", "key", "_words", "_runs").join(sums, "_row", "left")
    return weighed.select(
        "_row", F.col("key").alias(key), F.col("_words").alias("n_words"), F.col("_runs").alias("n_features"),
        F.expr("CASE WHEN _runs > 0 THEN (_sum - pmod(_sum, _runs)) DIV _runs ELSE 0 END").alias("weight"),
    )


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u drawn from the key's digest: Gumbel noise that reruns repeat."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((drawn.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", grams: int = 2, buckets: int = 10_000,
    share: tuple[int, int] = (25, 100), least_words: int = 20, seed: int = 7,
) -> DataFrame:
    """Every row of ``docs`` with key, n_words, n_features, weight, score and its rank among the drawn rows (null: not drawn).

    Of the rows with ``least_words`` words or more the share with the highest scores (weight plus seeded Gumbel noise) is
    drawn, which samples without replacement in proportion to exp(weight / 1000). Ties go to the smaller key. Null and
    empty texts have no features and weight 0 and are never drawn; a null key draws as the empty text and comes last
    among equal scores. Repeated rows each count and are ranked next to one another. Texts of any length are read whole. An
    empty table gives no rows, an empty target (or one without words) only the smoothing. Other columns take no part.
    """
    n, of = share
    scored = weigh(docs, target, key, text, grams, buckets).withColumnRenamed(key, "key")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    scored = materialise(scored.select("*", (F.col("n_words") < least_words).cast("long").alias("_out"), F.lit(1).cast("long").alias("_one")), "scored")
    fit = scored.filter("_out = 0").count()
    placed = running(scored, "_out", [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("_row")], "_one", "ranked")
    rank = F.when((F.col("_out") == 0) & (F.col("_place") <= fit * n // of), F.col("_place"))
    return placed.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", rank.alias("rank"))
