"""Removal of passages that occur more than once, by relative Lempel-Ziv factors.

A window is ``window`` consecutive words. The corpus is its own reference, cut into blocks by the hash of a
window's seed, the least hash among its k-grams of ``SEED_WORDS`` words: windows with the same words have the same seed, so all places where a
window can recur meet in one block, and every document is matched against every block that can hold it
by equality joins.

1. Each distinct text is cut into runs of consecutive windows with the same seed. Seeds that occur once in the
   corpus are dropped; this is most of them.
2. A seed whose runs are all alike makes all of their windows repeats. Where runs differ, at the
   borders of copied passages, their windows are indexed one by one.
3. Each document is factored greedily: a factor starts at a repeated window and goes on while the next window
   is a repeat, too; every window across a factor's border has been looked up itself, so
   a factor ends exactly where nothing in the reference continues it. Factors' words are the duplicate spans.

Equal texts are one row with a count. Counts are partial aggregates. Rows of frequent seeds, those of passages that many
documents share, are dealt over ``SALTS`` join keys by their text, and what they look up is repeated for each; which seeds are frequent is
estimated from a sample of runs, which steers the work and does not touch the result. Hashes are 64 bits of the window beside 64 of its seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayscope.llm.common import drop_unreachable, slices, utf8
from stayscope.session import materialise

WINDOW = 35
SEED_WORDS = 12
SALTS = 16
FREQUENT_SAMPLE = 1 << 20
FREQUENT_SHARE = 1 << 12
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _power(exponent: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), exponent, 1 << 64))


def _doubled(values: np.ndarray, size: int, join) -> np.ndarray:
    """``join`` over each ``size`` consecutive values, by joining spans of powers of two."""
    out, done, span, level = None, 0, 1, values
    while True:
        if size & span:
            out = level if out is None else join(out[: len(level) - done] if len(out) > len(level) - done else out, level[done:], span)
            done += span
        span *= 2
        if span > size:
            return out[: max(0, len(values) - size + 1)]
        half = span // 2
        level = join(level[: len(level) - half], level[half:], half)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive word hashes."""
    return _mix(_doubled(hashes, size, lambda a, b, n: a[: len(b)] * _power(n) + b[: len(a)]))


def least(values: np.ndarray, size: int) -> np.ndarray:
    return _doubled(values, size, lambda a, b, n: np.minimum(a[: len(b)], b[: len(a)]))


def window_hashes(words: list[bytes], window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window its hash and its seed."""
    from xxhash import xxh64_intdigest as digest

    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = np.array([digest(w) for w in words], np.uint64)
    return rolling(hashes, window), least(rolling(hashes, seed_words), window - seed_words + 1)


def runs_of(texts: DataFrame, window: int, seed_words: int) -> DataFrame:
    """(text_id, start, size, seed, run, places, copies) of the runs in ``texts`` (text_id, copies, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for name, copies, text in zip(part.column("text_id").to_pylist(), part.column("copies").to_pylist(), utf8(part.column("text"))):
                hashes, seeds = window_hashes(text.split(), window, seed_words)
                if not len(hashes):
                    continue
                starts = np.flatnonzero(np.concatenate(([True], seeds[1:] != seeds[:-1])))
                sizes = np.diff(np.append(starts, len(hashes)))
                ordered = np.sort(hashes)
                twice = ordered[1:][ordered[1:] == ordered[:-1]]
                again = np.add.reduceat(np.isin(hashes, twice).astype(np.int64), starts) > 0 if len(twice) else np.zeros(len(starts), bool)
                whole = _mix(np.add.reduceat(hashes, starts) + sizes.astype(np.uint64))
                for column, values in zip(out, (
                    np.full(len(starts), name, np.int64), starts.astype(np.int32), sizes.astype(np.int32),
                    seeds[starts].view(np.int64), whole.view(np.int64), (copies * (1 + again)).astype(np.int64),
                    np.full(len(starts), copies, np.int64),
                )):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["text_id", "start", "size", "seed", "run", "places", "copies"])

    return texts.mapInArrow(run, "text_id bigint, start int, size int, seed bigint, run bigint, places bigint, copies bigint")


def frequent_seeds(runs: DataFrame) -> DataFrame:
    """(seed, frequent) of the seeds with more than 1 / ``FREQUENT_SHARE`` of the runs, estimated; that many at most."""
    total = max(1, runs.count())
    part = min(1.0, FREQUENT_SAMPLE / total)
    counted = runs.select("seed").sample(part, seed=7).groupBy("seed").count()
    rows = counted.filter(F.col("count") > part * total / FREQUENT_SHARE).select("seed", F.lit(True)).collect()
    return runs.sparkSession.createDataFrame(rows, "seed bigint, frequent boolean")


def dealt(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` with a ``salt`` by text where the seed is frequent, 0 elsewhere."""
    marked = rows.join(F.broadcast(frequent), "seed", "left")
    return marked.withColumn("salt", F.when(F.col("frequent"), F.pmod("text_id", F.lit(SALTS))).otherwise(0).cast("int")).drop("frequent")


def repeated_per_salt(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` once for each ``salt`` that ``dealt`` can give their seed."""
    marked = rows.join(F.broadcast(frequent), "seed", "left")
    salts = F.when(F.col("frequent"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("salt", F.explode(salts)).drop("frequent")


def windows_of(texts: DataFrame, window: int, seed_words: int) -> DataFrame:
    """(text_id, copies, starts, seeds, hashes) of the windows in the runs that ``texts`` lists in ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            starts, seeds, hashes = [], [], []
            for text, runs in zip(utf8(part.column("text")), part.column("runs").to_pylist()):
                all_hashes, all_seeds = window_hashes(text.split(), window, seed_words)
                at = np.concatenate([np.arange(r["start"], r["start"] + r["size"]) for r in runs])
                starts.append(at.astype(np.int32))
                seeds.append(all_seeds[at].view(np.int64))
                hashes.append(all_hashes[at].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("text_id"), part.column("copies"), pa.array(starts, pa.list_(pa.int32())), pa.array(seeds, pa.list_(pa.int64())),
                 pa.array(hashes, pa.list_(pa.int64()))], names=["text_id", "copies", "starts", "seeds", "hashes"],
            )

    return texts.mapInArrow(run, "text_id bigint, copies bigint, starts array<int>, seeds array<bigint>, hashes array<bigint>")


def factors(repeated: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy factors (first word, end) over the sorted starts of repeated windows; touching factors are joined."""
    if not len(repeated):
        return []
    cut = np.flatnonzero(np.diff(repeated) > 1)
    firsts, lasts = repeated[np.concatenate(([0], cut + 1))], repeated[np.concatenate((cut, [len(repeated) - 1]))]
    out: list[tuple[int, int]] = []
    for first, end in zip(firsts.tolist(), (lasts + window).tolist()):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((first, end))
    return out


def repeats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, seed_words: int = SEED_WORDS,
            texts: bool = True) -> DataFrame:
    """The ``keep`` columns, ``n_words``, ``n_removed``, ``kept_sha256``, ``spans`` and, with ``texts``, ``kept``.

    ``spans`` are the removed (start, end) in words, ``kept`` the other words joined by one space, ``kept_sha256`` its digest. A null
    text has no words. Repeated rows count as copies of each other, so a row of ``window`` words or more that
    repeats is removed whole. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keys = [F.xxhash64(value).alias("_k1"), F.xxhash64(value, F.lit(1)).alias("_k2")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *keys)
    distinct = docs.select(*keys, value.alias("text")).groupBy("_k1", "_k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    distinct = materialise(distinct.withColumn("text_id", F.monotonically_increasing_id()), "distinct-texts")
    drop_unreachable(spark)
    runs = materialise(runs_of(distinct.select("text_id", "copies", "text"), window, seed_words), "runs")
    seeds = runs.groupBy("seed").agg(
        F.sum("places").alias("places"), F.min("run").alias("a"), F.max("run").alias("b"), F.max("size").alias("most"), F.count("*").alias("n"),
        F.min("copies").alias("copies"),
    ).filter("places > 1").select("seed", F.expr("copies > 1 or (a = b and (n > 1 or most = 1))").alias("alike"))
    frequent = frequent_seeds(runs)
    drop_unreachable(spark)
    matched = dealt(runs, frequent).join(repeated_per_salt(seeds, frequent), ["seed", "salt"])
    shared = materialise(matched.select("text_id", "start", "size", "alike"), "shared-runs")
    drop_unreachable(spark)
    listed = shared.filter("not alike").groupBy("text_id").agg(F.collect_list(F.struct("start", "size")).alias("runs"))
    windows = windows_of(distinct.select("text_id", "copies", "text").join(listed, "text_id"), window, seed_words)
    windows = materialise(windows, "windows")
    drop_unreachable(spark)
    each = windows.select("text_id", "copies", F.explode(F.arrays_zip("starts", "seeds", "hashes")).alias("w")).select(
        "text_id", "copies", F.col("w.starts").alias("start"), F.col("w.seeds").alias("seed"), F.col("w.hashes").alias("hash")
    )
    twice = each.groupBy("seed", "hash").agg(F.sum("copies").alias("places")).filter("places > 1").select("seed", "hash")
    found = dealt(each, frequent).join(repeated_per_salt(twice, frequent), ["seed", "hash", "salt"]).select("text_id", "start", F.lit(1).alias("size"))
    found = materialise(
        shared.filter("alike").select("text_id", "start", "size").unionByName(found)
        .groupBy("text_id").agg(F.collect_list(F.struct("start", "size")).alias("runs")), "repeated-windows"
    )
    drop_unreachable(spark)
    results = materialise(_factored(distinct.join(found, "text_id", "left"), window, texts), "factored")
    drop_unreachable(spark)
    return rows.join(results, ["_k1", "_k2"]).drop("_k1", "_k2")


def _factored(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    schema = "_k1 bigint, _k2 bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:int,end:int>>"
    schema += ", kept string" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sizes, removed, digests, spans, kept = [], [], [], [], []
            for text, runs in zip(utf8(part.column("text")), part.column("runs").to_pylist()):
                words = text.split()
                repeated = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["size"]) for r in runs])) if runs else np.zeros(0, int)
                found = factors(repeated, window)
                left, last = [], 0
                for start, end in found:
                    left += words[last:start]
                    last = end
                left += words[last:]
                rest = b" ".join(left)
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(rest).hexdigest())
                spans.append([{"start": a, "end": b} for a, b in found])
                kept.append(rest.decode())
            columns = [
                part.column("_k1"), part.column("_k2"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ]
            names = ["_k1", "_k2", "n_words", "n_removed", "kept_sha256", "spans"]
            if with_text:
                columns, names = [*columns, pa.array(kept, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.select("_k1", "_k2", "text", "runs").mapInArrow(run, schema)
