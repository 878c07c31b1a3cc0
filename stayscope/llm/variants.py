"""Spelling variants: words one edit apart, found by dynamic programming over a sorted vocabulary.

A word's edit matrix against a sorted list is filled row by row, one row per letter of the listed word, in a band of three
cells (each counted up to 2, so a row is one of 27). The next listed word keeps the rows of the prefix it shares with the one before, and as soon as a row holds
no cell of at most one edit, all words that share this prefix are skipped.

The list is cut into blocks of neighbouring words. Of two words one edit apart, the shorter having m letters, either the
first m // 2 letters are equal or the last m - m // 2 are; so each word visits only the ranges of the sorted list and of
the list of reversed words that begin with about half of it, and of these only the blocks whose shared prefix is
within one edit.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayscope.llm.common import slices, utf8
from stayscope.llm.ordering import running
from stayscope.session import materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words that a task counts before it sends them on.
COUNTED = 200_000
#: Words of a block, and the number of blocks of a list beyond which blocks grow instead.
BLOCK, BLOCKS = 2048, 1 << 15
#: Searched words that meet a block in one group, and blocks that a task takes.
CHUNK, BLOCKS_A_TASK = 8192, 8
#: Letters of a block's first word that are kept to find the blocks of a range.
EDGE = 64
LAST = chr(0x10FFFF)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 97) -> DataFrame:
    """(word, n) over the letter runs of whole texts, lower-cased in A-Z.

    One in ``one_in`` pairs of document and run, chosen by crc32, loses a letter: the planted misspellings of the contract. 0
    plants none.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches, "text"):
            for name, raw in zip(batch.column("key").to_pylist(), utf8(batch.column("text"))):
                start = zlib.crc32(f"{'' if name is None else name}:".encode())
                for run, n in Counter(RUN.findall(raw.translate(LOWER).decode())).items():
                    drawn = zlib.crc32(run.encode(), start)
                    if one_in and drawn % one_in == 0:
                        at = drawn % len(run)
                        run = run[:at] + run[at + 1:]
                    counts[run] += n
                if len(counts) > COUNTED:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    plain = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _step(row: int, equal: int) -> int:
    """The next row of the matrix. A row is a base-3 number of its three cells, each at most 2; ``equal`` has a bit per cell
    that says whether the listed word's letter equals the query's letter above that cell."""
    a, b, c = row // 9, row // 3 % 3, row % 3
    a = min(a + (not equal & 1), b + 1, 2)
    b = min(b + (not equal & 2), c + 1, a + 1, 2)
    c = min(c + (not equal & 4), b + 1, 2)
    return 9 * a + 3 * b + c


STEPS = [_step(row, equal) for row in range(27) for equal in range(8)]
#: Equal prefixes: one edit to the prefix one shorter, none, one; and a row without a cell of at most one edit.
EQUAL, OVER = 9 * 1 + 3 * 0 + 1, 26


def within_one(prefix: str, word: str) -> bool:
    """Whether a word that begins with ``prefix`` can be within one edit of ``word``."""
    padded, row = "\0" + word + "\0\0\0", EQUAL
    for d, letter in enumerate(prefix):
        if d > len(word):
            return False
        row = STEPS[8 * row + (padded[d] == letter) + 2 * (padded[d + 1] == letter) + 4 * (padded[d + 2] == letter)]
        if row == OVER:
            return False
    return True


def near_in_list(words: list[str], lcps: list[int], query: str, start: int) -> list[int]:
    """Positions of the words one edit from ``query`` among those that share its first ``start`` letters.

    ``words`` is sorted and holds words of about the query's length (one letter more or less at most); ``lcps`` holds the
    shared prefix of each with the one before. A row for d letters of a listed word holds the distances to
    the first d-1, d and d+1 letters of the query; cells beyond the query's end never reach those before it.
    """
    prefix = query[:start]
    at, end = bisect_left(words, prefix), bisect_right(words, prefix + LAST)
    length, padded = len(query), "\0" + query + "\0\0\0"
    rows = [EQUAL] * (length + 2)
    found, kept = [], start
    while at < end:
        word = words[at]
        size, row, d = len(word), rows[kept], kept
        while d < size:
            letter = word[d]
            row = STEPS[8 * row + (padded[d] == letter) + 2 * (padded[d + 1] == letter) + 4 * (padded[d + 2] == letter)]
            d += 1
            if row == OVER:
                break
            rows[d] = row
        if row != OVER and row // (3, 9, 1)[size - length] % 3 == 1:
            found.append(at)
        at += 1
        if row == OVER:
            while at < end and lcps[at] >= d:
                at += 1
        if at < end:
            kept = max(start, min(lcps[at], d))
    return found


def _halves(length: int) -> tuple[int, int]:
    """Shared letters of a word with all its near words: of the prefix if it is the prefix that is equal, else of the suffix."""
    return (length - 1) // 2, length // 2


def search_block(words: list[str], counts: list[int], queries: list[str], reverse: bool) -> Iterator[tuple[str, int, int, str]]:
    """(query, near words, n of the most frequent, its smallest word) for the pairs that this list answers for.

    A pair belongs to the list of words if its first m // 2 letters are equal, m being the shorter length, and to the list of
    reversed words otherwise, so none counts twice.
    """
    lists: dict[int, tuple[list[int], list[str], list[int]]] = {}
    for query in sorted(queries):
        length = len(query)
        if length not in lists:
            places = [at for at, word in enumerate(words) if -1 <= len(word) - length <= 1]
            fit = [words[at] for at in places]
            lists[length] = places, fit, [0, *(shared_prefix(a, b) for a, b in zip(fit, fit[1:]))]
        places, fit, lcps = lists[length]
        near, best = 0, (0, "")
        for found in near_in_list(fit, lcps, query, _halves(length)[reverse]):
            other, n = fit[found], counts[places[found]]
            half = min(length, len(other)) // 2
            if reverse:
                if query[length - half:] == other[len(other) - half:]:
                    continue
                other = other[::-1]
            elif query[:half] != other[:half]:
                continue
            near += 1
            if (-n, other) < (-best[0], best[1]):
                best = (n, other)
        if near:
            yield query[::-1] if reverse else query, near, *best


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for the words of ``vocabulary`` (word, n; distinct, written) that have near words.

    Blocks have 2,048 words, more only beyond 2^15 blocks a list, so the table of their first words is bounded and
    broadcast. Where more than 8,192 words visit a block, they are dealt over copies of it.
    """
    spark = vocabulary.sparkSession
    both = vocabulary.select(F.lit(0).cast("long").alias("side"), F.col("word").alias("listed"), "n").unionByName(
        vocabulary.select(F.lit(1).cast("long").alias("side"), F.reverse("word").alias("listed"), "n")
    )
    size = max(BLOCK, -(-vocabulary.count() // BLOCKS))
    laid = running(both, "side", [F.col("listed")], "n", "listed")
    listed = materialise(laid.select("side", F.floor((F.col("_place") - 1) / size).cast("long").alias("block"), "listed", "n"), "blocks")
    edges: list[list[str]] = [[], []]
    for row in listed.groupBy("side", "block").agg(F.substring(F.min("listed"), 1, EDGE).alias("edge")).orderBy("side", "block").collect():
        edges[row.side].append(row.edge)
    shared = spark.sparkContext.broadcast(edges)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = shared.value
        common = [[shared_prefix(a, b) for a, b in zip(first, first[1:])] + [0] for first in firsts]
        for batch in batches:
            sides, blocks, sent = [], [], []
            for side, query in zip(batch.column("side").to_pylist(), batch.column("listed").to_pylist()):
                first, prefix = firsts[side], query[: min(EDGE, _halves(len(query))[side])]
                for block in range(max(0, bisect_left(first, prefix) - 1), bisect_right(first, prefix + LAST)):
                    if within_one(first[block][: common[side][block]], query):
                        sides.append(side)
                        blocks.append(block)
                        sent.append(query)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sides, pa.int64()), pa.array(blocks, pa.int64()), pa.array(sent, pa.string())], names=["side", "block", "query"]
            )

    routed = materialise(listed.select("side", "listed").mapInArrow(route, "side long, block long, query string"), "routed")
    visits = F.broadcast(routed.groupBy("side", "block").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("copies")))
    asked = routed.join(visits, ["side", "block"]).withColumn("copy", F.pmod(F.xxhash64("query"), F.col("copies"))).drop("copies")
    copied = listed.join(visits, ["side", "block"]).withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).drop("copies")
    # Little data, much work: a count of partitions keeps the tasks from being merged by their bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(map(len, edges)) // BLOCKS_A_TASK)

    def search(block: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[str, int, int, str]] = []
        if block.num_rows and queries.num_rows:
            pairs = sorted(zip(block["listed"].to_pylist(), block["n"].to_pylist()))
            out = list(search_block([w for w, _ in pairs], [n for _, n in pairs], queries["query"].to_pylist(), bool(block["side"][0].as_py())))
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "n", "best"])

    keys = ("side", "block", "copy")
    copied, asked = copied.repartition(tasks, *keys), asked.repartition(tasks, *keys)
    found = copied.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "word string, near long, n long, best string")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", (-F.col("_best.less")).alias("best_n"), F.col("_best.best").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from written (word, form): each round doubles the steps taken, so there are few. Forms have no cycles."""
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        further = ends.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = materialise(ends.join(further, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        ends = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return ends


def group_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 5, least_count: int = 3, ratio: int = 2, one_in: int = 97,
) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of at least ``least_letters`` letters and ``least_count`` occurrences.

    A word's form is its most frequent near word (ties: the smallest in code-point order) if that occurs at least ``ratio``
    times (2 or more) as often; counts grow along forms, so following them ends at the root. Null and empty texts have no words;
    a null key counts as the empty text in the planting; repeated rows count each time; words and texts of any length are
    taken whole. An empty table gives no rows. Other columns take no part.
    """
    counted = word_counts(docs, key, text, one_in)
    vocabulary = materialise(counted.filter((F.length("word") >= least_letters) & (F.col("n") >= least_count)), "vocabulary")
    near = near_words(vocabulary).withColumnRenamed("word", "_word")
    formed = F.col("best_n") >= ratio * F.col("n")
    grouped = materialise(vocabulary.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n"),
    ), "forms")
    ends = roots(grouped.filter("form IS NOT NULL")).withColumnRenamed("word", "_word")
    return grouped.join(ends, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
