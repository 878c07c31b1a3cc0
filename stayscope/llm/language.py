"""Language identification by words first, character n-grams for unseen words.

Training counts all words of all training texts per language. The words that a language has at least
``LEAST`` times, the ``KNOWN`` most frequent ones of each, are the known words; character n-grams of one
to ``ORDER`` characters (with word borders) are counted over all words, the ``GRAMS`` most frequent of an order and language are kept.
Terms of equal frequency are kept or left out together, so a model may be smaller than its bounds. A text's score for a language is the sum over its words of
the log frequency: a known word counts as a word, an unseen one backs off to its longest
n-grams that any language has, shorter ones in turn, at a penalty per step that is the same for all languages. ``KNOWN`` and ``GRAMS``
bound what is broadcast; they are sizes of the model, and every word of every text is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stayscope.llm.common import slices
from stayscope.session import materialise

ORDER = 4
KNOWN = 50_000
GRAMS = 50_000
LEAST = 2
FLUSH = 300_000
PART = 2 << 20
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. Numbers that are not digits (a fraction, a Roman numeral sign) end a run."""
    runs = _LETTERS.findall(text.lower())
    if "".join(runs).isalpha():
        return runs
    out: list[str] = []
    for run in runs:
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


def grams_of(word: str, order: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i: i + order] for i in range(len(marked) - order + 1)]


def gram_counts(words: dict[str, int]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Per order its distinct n-grams and how often they occur in ``words``, which have a number of occurrences each.

    A gram is numbered by its shorter one's number and its last character, for all places of all words at once.
    """
    marked = "".join(f"^{word}$" for word in words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(marked))  # characters from a place to the end of its word
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
    alphabet, character = np.unique(np.frombuffer(marked.encode("utf-32-le"), np.uint32), return_inverse=True)
    number, places = np.zeros(len(marked), np.int64), np.arange(len(marked))
    for order in range(1, ORDER + 1):
        inside = left[places] >= order
        places, number = places[inside], number[inside]
        _, first, number = np.unique(number * len(alphabet) + character[places + order - 1], return_index=True, return_inverse=True)
        counts = np.bincount(number, times[places], len(first)).astype(np.int64)
        yield order, [marked[at: at + order] for at in places[first].tolist()], counts


def term_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, kind, term, n): words (kind 0) and n-grams (kind = order) of all texts."""
    kept = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
            for name, counts in words.items():
                whole = (0, list(counts), np.fromiter(counts.values(), np.int64, len(counts)))
                for kind, terms, times in (whole, *gram_counts(counts)):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * len(terms), pa.string()), pa.array(np.full(len(terms), kind, np.int32)),
                        pa.array(terms, pa.string()), pa.array(times),
                    ], names=["lang", "kind", "term", "n"])

        held: dict[str, Counter] = {}
        for part in slices(batches, "text"):
            for value, name in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                if value and name is not None:
                    held.setdefault(name, Counter()).update(words_of(value))
            if sum(map(len, held.values())) > FLUSH:
                yield from rows(held)
                held = {}
        yield from rows(held)

    counted = kept.mapInArrow(run, "lang string, kind int, term string, n bigint")
    return counted.groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_logs: np.ndarray
    gram_logs: np.ndarray

    def unseen(self, words: list[str]) -> np.ndarray:
        """A row per word: log frequencies by the longest order of n-grams that is known, zeros if none is."""
        ids, sizes = [], []
        for word in words:
            found: list[int] = []
            for order in range(ORDER, 0, -1):
                if found := [i for g in grams_of(word, order) if (i := self.grams.get(g)) is not None]:
                    break
            ids += found
            sizes.append(len(found))
        out, flat, many = np.zeros((len(words), len(self.languages)), np.float32), np.array(ids, np.int64), np.array(sizes, np.int64)
        starts = np.cumsum(many) - many
        for place in range(max(sizes, default=0)):  # all words add their next gram
            rows = np.flatnonzero(many > place)
            out[rows] += self.gram_logs[flat[starts[rows] + place]]
        return out / np.maximum(many, 1)[:, None].astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its share; ties go to the first by name."""
        counted = [Counter(words_of(text)) if text and self.languages else None for text in texts]
        rare = list(dict.fromkeys(word for words in counted if words for word in words if word not in self.words))
        places, logs = {word: i for i, word in enumerate(rare)}, self.unseen(rare)
        return [self._likeliest(words, places, logs) if words else (UNKNOWN, 0.0) for words in counted]

    def _likeliest(self, words: Counter, places: dict[str, int], logs: np.ndarray) -> tuple[str, float]:
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        times, known = np.fromiter(words.values(), np.int64, len(words)), ids >= 0
        total = np.zeros(len(self.languages))
        if not known.all():
            rows = [places[word] for word, there in zip(words, known.tolist()) if not there]
            total += (times[~known].astype(np.float32)[:, None] * logs[rows]).sum(axis=0, dtype=np.float64)
        if known.any():
            total += times[known] @ self.word_logs[ids[known]]
        share = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.languages[best], float(share[best] / share.sum())


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on all rows of ``docs`` with a text and a language."""
    counts = materialise(term_counts(docs.filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()), text, lang), "terms")
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).collect()
    languages = sorted({r.lang for r in totals})
    if not languages:
        return LanguageModel([], {}, {}, np.zeros((0, 0)), np.zeros((0, 0)))
    number = {name: i for i, name in enumerate(languages)}
    total, distinct = np.ones((ORDER + 1, len(languages))), np.ones((ORDER + 1, len(languages)))
    for r in totals:
        total[r.kind, number[r.lang]], distinct[r.kind, number[r.lang]] = r.total, r.distinct
    # Terms are counted by frequency first, so that no language's terms are gathered and ordered in one task.
    usable = counts.filter((F.col("kind") > 0) | (F.col("n") >= LEAST))
    above = F.sum("terms").over(Window.partitionBy("lang", "kind").orderBy(F.desc("n")))
    steps = usable.groupBy("lang", "kind", "n").agg(F.count("*").alias("terms")).withColumn("above", above)
    least = steps.filter(F.col("above") <= F.when(F.col("kind") == 0, KNOWN).otherwise(GRAMS)).groupBy("lang", "kind").agg(F.min("n").alias("least"))
    chosen = usable.join(F.broadcast(least), ["lang", "kind"]).filter("n >= least")  # a row per language and kind
    terms = chosen.select("kind", "term").distinct()  # bounded by the model's sizes
    by_language = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{i}") for i, name in enumerate(languages)]
    rows = counts.join(F.broadcast(terms), ["kind", "term"]).groupBy("kind", "term").agg(*by_language).orderBy("kind", "term")
    tables = []
    for part in (rows.filter("kind = 0"), rows.filter("kind > 0")):
        held = part.toArrow()
        kinds = held.column("kind").to_numpy()
        have = np.zeros((held.num_rows, len(languages)), np.float32)
        for i in range(len(languages)):
            have[:, i] = held.column(f"n{i}").to_numpy()
        index = {t: i for i, t in enumerate(held.column("term").to_pylist())}
        tables.append((index, np.log((have + 0.5) / (total[kinds] + 0.5 * distinct[kinds])).astype(np.float32)))
        del held, have
    (word_index, word_logs), (gram_index, gram_logs) = tables
    return LanguageModel(languages, word_index, gram_index, word_logs, gram_logs)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` (the language's share, 0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned.
    Repeated rows stay repeated, an empty table gives no rows, other columns are left out.
    """
    kept = docs.select(*keep, F.col(f"`{text}`").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in kept.dtypes[:-1]), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "_text", PART):
            found = model.predict(part.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*part.schema.names[:-1], "lang_pred", "score"],
            )

    return kept.mapInArrow(run, schema)
