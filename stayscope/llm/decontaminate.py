"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are lower-cased (A-Z) and cut into words. All their words go into one suffix automaton, so
streaming a document's words through it gives, at each word, the longest match with any item. A
match of ``window`` words or more is an occurrence of a test window; an item of fewer words is one
window of its own.

Equal items are made distinct and long ones cut into pieces of ``PIECE_WORDS`` words that overlap by a window less a word, so no
window is lost. Pieces are dealt into blocks of about ``BLOCK_CHARS`` characters. Tasks build a block's automaton and write it to a
table in the shared folder. The driver then holds and broadcasts one automaton at a time, and the documents pass one block after the
other, carrying what they hit so far, so driver and broadcast are bounded however large the benchmark or an item is. Documents are
never shuffled.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayscope.llm.common import slices, utf8
from stayscope.session import materialise

WINDOW = 10
BLOCK_CHARS = 1 << 20
PIECE_WORDS = 2_048
STATE = "_hits array<bigint>, _items array<string>, _n_words bigint, _longest bigint"
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; all other ASCII separates them."""
    return text.translate(_TABLE).split()


@dataclass
class Automaton:
    """States are numbers; ``step`` maps state * size + word to the next state."""

    vocabulary: dict[bytes, int]
    step: dict[int, int]
    link: list[int]
    length: list[int]
    anchor: list[int]
    items: dict[int, frozenset[str]]
    short: dict[int, list[tuple[int, str]]]
    least: int
    window: int

    def move(self, state: int, matched: int, word: int) -> tuple[int, int]:
        size, step, link = len(self.vocabulary), self.step, self.link
        while (to := step.get(state * size + word)) is None:
            state = link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
        return to, matched + 1

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str], int]:
        """Positions of hit words, items with an occurring window, longest match of ``least`` or more."""
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        for start, end in edges.reshape(-1, 2):
            if end - start < self.least:
                continue
            state = matched = 0
            for at, word in enumerate(ids[start:end].tolist(), start + 1):
                state, matched = self.move(state, matched, word)
                if matched >= self.least:
                    longest = max(longest, matched)
                    if matched >= self.window:
                        found.append((at - self.window, at))
                        items |= self.items[self.anchor[state]]
                    for size, item in self.short.get(state, ()):
                        if size <= matched:
                            found.append((at - size, at))
                            items.add(item)
        marks = np.zeros(len(words) + 1, np.int64)
        if found:
            spans = np.array(found)
            np.add.at(marks, spans[:, 0], 1)
            np.add.at(marks, spans[:, 1], -1)
        return np.flatnonzero(np.cumsum(marks[:-1]) > 0), items, longest


def build(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Automaton:
    """The automaton of items (id, words). Items without words have no window."""
    items = [(name, words) for name, words in items if words]
    vocabulary: dict[bytes, int] = {}
    coded = [(name, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for name, words in items]
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def clone(state: int, word: int, target: int) -> int:
        copy = len(link)
        nexts.append(dict(nexts[target]))
        link.append(link[target])
        length.append(length[state] + 1)
        link[target] = copy
        while state >= 0 and nexts[state].get(word) == target:
            nexts[state][word] = copy
            state = link[state]
        return copy

    for _, words in coded:
        last = 0
        for word in words:
            known = nexts[last].get(word)
            if known is not None:
                last = known if length[known] == length[last] + 1 else clone(last, word, known)
                continue
            new = len(link)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            state = last
            while state >= 0 and word not in nexts[state]:
                nexts[state][word] = new
                state = link[state]
            if state >= 0:
                target = nexts[state][word]
                link[new] = target if length[target] == length[state] + 1 else clone(state, word, target)
            last = new
    size = len(vocabulary)
    step = {state * size + word: to for state, row in enumerate(nexts) for word, to in row.items()}
    anchor = [-1] * len(link)
    own: dict[int, list[tuple[int, str]]] = {}
    for state in sorted(range(1, len(link)), key=length.__getitem__):
        if length[state] >= window:
            anchor[state] = state if length[link[state]] < window else anchor[link[state]]
    out = Automaton(vocabulary, step, link, length, anchor, {}, {}, 1, window)
    gathered: dict[int, set[str]] = {}
    for name, words in coded:
        state = matched = 0
        for word in words:
            state, matched = out.move(state, matched, word)
            if matched >= window:
                gathered.setdefault(anchor[state], set()).add(name)
        if len(words) < window:
            own.setdefault(state, []).append((len(words), name))
    for state in sorted(range(1, len(link)), key=length.__getitem__):
        if both := out.short.get(link[state], []) + own.get(state, []):
            out.short[state] = both
    out.items = {state: frozenset(names) for state, names in gathered.items()}
    out.least = min([window, *(len(words) for _, words in coded)])
    return out


def pieces_of(words: list[bytes], window: int) -> list[list[bytes]]:
    """Pieces of at most PIECE_WORDS words (a window, if that is more) that hold all windows of the words; none without words."""
    step = max(1, PIECE_WORDS - window + 1)
    last = max(1, len(words) - window + 1) if words else 0
    return [words[at: at + step + window - 1] for at in range(0, last, step)]


def automata(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A written table (block, automaton) with the automata of the items, their fields pickled. A null id counts as the empty id."""
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("string").alias("text")
    ).filter("text is not null").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            held = [
                (name, b" ".join(piece)) for name, value in zip(part.column("item").to_pylist(), utf8(part.column("text")))
                for piece in pieces_of(words_of(value), window)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name for name, _ in held], pa.string()), pa.array([piece for _, piece in held], pa.binary())], names=["item", "words"]
            )

    pieces = materialise(items.mapInArrow(cut, "item string, words binary").distinct(), "items")
    count = max(1, math.ceil((pieces.agg(F.sum(F.length("words"))).first()[0] or 0) / BLOCK_CHARS))

    def one(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        named = zip(rows.column("item").to_pylist(), rows.column("words").to_pylist())
        built = build([(name, words.split()) for name, words in named], window)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([pickle.dumps(vars(built))], pa.binary())})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(count)).cast("bigint"))
    return materialise(dealt.groupBy("block").applyInArrow(one, "block bigint, automaton binary"), "automata")


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               window: int = WINDOW, built: DataFrame | None = None, cut: bool = False) -> DataFrame:
    """``docs`` plus ``_hits`` (numbers of the hit words, from 0), ``_items`` (sorted ids), ``_n_words``, ``_longest``.

    ``_longest`` is the longest match with a piece of an item that reaches the shortest window, else 0. Null and empty
    texts have no words and no hits; repeated rows stay repeated; an empty benchmark hits nothing.
    Other columns pass through, whatever their names. ``built`` is the table of ``automata`` where it was made before.
    With ``cut`` the pass of the last block also takes the hit words out of the texts, as ``cut_words`` does.
    """
    spark, given = docs.sparkSession, docs.columns
    inner = [f"_c{i}" for i in range(len(given))]
    at = inner[given.index(text)]
    out = docs.toDF(*inner).withColumns({
        "_hits": F.array().cast("array<bigint>"), "_items": F.array().cast("array<string>"),
        "_n_words": F.lit(0).cast("bigint"), "_longest": F.lit(0).cast("bigint"),
    })
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in out.dtypes[: len(inner)]), STATE])
    built = automata(benchmark, item_id, item_text, window) if built is None else built
    blocks = sorted(r.block for r in built.select("block").collect()) or [None]  # a number per block
    for number, block in enumerate(blocks):
        held = build([], window) if block is None else Automaton(**pickle.loads(built.filter(F.col("block") == block).first().automaton))
        shared = spark.sparkContext.broadcast(held)
        del held
        cutting = cut and number == len(blocks) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, cutting=cutting) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for part in slices(batches, at):
                hits, items, sizes, longest = [], [], [], []
                before = zip(part.column("_hits").to_pylist(), part.column("_items").to_pylist(), part.column("_longest").to_pylist())
                for value, (old_hits, old_items, old_longest) in zip(utf8(part.column(at)), before):
                    words = words_of(value)
                    new_hits, new_items, new_longest = automaton.scan(words)
                    hits.append(np.union1d(new_hits, old_hits).astype(np.int64) if old_hits else new_hits)
                    items.append(sorted(new_items.union(old_items)))
                    sizes.append(len(words))
                    longest.append(max(new_longest, old_longest))
                columns, place = part.columns[: len(inner)], inner.index(at)
                if cutting and any(map(len, hits)):
                    texts = [cut_words(t, h.tolist()) for t, h in zip(columns[place].to_pylist(), hits)]
                    columns[place] = pa.array(texts, columns[place].type)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())),
                     pa.array(sizes, pa.int64()), pa.array(longest, pa.int64())],
                    names=[*inner, "_hits", "_items", "_n_words", "_longest"],
                )

        out = out.mapInArrow(run, schema)
        if number < len(blocks) - 1:
            out = materialise(out, "decontaminate")
            shared.destroy()
    return out.toDF(*given, "_hits", "_items", "_n_words", "_longest")


def cut_words(text: str | None, hits: list[int]) -> str | None:
    """``text`` without the runs of hit words, from the first character of a run to its last; a line break stands in."""
    if not hits:
        return text
    places = [m.span() for m in _WORD.finditer(text.encode().lower().decode())]
    out, last, k = [], 0, 0
    while k < len(hits):
        end = k
        while end + 1 < len(hits) and hits[end + 1] == hits[end] + 1:
            end += 1
        out += [text[last: places[hits[k]][0]], "\n"]
        last, k = places[hits[end]][1], end + 1
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, coverage: float = 0.5,
                  length_column: str | None = None) -> DataFrame:
    """``docs`` without test passages: hit spans are cut, documents with more than ``coverage`` hit words go.

    Cutting can bring words together that form another window, so it is repeated until nothing is hit.
    Documents without hits stay untouched, null and empty texts included. ``length_column``, if given, gets the
    new number of characters where a text changed.
    """
    given = docs.columns
    number = given.index(text)
    built = automata(benchmark, window=window)

    def scanned(part: DataFrame) -> DataFrame:
        names = [f"_c{i}" for i in range(len(given))]
        found = find_items(part, benchmark, text, window=window, built=built, cut=True).toDF(*names, "_hits", "_items", "_n", "_longest")
        hit, columns = F.size("_hits") > 0, []
        for i, name in enumerate(given):
            column = F.col(names[i])
            if name == length_column:
                column = F.when(hit, F.length(names[number])).otherwise(column).cast(part.schema[i].dataType)
            columns.append(column.alias(name))
        kept = found.filter(~hit | (F.size("_hits") <= coverage * F.col("_n")))
        return materialise(kept.select(*columns, hit.alias("_cut")), "decontaminated")

    done = None
    while True:
        both = scanned(docs)
        clean = both.filter("not _cut").drop("_cut")
        done = clean if done is None else done.unionByName(clean)
        docs = both.filter("_cut").drop("_cut")
        if docs.isEmpty():
            return done
