"""Language-model scores by online logistic context mixing.

A text is a sequence of symbols: its lower-cased words, then an end. The ``VOCABULARY`` most frequent words of the training
texts are symbols if they occur twice; any other word is an escape and its bytes. Each symbol is a path of binary decisions in
a Huffman tree, and each decision is predicted in several contexts: the tree node alone, the node after the
word before, and the node after the last frequent word; for bytes, the node after one, two and three symbols.
Contexts are hashed into a table of counts. Decisions of every depth are mixed.

Counts are taken in tasks over all training texts and summed by slot in Spark; the table's size is a parameter of the model
and does not grow. The predictions are combined in the logistic domain: each has a weight that is chosen by a gate (kind and
depth of the decision) and by how often its context was seen. Weights are first fitted over all distinct training
texts, a decision's own occurrence taken out of the counts: groups of about ``GROUP`` tokens learn each from the same start, and their
states are averaged by their decisions. Within each text they go on learning online after each ``BLOCK``
decisions, from the first block on; so does a last refinement, a map from the mixed probability to the observed one. All are reset
between texts, so a score does not depend on the order or the place of a text.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stayscope.llm.common import BATCH_ROWS, drop_unreachable, slices, utf8
from stayscope.session import materialise

VOCABULARY = 1 << 17
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
CHUNK = 1024
GROUP = 1 << 20
FREQUENT = 256
BLOCK = 128
FIT_BLOCK = 4_096
#: Symbols whose decisions are made at a time, texts that are scored and groups that are fitted side by side: an array
#: operation has a fixed cost, but what it works on should stay in the cache.
RUN, ABREAST, SIDE = 1 << 15, 192, 4
RANGE = 12
GATES = 4
LEVELS = 16
KNOTS = 33
RATE, MAP_RATE = 0.02, 0.02
FLUSH = 400_000
PART = 1 << 19
SCORED, TOGETHER = 3 << 19, 3
END = b"\n"  # no word holds white space
ESCAPE = b" "


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all texts of ``docs`` (text), the ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in slices(batches, "text"):
            for text in utf8(part.column("text")):
                held.update(words_of(text))
            held[END] += part.num_rows
            if len(held) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])

    return docs.select("text").mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per symbol the start of its path and, for all paths, the nodes and the bits; nodes are numbered from 0."""
    size = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * size - 1, np.int64), np.zeros(2 * size - 1, np.int64)
    for node in range(size, 2 * size - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        side[j] = 1
        heapq.heappush(heap, (a + b, node))
    paths = []
    for symbol in range(size):
        path, at = [], symbol
        while at != 2 * size - 2:
            path.append(((parent[at] - size) << 1) | side[at])
            at = parent[at]
        paths.append(path[::-1])
    starts = np.concatenate(([0], np.cumsum([len(p) for p in paths])))
    flat = np.fromiter((x for p in paths for x in p), np.int64, int(starts[-1]))
    return starts, flat >> 1, flat & 1


@dataclass
class Coder:
    """Symbols of words and bytes and their decisions."""

    numbers: dict[bytes, int]
    starts: np.ndarray
    sizes: np.ndarray
    steps: np.ndarray
    even: np.ndarray

    @staticmethod
    def fit(words: list[bytes], counts: list[int], byte_counts: np.ndarray) -> Coder:
        """The paths of all words and bytes, whole; ``even`` has the nodes' probabilities by their frequencies."""
        size = len(words)
        starts, nodes, bits = huffman(np.array(counts))
        more, byte_nodes, byte_bits = huffman(byte_counts + 1)
        here = np.repeat(np.array(counts, np.float64), np.diff(starts))
        ones = np.bincount(nodes, weights=here * bits, minlength=size)
        total = np.bincount(nodes, weights=here, minlength=size)
        depth = np.arange(len(nodes)) - np.repeat(starts[:-1], np.diff(starts))
        gate = np.where(depth < 2, 0, np.where(depth < 5, 1, 2))
        steps = np.concatenate((nodes << 3 | gate << 1 | bits, (byte_nodes + size) << 3 | 3 << 1 | byte_bits)).astype(np.int32)
        sizes = np.concatenate((np.diff(starts), np.diff(more)))
        firsts = np.concatenate((starts[:-1], more[:-1] + starts[-1]))
        even = (ones + 0.2) / (total + 0.4)
        return Coder({w: i for i, w in enumerate(words)}, firsts.astype(np.int32), sizes.astype(np.int32), steps.astype(np.int32), even)

    @property
    def nodes(self) -> int:
        return len(self.numbers) + 256

    def symbols(self, texts: list[bytes]):
        """Symbols of all texts, three context numbers of each, whether it is a byte, the symbols per text, words not
        in the vocabulary, and per text the words and those among them."""
        words: list[bytes] = []
        sizes = []
        for text in texts:
            found = words_of(text)
            words += found
            words.append(END)
            sizes.append(len(found) + 1)
        size, escape, end = len(self.numbers), self.numbers[ESCAPE], self.numbers[END]
        known = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int32, len(words))
        unknown = np.flatnonzero(known < 0)
        spelled = [words[i] for i in unknown.tolist()]
        long = np.ones(len(words), np.int32)
        long[unknown] += np.fromiter(map(len, spelled), np.int32, len(spelled)) + 1
        places = np.cumsum(long, dtype=np.int64) - long
        total = int(long.sum())
        symbols = np.empty(total, np.int32)
        is_byte = np.ones(total, bool)
        is_byte[places] = False
        tokens = np.where(known < 0, escape, known)
        symbols[places] = tokens
        ends = np.cumsum(sizes)
        first = np.concatenate(([0], ends[:-1])).astype(np.int64)
        before = np.concatenate(([escape], tokens[:-1]))
        before[first] = end
        at = np.where(before < FREQUENT, np.arange(len(tokens)), 0)
        at[first] = first
        frequent = before[np.maximum.accumulate(at)]
        context = np.zeros((3, total), np.uint32)
        context[1, places] = (before + 1).astype(np.uint32) * np.uint32(0x2545F491)
        context[2, places] = (frequent + 1).astype(np.uint32) * np.uint32(0x6C8E9CF5) + np.uint32(77)
        if spelled:
            symbols[is_byte] = np.frombuffer(b"\0".join(spelled) + b"\0", np.uint8).astype(np.int32) + size
            shifted = np.concatenate((np.full(3, escape, np.int32), symbols)).astype(np.uint32) + np.uint32(1)
            spots = np.flatnonzero(is_byte) + 3
            one = shifted[spots - 1] * np.uint32(0x27D4EB2F)
            two = one * np.uint32(31) + shifted[spots - 2] * np.uint32(0x165667B1)
            context[0, spots - 3] = one
            context[1, spots - 3] = two
            context[2, spots - 3] = two * np.uint32(31) + shifted[spots - 3] * np.uint32(0x9E3779B1)
        return symbols, context, is_byte, np.add.reduceat(long, first), known, spelled, first

    def decisions(self, symbols: np.ndarray, context: np.ndarray, is_byte: np.ndarray):
        """Table slots of the three predictors, the bit and the gate of each decision, and the decisions per symbol."""
        long = self.sizes[symbols]
        ends = np.cumsum(long, dtype=np.int64)
        count = int(ends[-1]) if len(ends) else 0
        at = np.repeat((self.starts[symbols] - (ends - long)).astype(np.int32), long) + np.arange(count, dtype=np.int32)
        step = self.steps.take(at)
        node = (step >> 3).astype(np.uint32)
        spread = node * np.uint32(0x9E3779B1)
        slots = np.empty((3, count), np.int64)
        for row in range(3):
            hashed = np.repeat(context[row], long)
            hashed ^= spread
            hashed *= np.uint32(0x85EBCA6B)
            hashed >>= np.uint32(32 - SLOT_BITS)
            slots[row] = hashed
        words = ~np.repeat(is_byte, long)
        np.copyto(slots[0], node + np.uint32(SLOTS), where=words)
        return slots, step & 1, (step >> 1) & 3, long

    def runs(self, symbols: np.ndarray, context: np.ndarray, is_byte: np.ndarray) -> Iterator[tuple]:
        """The decisions of ``RUN`` symbols at a time."""
        for at in range(0, len(symbols), RUN):
            run = slice(at, at + RUN)
            yield self.decisions(symbols[run], context[:, run], is_byte[run])

    def predictions(self, symbols: np.ndarray, context: np.ndarray, is_byte: np.ndarray, look: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        """The three predictions of each decision with its gate, as ``State`` reads them, its bit, and the first decision of each
        symbol, with their number at the end; ``look`` has the predictions by slots and bits."""
        ends = np.concatenate(([0], np.cumsum(self.sizes[symbols], dtype=np.int64)))
        packed, bits = np.empty((3, int(ends[-1])), np.int16), np.empty(int(ends[-1]), np.int8)
        at = 0
        for slots, bit, gate, _ in self.runs(symbols, context, is_byte):
            here = slice(at, at + len(bit))
            np.bitwise_or(look(slots, bit), (gate << 4).astype(np.int16), out=packed[:, here])
            bits[here] = bit
            at += len(bit)
        return packed, bits, ends


def slot_counts(docs: DataFrame, coder: Coder) -> DataFrame:
    """(chunk, counts) of the decisions of all texts of ``docs`` (text): the cells, slot and bit, in chunks of ``CHUNK``.

    Each task sums its texts first and sends one row per chunk; the sums of a chunk meet in one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    schema = "chunk int, counts binary"

    def rows(counts: np.ndarray, chunks: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(chunks), 1024):
            some = chunks[at: at + 1024]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([counts[c].tobytes() for c in some.tolist()], pa.binary())], names=["chunk", "counts"]
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        counts, ones = np.zeros(2 * SLOTS, np.int32), np.ones(0, np.int32)
        for part in slices(batches, "text", PART):
            symbols, context, is_byte, *_ = coder.symbols(utf8(part.column("text")))
            for slots, bit, _, _ in coder.runs(symbols, context, is_byte):
                cells = (slots << 1) | bit
                if len(bit) > len(ones):
                    ones = np.ones(2 * len(bit), np.int32)
                for some in (cells[0][slots[0] < SLOTS], cells[1], cells[2]):
                    np.add.at(counts, some, ones[: len(some)])
        counts = counts.reshape(-1, CHUNK)
        yield from rows(counts, np.flatnonzero(counts.any(axis=1)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                found = np.frombuffer(counts.as_buffer(), np.int32)
                if chunk in sums:
                    sums[chunk] += found
                else:
                    sums[chunk] = found.astype(np.int64)
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["chunk", "counts"])

    return docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


def _packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A prediction: its logit in steps of 1/16, from bit 6, and how often the context was seen, in 4 bits; the gate comes between."""
    total = zeros + ones
    p = (ones + 0.2) / (total + 0.4)
    logit = np.clip(np.rint(16 * np.log(p / (1 - p))), -128, 127).astype(np.int16)
    level = np.minimum(2 * np.log2(total + 1), LEVELS - 1).astype(np.int16)
    return np.where(total > 0, logit, 0) << 6 | level


@dataclass
class State:
    """Per text the weights by predictor, gate and level, and by gate the map from the mixed logit to a probability."""

    weights: np.ndarray
    refine: np.ndarray

    @staticmethod
    def start() -> State:
        return State(np.full((1, 3 * GATES * LEVELS), 0.4), np.tile(_squash(np.linspace(-8, 8, KNOTS)), (1, GATES)))

    def of_texts(self, texts: int) -> State:
        return State(np.repeat(self.weights, texts, axis=0), np.repeat(self.refine, texts, axis=0))

    def mix(self, packed: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of decisions in rows that belong to the texts of ``text``: the weights' cells, the logits, the mixed probability, its place
        among the knots and the first knot."""
        cell = (packed & (GATES * LEVELS - 1)).astype(np.int64)
        cell += (np.arange(3) * (GATES * LEVELS))[:, None, None] + (text * self.weights.shape[1])[:, None]
        logit = (packed >> 6).astype(np.float64)
        logit *= 1 / 16
        parts = self.weights.ravel().take(cell)
        parts *= logit
        mixed = parts[0]
        mixed += parts[1]
        mixed += parts[2]
        np.clip(mixed, -RANGE, RANGE, out=mixed)
        plain = np.negative(mixed, out=parts[1])
        np.exp(plain, out=plain)
        plain += 1
        np.reciprocal(plain, out=plain)
        place = np.clip(mixed, -8, 8, out=mixed)
        place += 8
        place *= (KNOTS - 1) / 16
        spot = ((packed[0] >> 4 & (GATES - 1)) * KNOTS).astype(np.int64)
        spot += (text * self.refine.shape[1])[:, None]
        return cell, logit, plain, place, spot

    def chance(self, plain: np.ndarray, place: np.ndarray, spot: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The probability of each decision after the map."""
        left = place.astype(np.int64)
        np.minimum(left, KNOTS - 2, out=left)
        share = place - left
        left += spot
        flat = self.refine.ravel()
        mapped = flat.take(left)
        left += 1
        p = flat.take(left)
        p -= mapped
        p *= share
        p += mapped
        p += plain
        p *= 0.5
        np.clip(p, 1e-6, 1 - 1e-6, out=p)
        p -= 1 - bit
        return np.abs(p, out=p)

    def learn(self, cell: np.ndarray, logit: np.ndarray, plain: np.ndarray, place: np.ndarray, spot: np.ndarray, bit: np.ndarray) -> None:
        """The first texts, a row of decisions each, learn from them."""
        learners = len(bit)
        logit *= bit - plain
        size = learners * self.weights.shape[1]
        seen = cell.ravel()
        total = np.bincount(seen, weights=logit.ravel(), minlength=size)
        total *= RATE
        count = np.bincount(seen, minlength=size) + 1.0
        total /= np.sqrt(count, out=count)
        self.weights[:learners] += total.reshape(learners, -1)
        spot += np.rint(place).astype(np.int64)
        spot *= 2
        spot += bit
        size = learners * self.refine.shape[1]
        count = np.bincount(spot.ravel(), minlength=2 * size).reshape(learners, -1, 2)
        total, count = count[:, :, 1], (count[:, :, 0] + count[:, :, 1]).astype(np.float64)
        gap = total - count * self.refine[:learners]
        gap *= MAP_RATE
        count *= MAP_RATE
        count += 1
        gap /= count
        self.refine[:learners] += gap


@dataclass
class Mixer:
    """The table's predictions and the state that every text starts with."""

    coder: Coder
    table: np.ndarray
    state: State

    @staticmethod
    def of(coder: Coder, zeros: np.ndarray, ones: np.ndarray) -> Mixer:
        order = np.rint(16 * np.log(coder.even / (1 - coder.even)))
        nodes = np.clip(order, -128, 127).astype(np.int16) << 6 | (LEVELS - 1)
        return Mixer(coder, np.concatenate((_packed(zeros, ones), nodes, np.zeros(256))).astype(np.int16), State.start())

    def log2(self, texts: list[bytes]):
        """log2 of the probability of each text, learning online within it; then what ``symbols`` found."""
        return next(self.log2_together([texts]))

    def log2_together(self, parts: list[list[bytes]]) -> Iterator[tuple]:
        """``log2`` of each list of texts; their blocks are taken side by side."""
        found = [self.coder.symbols(texts) for texts in parts]
        made = [self.coder.predictions(*one[:3], lambda slots, _: self.table.take(slots)) for one in found]
        packed, bits = np.concatenate([p for p, *_ in made], axis=1), np.concatenate([b for _, b, _ in made])
        sizes = np.concatenate([np.diff(ends[np.concatenate(([0], np.cumsum(one[3])))]) for one, (*_, ends) in zip(found, made)])
        del made
        stops = np.cumsum(sizes)
        # each text has its own state; the longest come first
        order = np.argsort(-sizes, kind="stable")
        out = np.zeros(len(sizes))
        for at in range(0, len(order), ABREAST):
            some = order[at: at + ABREAST]
            out[some] = self._logs(packed, bits, stops[some] - sizes[some], stops[some])
        for logs, one in zip(np.split(out, np.cumsum(list(map(len, parts)))[:-1]), found):
            yield logs, *one[4:]

    def _logs(self, packed: np.ndarray, bits: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """log2 of the probability of texts by where their decisions begin and stop, the longest first."""
        texts = len(begins)
        state, logs = self.state.of_texts(texts), np.zeros(texts)
        blocks, inner, numbers = (stops - begins) // BLOCK, np.arange(BLOCK), np.arange(texts)
        for number in range(int(blocks[0])):
            live = int(np.searchsorted(-blocks, -number, side="left"))
            places = (begins[:live] + number * BLOCK)[:, None] + inner
            bit = bits.take(places).astype(np.int64)
            mixed = state.mix(packed.take(places, axis=1), numbers[:live])
            logs[:live] += _log2_of_rows(state.chance(*mixed[2:], bit))
            state.learn(*mixed, bit)
        # what is left of a text is less than a block, and nothing learns from it
        rest = stops - begins - blocks * BLOCK
        at = np.cumsum(rest) - rest
        places = np.repeat(begins + blocks * BLOCK - at, rest) + np.arange(int(rest.sum()))
        if len(places):
            text = np.repeat(numbers, rest)
            _, _, *mixed = state.mix(packed.take(places, axis=1)[:, :, None], text)
            each = np.log2(state.chance(*mixed, bits.take(places).astype(np.int64)[:, None]))
            logs += np.bincount(text, each.ravel(), texts)
        return logs


def _log2_of_rows(p: np.ndarray) -> np.ndarray:
    """The sum of log2 over each row of a block, from products of eight: each is 1e-6 at least."""
    while p.shape[1] > BLOCK // 8:
        half = p.shape[1] // 2
        p = p[:, :half] * p[:, half:]
    return np.log2(p).sum(axis=1)


def fit_state(training: DataFrame, mixer: Mixer, zeros: np.ndarray, ones: np.ndarray, tokens: int) -> State:
    """The start state, learned on all distinct texts of ``training`` (text), which have ``tokens`` tokens at most.

    Groups are dealt and put in order by the text, so the state does not depend on the order or the number of equal rows. A task
    learns ``SIDE`` groups side by side and holds their texts.
    """
    less = [_packed(np.maximum(zeros - 1, 0), ones), _packed(zeros, np.maximum(ones - 1, 0))]  # without a 0, without a 1
    nodes = mixer.table[SLOTS:]
    table = np.stack([np.concatenate((x, nodes)) for x in less], axis=1).astype(np.int16).ravel()
    shared = training.sparkSession.sparkContext.broadcast((mixer.coder, table))

    def blocks(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        coder, table = shared.value
        for part in slices(rows.combine_chunks().to_batches(BATCH_ROWS), "text", PART):
            symbols, context, is_byte, *_ = coder.symbols(utf8(part.column("text")))
            packed, bits, _ = coder.predictions(symbols, context, is_byte, lambda slots, bit: table.take(slots << 1 | bit))
            for at in range(0, len(bits), FIT_BLOCK):
                yield packed[:, at: at + FIT_BLOCK], bits[at: at + FIT_BLOCK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:  # those of one group lie together
            number = batch.column("number").to_numpy()
            for some in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
                groups.setdefault(int(number[some[0]]), []).append(batch.slice(int(some[0]), len(some)))
        waiting = [blocks(pa.Table.from_batches(group)) for group in groups.values()]
        del groups
        state, seen = State.start().of_texts(len(waiting)), np.zeros(len(waiting))
        while True:
            found: dict[int, list[tuple]] = {}
            for at, more in enumerate(waiting):
                block = next(more, None)
                if block is not None:
                    found.setdefault(len(block[1]), []).append((at, *block))
            if not found:
                break
            for size, alike in found.items():
                at = [number for number, *_ in alike]
                some = State(state.weights[at], state.refine[at])
                packed, bits = np.stack([p for _, p, _ in alike], axis=1), np.stack([b for *_, b in alike]).astype(np.int64)
                some.learn(*some.mix(packed, np.arange(len(at))), bits)
                state.weights[at], state.refine[at] = some.weights, some.refine
                seen[at] += size
        for weights, refine, count in zip(state.weights, state.refine, seen):
            values = np.concatenate((weights, refine))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values * count), pa.array(np.full(len(values), count))], names=["cell", "value", "seen"])

    count = max(1, -(-tokens // GROUP))
    dealt = training.select("text").distinct().select("text", F.pmod(F.hash("text"), F.lit(count)).alias("number"))
    groups = dealt.repartitionById(-(-count // SIDE), F.floor(F.col("number") / SIDE).cast("int")).sortWithinPartitions("number", "text")
    found = groups.mapInArrow(run, "cell int, value double, seen double").groupBy("cell").agg((F.sum("value") / F.sum("seen")).alias("value"))
    values = [r["value"] for r in found.orderBy("cell").collect()]  # one per weight and knot
    state = State.start()
    if values:
        size = state.weights.size
        state = State(np.array(values[:size])[None], np.array(values[size:])[None])
    return state


def score(docs: DataFrame, learns: Column, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    ``learns`` marks the training rows. ``base_score`` is the sum over tokens of the smoothed log10 frequency, ``score`` the mixed model's log10
    probability of the token sequence, ``bits_per_byte`` its bits over the bytes of the text (over 1 if it is
    empty). A null text is an empty one, which is an end alone. Repeated rows stay repeated and learn repeatedly; if nothing is there to learn
    from, all words are spelled at even odds. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(*keep, F.coalesce(learns, F.lit(False)).alias("_learns"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    training = rows.filter("_learns").select("text")
    counts = materialise(token_counts(training), "tokens")
    facts = counts.agg(F.sum("c").alias("all"), F.count("*").alias("distinct")).first()
    all_tokens, distinct = int(facts["all"] or 0), facts["distinct"]
    found = counts.orderBy(F.desc("c"), "token").limit(VOCABULARY).toArrow()
    top = list(zip(found.column("token").to_pylist(), found.column("c").to_pylist()))
    del found
    listed = dict(top)
    # texts can be so long that their ends are rarer than the listed words
    listed[END] = int(counts.filter(F.col("token") == F.lit(END)).agg(F.sum("c")).first()[0] or 0)
    # words seen once are spelled, so that spelling is learned from words as rare as the unseen ones
    symbols = [(w, c) for w, c in top if c > 1 and w != END]
    rest = all_tokens - sum(c for _, c in symbols) - listed[END]
    words = [*symbols, (END, listed[END] + 1), (ESCAPE, rest + 1)]
    words.sort(key=lambda x: (-x[1], x[0]))
    byte_counts = np.zeros(256, np.int64)
    for word, c in top[len(top) // 2:]:
        byte_counts += np.bincount(np.frombuffer(word + b"\0", np.uint8), minlength=256) * c
    coder = Coder.fit([w for w, _ in words], [c for _, c in words], byte_counts)
    drop_unreachable(spark)
    cells = slot_counts(training, coder).toArrow()  # at most 2 * SLOTS / CHUNK rows
    table = np.zeros((2 * SLOTS // CHUNK, CHUNK), np.float32)
    for chunk, found in zip(cells.column("chunk").to_pylist(), cells.column("counts")):
        table[chunk] = np.frombuffer(found.as_buffer(), np.float32)
    table = table.ravel()
    zeros, ones = table[::2], table[1::2]
    mixer = Mixer.of(coder, zeros, ones)
    mixer.state = fit_state(training, mixer, zeros, ones, all_tokens)
    del cells, table, zeros, ones
    drop_unreachable(spark)
    seen = np.array([listed.get(w, 0) for w in coder.numbers], np.float64)
    scale, shift = all_tokens + 0.5 * (distinct + 1), 0.5
    shared = spark.sparkContext.broadcast((mixer, np.log10((seen + shift) / scale), seen > 0))
    numbered = rows.drop("_learns")
    kept = [f"_k{i}" for i in range(len(numbered.columns) - 1)]
    numbered = numbered.toDF(*kept, "text")
    schema = ", ".join([*(f"{c} {kind}" for c, kind in numbered.dtypes[:-1]), "n_tokens bigint, known bigint, log2 double, base double, bytes bigint, other array<struct<token:binary,n:int>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, log, seen = shared.value
        parts = slices(batches, "text", SCORED)
        while some := list(islice(parts, TOGETHER)):
            held = [utf8(part.column("text")) for part in some]
            for part, texts, (logs, ids, spelled, first) in zip(some, held, mixer.log2_together(held)):
                inside = ids >= 0
                sizes = np.diff(np.append(first, len(ids)))
                base = np.add.reduceat(np.where(inside, log[ids], 0.0), first)
                known = np.add.reduceat((inside & seen[ids]).astype(np.int64), first)
                rest = iter(spelled)
                others = [Counter(islice(rest, k)) for k in np.add.reduceat((~inside).astype(np.int64), first).tolist()]
                tokens = pa.array([w for other in others for w in other], pa.binary())
                times = pa.array([n for other in others for n in other.values()], pa.int32())
                ends = pa.array(np.cumsum([0, *map(len, others)]), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:-1], pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(logs), pa.array(base),
                    pa.array(list(map(len, texts)), pa.int64()), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([tokens, times], ["token", "n"])),
                ], names=[*kept, "n_tokens", "known", "log2", "base", "bytes", "other"])

    scored = materialise(numbered.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "mixed")
    drop_unreachable(spark)
    rare = scored.select("_row", F.explode("other").alias("o")).select("_row", "o.token", "o.n")
    log = F.log10((F.coalesce("c", F.lit(0)) + shift) / scale)
    rare = rare.join(counts, "token", "left").groupBy("_row").agg(
        F.sum(F.col("n") * log).alias("rare_base"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known")
    )
    joined = scored.drop("other").join(rare, "_row", "left")
    given = rows.columns[: len(keep)]
    return joined.select(
        *[F.col(inner).alias(name) for inner, name in zip(kept, given)], "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"), F.lit(all_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("log2") * float(np.log10(2))).alias("score"),
        (-F.col("log2") / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
