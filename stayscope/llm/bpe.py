"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The rank file of a public vocabulary is turned into a byte-level model: each byte stands for one
printable character (the byte table), each pair of tokens that joins to a token is a merge at that
token's rank, and a piece that is a token as a whole is taken as it is. Pieces are the matches of the vocabulary's
split pattern. Texts are cut into chunks where a word ends and a space with a word follows; no match
of the pattern spans such a place, so the chunks' tokens are those of the whole text. The library encodes
each distinct chunk once, in batches, and keeps a bounded number of them for later texts. Tokens carry byte offsets from the byte table and the offsets of the characters that they touch; a
character split over tokens belongs to each of them. Decoding reverses the byte table; bytes that are not
UTF-8 by themselves stay available as bytes and become replacement characters in the text.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stayscope.llm.common import slices

#: Bytes of chunks and ids that a worker keeps, Python's own cost included.
KEPT_BYTES = 64 << 20
ENTRY_BYTES = 200
BATCH = 20_000
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD = re.compile(r"[^\S \n]")
# A word of Latin letters, then punctuation: two matches of the pattern, whatever the Unicode version.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|()-]*)\Z")


@lru_cache(1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        table.setdefault(b, chr(0x100 + len(table) - len(plain)))
    return [table[b] for b in range(256)]


def read_ranks(lines: list[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """The lines of a rank file and the pattern that splits texts."""

    lines: tuple[bytes, ...]
    pattern: str

    @staticmethod
    def load(path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:
            return Vocabulary(tuple(file.read().splitlines()), pattern)


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    """A rank file of the installed public vocabularies with their split pattern."""
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


@lru_cache(2)
def token_bytes(vocabulary: Vocabulary) -> list[bytes]:
    """The bytes of each id; all that decoding needs."""
    ranks = read_ranks(list(vocabulary.lines))
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


@lru_cache(2)
def codec(vocabulary: Vocabulary):
    """The tokenizer and the length of each id's bytes, built once in a worker that encodes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(list(vocabulary.lines))
    letters = byte_characters()
    shown = {token: "".join(letters[b] for b in token) for token in ranks}
    pairs = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                pairs.append((rank, ranks[left], ranks[right]))
    table = token_bytes(vocabulary)
    merges = [(shown[table[left]], shown[table[right]]) for _, left, right in sorted(pairs)]
    model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=50_000)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(vocabulary.pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    tokenizer.encode_special_tokens = True
    return tokenizer, np.array([len(t) for t in table], np.int64)


def chunks_of(text: str) -> list[str]:
    """Pieces that end where a word ends and a space with a word follows."""
    if not text or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or _ODD.search(text):
        return _CUT.split(text) if text else []
    first, *rest = text.split(" ")
    return [first, *[" " + word for word in rest]]


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> list[np.ndarray]:
    """The ids of each text; chunks that no earlier text had are encoded together."""
    tokenizer, kept = codec(vocabulary)[0], _chunk_ids(vocabulary)
    cut = [chunks_of(t) for t in texts]
    new = set().union(*cut).difference(kept)
    if kept.bytes > KEPT_BYTES:
        kept.clear()
        kept.bytes = 0
        new = set().union(*cut)
    letters, model, other = _byte_translation(), tokenizer.model, []
    pieces: dict[str, bytes] = {}
    for chunk in new:
        if (plain := _PLAIN.match(chunk)) is None:
            other.append(chunk)
            continue
        ids = b""
        for piece in plain.groups():  # one match of the split pattern each
            if piece:
                if (found := pieces.get(piece)) is None:
                    found = pieces[piece] = _packed([t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(letters))])
                ids += found
        kept[chunk] = ids
    for at in range(0, len(other), BATCH):
        part = other[at: at + BATCH]
        kept.update(zip(part, [_packed(e.ids) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]))
    kept.bytes += sum(ENTRY_BYTES + len(chunk) + len(kept[chunk]) for chunk in new)
    return [np.frombuffer(b"".join(map(kept.__getitem__, chunks)), np.int32) for chunks in cut]


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


@lru_cache(1)
def _byte_translation() -> dict[int, str]:
    return dict(enumerate(byte_characters()))


class _Kept(dict):
    """Packed ids by chunk, and about how many bytes they fill."""

    bytes = 0


@lru_cache(2)
def _chunk_ids(vocabulary: Vocabulary) -> _Kept:
    return _Kept()


def offsets(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token the byte where it starts, the first character it touches, and one past the last."""
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    if not len(ids):
        return starts, starts, starts
    return starts, character[starts], character[ends - 1] + 1


def decode_bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The bytes of ids; an id outside the vocabulary has none."""
    return b"".join([table[i] for i in ids.tolist() if 0 <= i < len(table)])


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """The ``keep`` columns and ``ids array<int>``; with ``spans`` also ``byte_start``, ``char_start``, ``char_end``.

    Null and empty texts have no ids. Repeated rows stay repeated; an empty table gives no rows; other columns are left out.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    extra = ["byte_start", "char_start", "char_end"] if spans else []
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in kept.dtypes[:-1]), "ids array<int>", *(f"{c} array<int>" for c in extra)])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        sizes = codec(vocabulary)[1]
        for part in slices(batches, "_text", 2 << 20):
            texts = [t or "" for t in part.column("_text").to_pylist()]
            ids = encode_texts(texts, vocabulary)
            columns = [pa.array(ids, pa.list_(pa.int32()))]
            if spans:
                found = [offsets(t, i, sizes) for t, i in zip(texts, ids)]
                columns += [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], "ids", *extra])

    return kept.mapInArrow(run, schema)


def _digests(lists: list[np.ndarray], raw: list[bytes], names: list[str]) -> list[pa.Array]:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of ids and the bytes that they decode to."""
    return [
        pa.array([len(v) for v in lists], pa.int64()),
        pa.array([hashlib.sha256(",".join([names[i] for i in v.tolist()]).encode()).hexdigest() for v in lists], pa.string()),
        pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
    ]


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``ids``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the encoded and decoded texts.

    What ``decode`` with ``digests`` gives for the rows of ``encode``, in one pass: chained, they would take two workers a
    task, and as workers are pooled each of them would come to hold a tokenizer and a cache. Odd rows as in ``encode``.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    extra = ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = ", ".join([
        *(f"`{c}` {kind}" for c, kind in kept.dtypes[:-1]), "ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    ])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        table = token_bytes(vocabulary)
        names = list(map(str, range(len(table))))
        for part in slices(batches, "_text", 2 << 20):
            ids = encode_texts([t or "" for t in part.column("_text").to_pylist()], vocabulary)
            columns = [pa.array(ids, pa.list_(pa.int32())), *_digests(ids, [decode_bytes(v, table) for v in ids], names)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], *extra])

    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """The ``keep`` columns, ``raw`` (the decoded bytes) and ``decoded`` (as text, split characters replaced).

    Null ids decode like none. With ``digests`` the bytes are replaced by ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256``, for checks that need no texts.
    """
    kept = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("_ids"))
    extra = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "raw binary, decoded string"
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in kept.dtypes[:-1]), extra])
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(shared.value)
        names = list(map(str, range(len(table))))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [np.asarray(v if v is not None else [], np.int64) for v in part.column("_ids").to_numpy(zero_copy_only=False)]
                raw = [decode_bytes(v, table) for v in lists]
                if digests:
                    columns = _digests(lists, raw, names)
                    fields = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns = [pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw])]
                    fields = ["raw", "decoded"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], *fields])

    return kept.mapInArrow(run, schema)
