"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint is the bitwise majority over the XXH64 values of its word shingles. Two
fingerprints link if at most two bits differ. The 64 bits are cut into two halves, fewer than the
three that exact segment matching would need, so in any linked pair one half differs by at most one
bit. Either one half is equal, or each half differs in exactly one bit. The index therefore holds,
for each distinct fingerprint, both halves as they are and the upper half with one bit wildcarded
(32 variants). An equality join on these keys finds every linked pair.

Pairs inside a key are not listed. A key that only one fingerprint has is dropped; the others are
refined by the same idea on the other half: its one-bit neighbours where the indexed half is equal, its
one-wildcard variants where it has a wildcard. All fingerprints that share a refined key lie within
two bits of each other, there are at most 33 of them, and each is linked to the smallest after
verifying the bit distance. Work is linear in the distinct fingerprints, however many documents
or near copies share them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayscope.llm.common import slices, utf8
from stayscope.llm.components import components
from stayscope.session import materialise

SEED = 42
BLOCK = 1 << 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` lower-cased words; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest as digest

    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(found) - words + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist())], np.uint64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """Bit b is 1 if it is set in over half the shingle hashes; 0 for a text without words."""
    hashes = shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at: at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes)))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """The ``keep`` columns and ``_bits``, the fingerprint as a signed long. A null text has no words."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in kept.dtypes[:-1]), "_bits bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            bits = np.array([fingerprint(x, words) for x in utf8(part.column("_text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(bits, pa.int64())], names=[*part.schema.names[:-1], "_bits"]
            )

    return kept.mapInArrow(run, schema)


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``_bits`` that join all pairs within ``distance`` bits."""
    if distance not in (0, 1, 2):
        raise ValueError("the index of two halves with one wildcard serves distances up to 2")
    bits = F.col("_bits")
    if distance == 0:
        return distinct.select(bits.alias("u"), bits.alias("v")).limit(0)
    upper, lower = F.shiftrightunsigned(bits, 32), bits.bitwiseAND(F.lit(0xFFFFFFFF))
    flips = [F.lit(1 << b) for b in range(32)]

    def neighbours(half):
        return F.array(half, *[half.bitwiseXOR(f) for f in flips])

    def wildcards(half):
        return [half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << b))) for b in range(32)]

    def index(kinds_and_keys):
        return F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), key.alias("key")) for k, key in kinds_and_keys]))

    variants = [(-2, lower), (-1, upper), *enumerate(wildcards(upper))]
    indexed = distinct.select(bits, index(variants).alias("e")).select("_bits", "e.kind", "e.key")
    shared = indexed.groupBy("kind", "key").agg(F.count("*").alias("n")).filter("n > 1").select("kind", "key")
    # the index has 34 rows a fingerprint, but is sized as the table before the explode: neither side may be broadcast by that size
    hits = indexed.join(shared.hint("merge"), ["kind", "key"])
    equal = hits.filter("kind < 0").select(
        "kind", "key", "_bits", F.explode(F.when(F.col("kind") == -1, neighbours(lower)).otherwise(neighbours(upper))).alias("rest"),
        F.lit(-1).alias("bit"),
    )
    wild = hits.filter("kind >= 0").select("kind", "key", "_bits", index(list(enumerate(wildcards(lower)))).alias("e")).select(
        "kind", "key", "_bits", F.col("e.key").alias("rest"), F.col("e.kind").alias("bit")
    )
    groups = equal.unionByName(wild).groupBy("kind", "key", "rest", "bit").agg(F.collect_set("_bits").alias("members"))
    pairs = groups.filter("size(members) > 1").select(
        F.explode("members").alias("u"), F.array_min("members").alias("v")
    )
    return pairs.filter((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).distinct()


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), words: int = 3,
                   distance: int = 2) -> DataFrame:
    """One row per row of ``docs``: the id, the ``keep`` columns, ``fingerprint``, ``component_id``.

    Null and empty texts have fingerprint zero, which links like any other. Repeated rows stay
    repeated. A null id takes part; ``component_id`` is the smallest id that is not null, null if a
    group has none. An empty table gives no rows. Extra columns of ``docs`` are left out.
    """
    columns = (id_column, *[c for c in keep if c != id_column])
    rows = materialise(fingerprints(docs, text, columns, words), "fingerprints")
    identity = F.col(f"`{id_column}`")
    distinct = materialise(rows.groupBy("_bits").agg(F.min(identity).alias("_least")), "distinct")
    groups = components(links(distinct, distance)).select(F.col("node").alias("_bits"), F.col("component").alias("_root"))
    rooted = distinct.join(groups, "_bits", "left").withColumn("_root", F.coalesce("_root", "_bits"))
    smallest = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = materialise(rooted.join(smallest, "_root").select("_bits", "component_id"), "named")
    return rows.join(named.hint("merge"), "_bits").select(
        *[F.col(f"`{c}`") for c in columns], F.lpad(F.lower(F.hex("_bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id, the first of its rows if it repeats.

    A null id comes after all others. Rows are numbered in a written table, so that the choice does
    not depend on a recomputed scan.
    """
    number = "_row_number"
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = materialise(simhash_groups(numbered, id_column, text, (number,), words, distance), "groups")
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("null "), "fingerprint"))
    kept = rows.groupBy(group).agg(
        F.min(F.struct(F.col(f"`{id_column}`").isNull().alias("a"), F.col(f"`{id_column}`").alias("b"), F.col(number).alias("c"))).alias("m")
    ).select(F.col("m.c").alias(number))
    return numbered.join(kept.hint("merge"), number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
