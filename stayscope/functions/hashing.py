"""Repeatable pseudo-random draws.

Every draw is a function of a row's own key, so it does not depend on partitioning, row order
or task retries: a recomputed task yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(seed: object, *keys: Column) -> Column:
    """32 hex digits from the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[key.cast("string") for key in keys]))


def uniform(hex_digest: Column, part: int = 0) -> Column:
    """A number in [0, 1) from one of the four 8-digit parts of a digest."""
    piece = F.substring(hex_digest, 1 + 8 * part, 8)
    return F.conv(piece, 16, 10).cast("double") / F.lit(4294967296.0)


def pick(hex_digest: Column, size: int, part: int = 0) -> Column:
    """An integer in [0, size) from one part of a digest."""
    return F.floor(uniform(hex_digest, part) * F.lit(float(size))).cast("int")
