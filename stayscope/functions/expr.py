"""Column expressions shared by the operators. All stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from stayscope.schema import CURRENCY_CHARS, POSITIVE_TEXTS

NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
CURRENCY_PATTERN = f"[{CURRENCY_CHARS}]"
SKETCH_BITS = 12
CURRENCY_STRIP = rf"[{CURRENCY_CHARS}\s]"


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def text_to_number(text: Column) -> Column:
    """Text that is a plain decimal number becomes a double, anything else null.

    The pattern comes first because a bare cast also takes type suffixes such as ``1.0d``.
    """
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def to_number(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return nan_to_null(column.cast("double"))
    if is_number(dtype):
        return column.cast("double")
    if isinstance(dtype, T.BooleanType):
        return column.cast("int").cast("double")
    return text_to_number(column.cast("string"))


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def money_to_number(text: Column) -> Column:
    return text_to_number(F.regexp_replace(text, CURRENCY_STRIP, ""))


def has_currency_mark(text: Column) -> Column:
    return text.rlike(CURRENCY_PATTERN)


def means_left(column: Column) -> Column:
    """True for the label texts that mean "left"; null and everything else are False."""
    text = F.regexp_replace(column.cast("string"), r"^\s+|\s+$", "")
    return F.coalesce(F.lower(text).isin(*POSITIVE_TEXTS), F.lit(False))


def rate_pct(hit: Column) -> Column:
    """Share of rows with ``hit`` true, in percent. A null ``hit`` counts as false."""
    return F.avg(F.when(hit, F.lit(100.0)).otherwise(F.lit(0.0)))


def half_even(column: Column, places: int) -> Column:
    return F.bround(column, places)


def nearest_decimal(x: Column, places: int) -> Column:
    """Round to ``places`` decimals by the exact binary value, half-even only on a true tie.

    ``bround`` sees the shortest decimal text of a double: 0.1235 is a tie to it although the
    stored number is just below. Here the scaled value is split into a double and its rounding
    error (both exact), and the error decides what looks like a tie.
    """
    scale = F.lit(float(10**places))
    product = x * scale
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % F.lit(2.0) != 0))))
    return (whole + up.cast("double")) / scale + F.lit(0.0)


def fixed_text(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", nearest_decimal(x, places))


def about_distinct(column: Column) -> Column:
    """Approximate distinct values, within a few percent, from one sketch buffer of fixed size.

    ``approx_count_distinct`` spreads its sketch over hundreds of buffer columns, which makes an
    aggregation over many columns slow to plan and compile.
    """
    hashed = F.when(column.isNotNull(), F.xxhash64(column))
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(hashed, SKETCH_BITS)), F.lit(0))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` or null on a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def weighted_pick(u: Column, options: list[tuple[object, float]]) -> Column:
    """Inverse-CDF choice: the option whose cumulative weight first exceeds ``u``."""
    values = [value for value, _ in options]
    edges, total = [], 0.0
    for _, weight in options:
        total += weight
        edges.append(round(total, 10))
    last = F.lit(values[-1])
    return reduce(
        lambda rest, pair: F.when(u < F.lit(pair[1]), F.lit(pair[0])).otherwise(rest),
        reversed(list(zip(values[:-1], edges[:-1]))),
        last,
    )
