"""Label codes, population scaling and schema alignment, fitted on one table and applied to others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from stayscope.functions.expr import to_number
from stayscope.functions.ranges import running_totals, text_cuts
from stayscope.operators.features import feature_columns
from stayscope.schema import HR, Roles
from stayscope.session import materialise

MISSING_CLASS = "nan"
UNSEEN_CODE = -1
LOCAL_CODES = 50_000
INLINE_CODES = 64


class NotFittedError(RuntimeError):
    pass


def extract_label(df: DataFrame, roles: Roles = HR) -> DataFrame:
    """Replace the label text by ``label`` 1.0 / 0.0; unchanged when the label is absent."""
    if roles.label not in df.columns:
        return df
    hit = F.coalesce(F.col(roles.label) == roles.positive, F.lit(False))
    return df.withColumn("label", hit.cast("double")).drop(roles.label)


@dataclass
class Codes:
    """Fitted dictionary ``(column, value, code)``; ``inline`` repeats the columns with few values."""

    table: DataFrame
    inline: dict[str, dict[str, int]]


def _class_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(MISSING_CLASS))


def fit_codes(df: DataFrame, columns: list[str], local_codes: int = LOCAL_CODES) -> Codes:
    """Number the distinct values of each column 0..k-1 in ascending order, null as its own class.

    A dictionary within ``local_codes`` entries is broadcast to later joins; a larger one is
    numbered range by range and written to the shared folder.
    """
    spark = df.sparkSession
    schema = "column string, value string, code int"
    if not columns:
        return Codes(spark.createDataFrame([], schema), {})
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), _class_text(F.col(c)).alias("value")) for c in columns])
        ).alias("pair")
    ).select("pair.*").distinct()
    head = pairs.limit(local_codes + 1).collect()
    if len(head) <= local_codes:
        values = {c: sorted(r["value"] for r in head if r["column"] == c) for c in columns}
        numbered = [(c, value, code) for c in columns for code, value in enumerate(values[c])]
        inline = {c: {v: i for i, v in enumerate(vs)} for c, vs in values.items() if len(vs) <= INLINE_CODES}
        return Codes(F.broadcast(spark.createDataFrame(numbered, schema)), inline)
    pairs = materialise(pairs, "classes").withColumn("one", F.lit(1))
    ranked = running_totals(pairs, "value", {"code": "one"}, ["column"], text_cuts(pairs, "value"))
    return Codes(materialise(ranked.select("column", "value", F.col("code").cast("int")), "codes"), {})


def apply_codes(df: DataFrame, codes: Codes, columns: list[str]) -> DataFrame:
    """Replace category texts by their codes, ``-1`` where the value or column was not fitted.

    Columns with few values are looked up in a literal map, the others joined.
    """
    unseen = F.lit(UNSEEN_CODE)
    inline = {}
    for c in columns:
        if c in codes.inline:
            pairs = [F.lit(x) for pair in codes.inline[c].items() for x in pair]
            inline[c] = F.coalesce(F.create_map(*pairs)[_class_text(F.col(c))], unseen).cast("int")
    df = df.withColumns(inline)
    for c in columns:
        if c in inline:
            continue
        lookup = codes.table.where(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("code").alias("_code")
        )
        df = (
            df.join(lookup, _class_text(F.col(c)) == F.col("_value"), "left")
            .withColumn(c, F.coalesce(F.col("_code"), unseen).cast("int"))
            .drop("_value", "_code")
        )
    return df


def fit_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every column in one pass; a zero deviation becomes 1."""
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}


def apply_scale(df: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: (F.col(c).cast("double") - F.lit(mean)) / F.lit(dev) for c, (mean, dev) in moments.items() if c in df.columns}
    )


def align(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The fitted features in fitted order: a missing one is 0, an extra one is dropped."""
    have = set(df.columns)
    return df.select(
        *[c for c in keep if c in have],
        *[F.col(c) if c in have else F.lit(0).alias(c) for c in features],
    )


@dataclass
class FittedEncoding:
    features: list[str]
    categorical: list[str]
    codes: Codes
    moments: dict[str, tuple[float, float]]


def _as_numbers(df: DataFrame, features: list[str]) -> DataFrame:
    texts = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))}
    return df.withColumns({c: to_number(F.col(c), texts[c]) for c in features if c in texts})


def fit_encoding(df: DataFrame, roles: Roles = HR, row_id: str = "row_id") -> tuple[FittedEncoding, DataFrame]:
    """Fit codes and scaling on an engineered table; returns them with the transformed table."""
    labelled = extract_label(df, roles)
    features = [c for c in feature_columns(labelled, roles, row_id) if c != "label"]
    categorical = [c for c in features if c in roles.categorical]
    codes = fit_codes(labelled, categorical)
    coded = _as_numbers(apply_codes(labelled, codes, categorical), features)
    moments = fit_scale(coded, features)
    encoding = FittedEncoding(features, categorical, codes, moments)
    return encoding, apply_scale(align(coded, features, (row_id, "label")), moments)


def apply_encoding(
    df: DataFrame, encoding: FittedEncoding | None, roles: Roles = HR, row_id: str = "row_id"
) -> DataFrame:
    """Transform another table. Map-only against the fitted parameters, so it also runs on streams."""
    if encoding is None:
        raise NotFittedError("fit the encoding before transforming")
    labelled = extract_label(df, roles)
    unfitted = [c for c in labelled.columns if c in roles.categorical and c not in encoding.categorical]
    fitted = [c for c in labelled.columns if c in encoding.categorical]
    known = labelled.withColumns({c: F.lit(UNSEEN_CODE) for c in unfitted})
    coded = apply_codes(known, encoding.codes, fitted)
    aligned = align(coded, encoding.features, (row_id, "label"))
    return apply_scale(_as_numbers(aligned, encoding.features), encoding.moments)
