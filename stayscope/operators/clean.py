"""Cleaning: fitted once on a table, then applied as one projection.

``fit_clean`` reads the table for the facts it needs (profile, medians, modes, clip bounds) and
returns them as a small record; ``apply_clean`` is map-only apart from the duplicate removal.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from stayscope.functions.expr import about_distinct, means_left, money_to_number, to_number
from stayscope.functions.ranges import SINGLE_RANGE_ROWS, column_quantiles
from stayscope.operators.profile import (
    ColumnProfile, currency_by_sample, droppable_columns, find_label, plain_names, profile_table, spelling_map,
)
from stayscope.schema import HR, Roles
from stayscope.session import materialise

KEEP_EXTRA_SHARE = 0.5
REPEATED_DIGESTS = 1_000_000
CLIP_PROBS = (0.01, 0.99)


@dataclass
class CleanParams:
    """Everything cleaning learned from a table. Sizes follow the number of columns, not rows."""

    roles: Roles
    renames: dict[str, str]
    dropped: dict[str, str]
    row_id: str | None
    currency: list[str]
    label_source: str
    extras_kept: list[str] = field(default_factory=list)
    extras_dropped: list[str] = field(default_factory=list)
    medians: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, object] = field(default_factory=dict)
    clips: dict[str, tuple[float, float]] = field(default_factory=dict)
    missing: dict[str, int] = field(default_factory=dict)


# Steps ----------------------------------------------------------------------------------------


def clean_currency(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: money_to_number(F.col(c)) for c in columns})


def standardise_label(df: DataFrame, source: str, roles: Roles = HR) -> DataFrame:
    """Rename the label column and map it to the positive / negative text, null included."""
    value = F.when(means_left(F.col(source)), F.lit(roles.positive)).otherwise(F.lit(roles.negative))
    renamed = df.withColumn(source, value)
    return renamed if source == roles.label else renamed.drop(roles.label).withColumnRenamed(source, roles.label)


def row_digest(df: DataFrame) -> Column:
    """A text key made from all columns of a row: equal for equal rows only, whatever the partitioning.

    Fields keep their name and null stays apart from the empty text. A zero has one sign.
    """
    parts = []
    for f in df.schema.fields:
        value = F.col(f.name)
        if isinstance(f.dataType, T.BinaryType):
            value = F.hex(value)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(value == 0, F.lit("0")).otherwise(value.cast("string"))
        parts.append(value.cast("string").alias(f.name))
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def is_row_key(prepared: DataFrame, key: str = "row_id") -> bool:
    """Whether every row has a key and no two different rows share one.

    Rows that repeat as a whole may share a key: duplicate removal leaves one of them. A key value
    reaches its reducer as three numbers per map task however many rows carry it.
    """
    body = F.xxhash64(*[F.col(c) for c in prepared.columns if c != key])
    spread = prepared.select(F.col(key), body.alias("_body")).groupBy(key).agg(
        F.min("_body").alias("_low"), F.max("_body").alias("_high")
    )
    return spread.where(F.col(key).isNull() | (F.col("_low") != F.col("_high"))).limit(1).count() == 0


def drop_duplicate_rows(df: DataFrame, row_id: str | None = "row_id", most: int = REPEATED_DIGESTS) -> DataFrame:
    """Keep one row per combination of attributes, with the least key.

    Digests of 128 bits are exchanged instead of rows: they are counted, and only rows whose digest repeats are
    grouped; the others stay where they are. The table of repeated digests is broadcast as long as it has at most ``most`` rows of
    16 bytes. Beyond that, and on streams, all rows are grouped. Either way the key is a min aggregate, so a
    combination that fills a third of the table reaches its reducer as one row per map task.
    """
    if row_id is None or row_id not in df.columns:
        return df.dropDuplicates()
    attributes = [c for c in df.columns if c != row_id]
    if df.isStreaming or not attributes:
        return _least_key(df, attributes, row_id)
    marked = df.withColumns({"_one": F.xxhash64(*attributes), "_two": F.xxhash64(F.lit(1), *attributes)})
    repeated = materialise(marked.groupBy("_one", "_two").count().where("count > 1").select("_one", "_two"), "repeated")
    digests = repeated.count()
    if digests == 0:
        return df
    if digests > most:
        return _least_key(df, attributes, row_id)
    alone = marked.join(F.broadcast(repeated), ["_one", "_two"], "left_anti").select(*df.columns)
    copied = marked.join(F.broadcast(repeated), ["_one", "_two"], "left_semi").select(*df.columns)
    return alone.unionByName(_least_key(copied, attributes, row_id))


def _least_key(df: DataFrame, attributes: list[str], row_id: str) -> DataFrame:
    return df.groupBy(*attributes).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """The most frequent value of each column, the least one on a tie.

    Counting (column, value) pairs first keeps every buffer small however many values there are.
    """
    if not columns:
        return {}
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        ).alias("pair")
    ).select("pair.*").where("value is not null")
    counted = pairs.groupBy("column", "value").count()
    best = counted.groupBy("column").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value"))
    return {row["column"]: row["value"] for row in best.collect()}


def table_facts(df: DataFrame, roles: Roles = HR, keep: tuple[str, ...] = ()) -> dict[str, dict[str, int]]:
    """Rows, usable values and approximate distinct values of every column, in one pass.

    A value of a category or the label is usable when it is not null, any other when it is a number.
    """
    fields = [f for f in df.schema.fields if f.name not in keep]
    marks = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        as_is = f.name in roles.categorical or f.name == roles.label
        value = F.col(f.name) if as_is else to_number(F.col(f.name), f.dataType)
        marks += [F.count(value).alias(f"n_{i}"), about_distinct(value).alias(f"d_{i}")]
    row = df.agg(*marks).first()
    return {
        f.name: {"rows": row["rows"], "usable": row[f"n_{i}"], "distinct": row[f"d_{i}"]}
        for i, f in enumerate(fields)
    }


def split_extras(
    facts: dict[str, dict[str, int]], roles: Roles = HR
) -> tuple[list[str], list[str]]:
    """Columns outside the schema: those at least half numeric, and the rest."""
    extras = [c for c in facts if c not in roles.known]
    kept = [c for c in extras if facts[c]["rows"] and facts[c]["usable"] >= KEEP_EXTRA_SHARE * facts[c]["rows"]]
    return kept, [c for c in extras if c not in kept]


def prepare(df: DataFrame, params: CleanParams) -> DataFrame:
    """Everything before duplicate removal: renames, drops, currency, label. Map-only.

    A table without a key column gets the digest of the row as it stands here as its ``row_id``.
    """
    out = df.withColumnsRenamed(params.renames)
    key = params.row_id
    drops = [c for c in params.dropped if c in out.columns and c != key]
    out = out.drop(*drops)
    if key is not None and key != "row_id":
        out = out.withColumnRenamed(key, "row_id")
    out = clean_currency(out, [c for c in params.currency if c in out.columns])
    doubles = [f.name for f in out.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
    if params.label_source in out.columns:
        out = standardise_label(out, params.label_source, params.roles)
    return out if key is not None else out.withColumn("row_id", row_digest(out))


def coerce_numbers(df: DataFrame, params: CleanParams) -> DataFrame:
    """Coerce the columns that must be numeric and drop the extras that are not."""
    roles = params.roles
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = [c for c in df.columns if c in roles.numeric or c in roles.ordinal or c in params.extras_kept]
    return df.drop(*params.extras_dropped).withColumns({c: to_number(F.col(c), types[c]) for c in wanted})


def impute(df: DataFrame, params: CleanParams) -> DataFrame:
    """Impute: medians for numbers, modes for categories. Ordinals become whole numbers."""
    roles = params.roles
    new: dict[str, Column] = {}
    for field_ in df.schema.fields:
        c = field_.name
        if c in roles.ordinal:
            new[c] = F.coalesce(F.col(c), F.lit(params.medians.get(c)).cast("double"), F.lit(1.0)).cast("int")
        elif c in roles.numeric:
            new[c] = F.coalesce(F.col(c), F.lit(params.medians.get(c)).cast("double"), F.lit(0.0))
        elif c in params.extras_kept:
            new[c] = F.coalesce(F.col(c), F.lit(params.medians.get(c)).cast("double"))
        elif c in roles.categorical and params.modes.get(c) is not None:
            new[c] = F.coalesce(F.col(c), F.lit(params.modes[c]).cast(field_.dataType))
    return df.withColumns(new)


def winsorise(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip each column the table has to its bounds; nulls stay null."""
    return df.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c).cast("double"))))
            for c, (lo, hi) in bounds.items()
            if c in df.columns
        }
    )


# Fit and apply ----------------------------------------------------------------------------------


def plan_clean(
    df: DataFrame,
    row_id: str | None = None,
    roles: Roles = HR,
    strict_reference: bool = False,
    profile: dict[str, ColumnProfile] | None = None,
) -> CleanParams:
    """Decide renames, drops, currency columns, the label and the row key from one profile of the raw table.

    The key is ``row_id``, or else the first identifier or row index, that is verified to tell rows
    apart. Where none does, ``CleanParams.row_id`` is None and rows are known by their digest.
    """
    renames = spelling_map(df.columns, roles)
    renames |= plain_names([c for c in df.columns if c not in renames], set(renames.values()))
    named = df.withColumnsRenamed(renames)
    if profile is None:
        profile = profile_table(named)
    else:
        profile = {
            renames.get(c, c): ColumnProfile(**{**vars(p), "name": renames.get(c, c)}) for c, p in profile.items()
        }
    dropped = droppable_columns(named, profile, roles, strict_reference)
    if row_id is None:
        keys = [c for c, why in dropped.items() if why in ("identifier", "row index") and profile[c].about_distinct > 1]
    else:
        keys = [renames.get(row_id, row_id)]
    left = {c: p for c, p in profile.items() if c not in dropped and c not in keys}
    key = next(iter(keys), None)
    if strict_reference and key is not None:
        texts = [c for c, p in left.items() if p.is_text]
        currency = [c for c, hit in currency_by_sample(named, key, texts).items() if hit]
    else:
        currency = [c for c, p in left.items() if p.is_currency]
    label = find_label(named.select(*left), left, roles)
    if label is None:
        raise ValueError(f"no label column found; name one {roles.label!r}")
    params = CleanParams(roles, renames, dropped, key, currency, label)
    for key in keys:
        params.row_id = key
        if is_row_key(prepare(df, params)):
            return params
        dropped.setdefault(key, "identifier")
        warnings.warn(f"{key!r} does not tell rows apart; it is not used as their key", stacklevel=2)
    params.row_id = None
    return params


def fit_clean(
    df: DataFrame,
    row_id: str | None = None,
    roles: Roles = HR,
    strict_reference: bool = False,
    rows_per_range: int = SINGLE_RANGE_ROWS,
    reuse: bool = True,
    profile: dict[str, ColumnProfile] | None = None,
    plan: CleanParams | None = None,
    only: DataFrame | None = None,
) -> tuple[CleanParams, DataFrame]:
    """Learn the cleaning parameters. Returns them with the cleaned table.

    ``plan`` keeps the renames, drops and label of an earlier fit and learns only the statistics.
    ``only``, a table of ``row_id``, limits the fit to those rows.

    With ``reuse`` the duplicate-free table is written to the shared folder once, so the fitting
    passes and the result read columns of files instead of repeating the shuffle.
    """
    params = replace(plan) if plan else plan_clean(df, row_id, roles, strict_reference, profile)
    prepared = prepare(df, params)
    if only is not None:
        prepared = prepared.join(only, "row_id", "left_semi")
    unique = drop_duplicate_rows(prepared, "row_id")
    if reuse:
        unique = materialise(unique, "unique")
    key = ("row_id",) if "row_id" in unique.columns else ()
    facts = table_facts(unique, roles, key)
    params.extras_kept, params.extras_dropped = split_extras(facts, roles)
    numbers = coerce_numbers(unique, params)
    params.missing = {
        c: f["rows"] - f["usable"] for c, f in facts.items() if c in numbers.columns and f["usable"] < f["rows"]
    }
    # for every column: rows to come may have gaps where the fitted ones have none
    measured = [c for c in numbers.columns if c in roles.numeric or c in roles.ordinal or c in params.extras_kept]
    found = column_quantiles(numbers, measured, [0.5], rows_per_range)
    params.medians = {c: (q[0] if q else None) for c, q in found.items()}
    params.modes = modes(numbers, [c for c in numbers.columns if c in roles.categorical])
    filled = impute(numbers, params)
    clip_columns = [c for c in filled.columns if c in roles.numeric]
    bounds = column_quantiles(filled, clip_columns, CLIP_PROBS, rows_per_range)
    params.clips = {c: (q[0], q[1]) for c, q in bounds.items() if q}
    return params, winsorise(filled, params.clips)


def apply_clean(df: DataFrame, params: CleanParams, deduplicate: bool = True) -> DataFrame:
    """Clean another table with parameters fitted earlier; map-only without ``deduplicate``."""
    prepared = prepare(df, params)
    if deduplicate:
        prepared = drop_duplicate_rows(prepared, "row_id")
    return winsorise(impute(coerce_numbers(prepared, params), params), params.clips)


def clean(df: DataFrame, row_id: str | None = None, roles: Roles = HR, **options) -> DataFrame:
    return fit_clean(df, row_id, roles, **options)[1]


def cleaning_report(raw: DataFrame, cleaned: DataFrame, params: CleanParams) -> DataFrame:
    """Audit table ``(step, detail, n)`` of what cleaning did."""
    n_raw, n_clean = raw.count(), cleaned.count()
    before = sum(params.missing.values())
    after = cleaned.agg(
        sum((F.count_if(F.col(c).isNull()) for c in cleaned.columns), F.lit(0)).alias("n")
    ).first()["n"]
    rows = [("original rows", "", n_raw), ("original columns", "", len(raw.columns))]
    rows += [("renamed", f"{old} -> {new}", 1) for old, new in params.renames.items()]
    rows += [("dropped", f"{c}: {why}", 1) for c, why in params.dropped.items()]
    rows += [("currency", c, 1) for c in params.currency]
    rows.append(("row key", params.row_id or "digest of the row", 1))
    if params.label_source != params.roles.label:
        rows.append(("label renamed", params.label_source, 1))
    rows.append(("duplicate rows removed", "", n_raw - n_clean))
    rows += [("extra kept as number", c, 1) for c in params.extras_kept]
    rows += [("warning: extra dropped", c, 1) for c in params.extras_dropped]
    rows += [("missing before", "", before), ("missing after", "", int(after))]
    rows += [("clipped", f"{c} to [{lo}, {hi}]", 1) for c, (lo, hi) in params.clips.items()]
    rows += [("final rows", "", n_clean), ("final columns", "", len(cleaned.columns))]
    return raw.sparkSession.createDataFrame(rows, "step string, detail string, n bigint")
