"""Schema repair and profiling of a raw table.

``profile_table`` reads the table once and returns one small record per column. The detection
rules then work on those records; only columns the records cannot decide are read again.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from stayscope.functions.expr import about_distinct, has_currency_mark, is_number, to_number
from stayscope.schema import HR, POSITIVE_TEXTS, Roles, column_key, looks_like_identifier

CURRENCY_SHARE = 0.3
CURRENCY_SAMPLE = 50
MISSING_WARNING_PCT = 20.0
MIN_ROWS = 10
HEAD_ROWS = 20_000
MIN_COLUMNS = 2


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    dtype: str
    rows: int
    nulls: int
    about_distinct: int
    low: str | None
    high: str | None
    currency_hits: int
    numeric_hits: int

    @property
    def filled(self) -> int:
        return self.rows - self.nulls

    @property
    def is_text(self) -> bool:
        return self.dtype == "string"

    @property
    def is_number(self) -> bool:
        return self.dtype in ("int", "bigint", "double")

    @property
    def is_constant(self) -> bool:
        """At most one distinct value, with null counted as a value."""
        return self.nulls == self.rows or (self.nulls == 0 and self.low == self.high)

    @property
    def is_currency(self) -> bool:
        return self.is_text and self.currency_hits > CURRENCY_SHARE * self.filled

    @property
    def missing_pct(self) -> float:
        return self.nulls / self.rows * 100 if self.rows else 0.0


def quoted(name: str) -> str:
    """A column name as a column expression reads it back unchanged."""
    return "`" + name.replace("`", "``") + "`"


def _missing(column, dtype):
    return column.isNull() | F.isnan(column) if isinstance(dtype, (T.DoubleType, T.FloatType)) else column.isNull()


def profile_table(df: DataFrame, columns: list[str] | None = None) -> dict[str, ColumnProfile]:
    """One aggregation over all columns; its buffers have a fixed size."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    marks = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        c = F.col(quoted(field.name))
        c = F.when(~_missing(c, field.dataType), c)
        text = c.cast("string")
        is_text = isinstance(field.dataType, T.StringType)
        marks += [
            F.count(c).alias(f"filled_{i}"),
            about_distinct(c).alias(f"distinct_{i}"),
            F.min(c).cast("string").alias(f"low_{i}"),
            F.max(c).cast("string").alias(f"high_{i}"),
            (F.count_if(has_currency_mark(text)) if is_text else F.lit(0)).alias(f"currency_{i}"),
            (F.count(to_number(c, field.dataType)) if is_text else F.count(c)).alias(f"numeric_{i}"),
        ]
    row = df.agg(*marks).first()
    return {
        field.name: ColumnProfile(
            field.name, field.dataType.simpleString(), row["rows"], row["rows"] - row[f"filled_{i}"],
            row[f"distinct_{i}"], row[f"low_{i}"], row[f"high_{i}"], row[f"currency_{i}"], row[f"numeric_{i}"],
        )
        for i, field in enumerate(fields)
    }


# Renaming -----------------------------------------------------------------------------------


def spelling_map(columns: list[str], roles: Roles = HR) -> dict[str, str]:
    """``{column: canonical name}`` for known spellings whose canonical column is absent.

    When several columns spell the same canonical name the first wins and the rest keep theirs.
    """
    mapping: dict[str, str] = {}
    for column in columns:
        name = roles.canonical_by_key.get(column_key(column))
        if name is None or name in columns:
            continue
        if name in mapping.values():
            warnings.warn(f"{column!r} also spells {name!r}; it keeps its own name", stacklevel=2)
            continue
        mapping[column] = name
    return mapping


def plain_names(columns: list[str], taken: set[str] = frozenset()) -> dict[str, str]:
    """``{column: new name}`` for names with a dot or a backtick, which column expressions misread.

    The marks become underscores; a name that is in use already gets a number.
    """
    used = {c.lower() for c in columns} | {c.lower() for c in taken}
    mapping: dict[str, str] = {}
    for column in columns:
        if "." not in column and "`" not in column:
            continue
        base = name = column.replace(".", "_").replace("`", "_")
        number = 2
        while name.lower() in used:
            name, number = f"{base}_{number}", number + 1
        used.add(name.lower())
        mapping[column] = name
    return mapping


def rename_spellings(df: DataFrame, roles: Roles = HR) -> DataFrame:
    return df.withColumnsRenamed(spelling_map(df.columns, roles))


# Label --------------------------------------------------------------------------------------


def label_by_name(columns: list[str], roles: Roles = HR) -> str | None:
    return next((c for c in columns if column_key(c) in roles.spellings[roles.label]), None)


def two_valued_columns(df: DataFrame, profile: dict[str, ColumnProfile]) -> list[str]:
    """Columns with one or two distinct lower-cased values, one of which means "left".

    A column qualifies when no value differs from both its least and its greatest one, which needs
    no distinct count and no bound on the spellings.
    """
    narrow = [p.name for p in profile.values() if p.filled]
    if not narrow:
        return []
    lowered = df.select(*[F.lower(F.col(quoted(c)).cast("string")).alias(c) for c in narrow])
    ends = lowered.agg(
        *[F.min(quoted(c)).alias(f"lo_{i}") for i, c in enumerate(narrow)],
        *[F.max(quoted(c)).alias(f"hi_{i}") for i, c in enumerate(narrow)],
    ).first()
    hopeful = [
        (c, ends[f"lo_{i}"], ends[f"hi_{i}"])
        for i, c in enumerate(narrow)
        if {ends[f"lo_{i}"], ends[f"hi_{i}"]} & set(POSITIVE_TEXTS)
    ]
    if not hopeful:
        return []
    others = lowered.agg(
        *[F.count_if(~F.col(quoted(c)).isin(lo, hi)).alias(f"n_{i}") for i, (c, lo, hi) in enumerate(hopeful)]
    ).first()
    return [c for i, (c, _, _) in enumerate(hopeful) if others[f"n_{i}"] == 0]


def find_label(df: DataFrame, profile: dict[str, ColumnProfile] | None = None, roles: Roles = HR) -> str | None:
    """The first column named like the label, else the first two-valued yes/no-like column."""
    named = label_by_name(df.columns, roles)
    if named is not None:
        return named
    candidates = two_valued_columns(df, profile or profile_table(df))
    if candidates:
        warnings.warn(f"label column {candidates[0]!r} was chosen by its values", stacklevel=2)
        return candidates[0]
    return None


# Identifier, constant and row-index columns ---------------------------------------------------


def repeating(df: DataFrame, names: list[str]) -> set[str]:
    """The columns among ``names`` in which a value occurs twice, in one exchange whatever their number.

    Values are compared by 128 bits of hash, combined in the tasks.
    """
    cells = [
        F.struct(F.lit(i).alias("column"), F.xxhash64(F.col(quoted(c))).alias("one"), F.xxhash64(F.lit(i), F.col(quoted(c))).alias("two"))
        for i, c in enumerate(names)
    ]
    if not cells:
        return set()
    counted = df.select(F.explode(F.array(*cells)).alias("cell")).groupBy("cell.column", "cell.one", "cell.two").count()
    return {names[row["column"]] for row in counted.where("count > 1").select("column").distinct().collect()}


def all_unique(df: DataFrame, names: list[str], head: int = HEAD_ROWS) -> list[str]:
    """The columns among ``names`` in which no value repeats. A bounded look at some rows rules out most others first."""
    early = repeating(df.limit(head), names)
    left = [c for c in names if c not in early]
    late = repeating(df, left)
    return [c for c in left if c not in late]


def first_unique(df: DataFrame, names: list[str], head: int = HEAD_ROWS) -> str | None:
    """The first column among ``names`` in which no value repeats; later ones are not looked at as a whole."""
    early = repeating(df.limit(head), names)
    return next((c for c in names if c not in early and not repeating(df, [c])), None)


def droppable_columns(
    df: DataFrame,
    profile: dict[str, ColumnProfile] | None = None,
    roles: Roles = HR,
    strict_reference: bool = False,
    protect: frozenset[str] | None = None,
) -> dict[str, str]:
    """``{column: reason}`` in priority order: identifier names, constants, row indexes.

    A measure that happens to be unique in every row (a salary, say) would count as a row index.
    Canonical columns are protected from that unless ``strict_reference`` is set.
    """
    profile = profile or profile_table(df)
    guarded = frozenset() if strict_reference else (roles.known if protect is None else protect)
    named, constant, maybe = [], [], []
    for p in profile.values():
        if p.name == roles.label:
            continue
        if looks_like_identifier(p.name):
            named.append(p.name)
        elif p.is_constant:
            constant.append(p.name)
        elif p.is_number and p.nulls == 0 and p.name not in guarded and p.about_distinct >= 0.8 * p.rows:
            maybe.append(p.name)
    reasons = dict.fromkeys(named, "identifier") | dict.fromkeys(constant, "constant")
    return reasons | dict.fromkeys(all_unique(df, maybe), "row index")


def best_identifier(df: DataFrame, profile: dict[str, ColumnProfile] | None = None) -> str | None:
    """The column to address people by: the first identifier name, else the first unique number."""
    named = next((c for c in df.columns if looks_like_identifier(c)), None)
    if named is not None:
        return named
    profile = profile or profile_table(df)
    likely = [p.name for p in profile.values() if p.is_number and p.nulls == 0 and p.about_distinct >= 0.8 * p.rows]
    return first_unique(df, likely)


def currency_by_sample(
    df: DataFrame, key: str, columns: list[str] | None = None, rows: int = CURRENCY_SAMPLE
) -> dict[str, bool]:
    """Currency detection on the first ``rows`` non-null values by key, as a file's head would show.

    A column costs one bounded top-k; the values looked at per column are at most ``rows``.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    found = {}
    for c in texts if columns is None else columns:
        head = df.select(key, c).where(F.col(c).isNotNull()).orderBy(key).limit(rows)
        hits, seen = head.agg(F.count_if(has_currency_mark(F.col(c))), F.count(c)).first()
        found[c] = hits > CURRENCY_SHARE * seen
    return found


# Validation and summary ----------------------------------------------------------------------


def validate(
    df: DataFrame, profile: dict[str, ColumnProfile] | None = None, roles: Roles = HR
) -> tuple[bool, list[str]]:
    """``(ok, issues)``: enough rows and columns, a label, no entirely empty column."""
    profile = profile or profile_table(df)
    rows = next(iter(profile.values())).rows if profile else 0
    issues = []
    if rows < MIN_ROWS:
        issues.append(f"{rows} rows; at least {MIN_ROWS} are needed")
    if rows == 0 or len(df.columns) < MIN_COLUMNS:
        issues.append(f"{len(df.columns)} columns; at least {MIN_COLUMNS} and some rows are needed")
    if find_label(df, profile, roles) is None:
        issues.append(f"no label column found; name one {roles.label!r}")
    empty = [p.name for p in profile.values() if rows and p.nulls == rows]
    if empty:
        issues.append(f"columns without any value: {empty}")
    return not issues, issues


def summarise(df: DataFrame, profile: dict[str, ColumnProfile] | None = None, roles: Roles = HR) -> DataFrame:
    """One row per column: type, share missing, identifier / currency / label marks, warning.

    Warns if no column can serve as the label.
    """
    profile = profile or profile_table(df)
    label = find_label(df, profile, roles)
    if label is None:
        warnings.warn(f"no label column found; name one {roles.label!r} or give one yes / no values", stacklevel=2)
    spark = df.sparkSession
    rows = [
        (p.name, p.dtype, p.rows, p.nulls, looks_like_identifier(p.name), p.is_currency, p.name == label)
        for p in profile.values()
    ]
    schema = "column string, type string, rows bigint, nulls bigint, is_id boolean, is_currency boolean, is_label boolean"
    pct = F.coalesce(F.try_divide(F.col("nulls").cast("double"), F.col("rows").cast("double")) * 100, F.lit(0.0))
    return (
        spark.createDataFrame(rows, schema)
        .withColumn("missing_pct", F.bround(pct, 2))
        .withColumn("warning", F.when(F.col("missing_pct") > MISSING_WARNING_PCT, F.lit("many values missing")))
    )
