"""Scoring records: field defaults, range checks, risk bands and the fitted scorer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, functions as F

from stayscope.operators.encode import FittedEncoding, apply_encoding
from stayscope.operators.features import engineer
from stayscope.operators.models import score
from stayscope.schema import HR, SCORING_BOUNDS, SCORING_CHOICES, SCORING_DEFAULTS, Roles

HIGH_RISK, MEDIUM_RISK = 0.6, 0.3


def risk_band(probability: Column) -> Column:
    return (
        F.when(probability > HIGH_RISK, F.lit("HIGH"))
        .when(probability > MEDIUM_RISK, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def gauge_band(probability: Column) -> Column:
    """The gauge's colour zones, which put exactly 0.3 and 0.6 one zone higher."""
    return (
        F.when(probability < MEDIUM_RISK, F.lit("LOW"))
        .when(probability < HIGH_RISK, F.lit("MEDIUM"))
        .otherwise(F.lit("HIGH"))
    )


def fill_defaults(df: DataFrame, defaults: dict[str, object] = SCORING_DEFAULTS) -> DataFrame:
    """Give absent columns and null fields their scoring default."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(value).cast(types[c])) if c in types else F.lit(value)
            for c, value in defaults.items()
        }
    )


def out_of_bounds(df: DataFrame) -> DataFrame:
    """Add ``invalid_fields``: the fields outside their accepted range or choices."""
    checks = []
    for c in df.columns:
        if c in SCORING_BOUNDS:
            low, high = SCORING_BOUNDS[c]
            checks.append(F.when(~F.col(c).between(low, high), F.lit(c)))
        elif c in SCORING_CHOICES:
            checks.append(F.when(~F.col(c).isin(*SCORING_CHOICES[c]), F.lit(c)))
    flags = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn("invalid_fields", flags)


@dataclass
class Scorer:
    """Scores engineered records with fitted parameters; no shuffle, so it also serves streams."""

    encoding: FittedEncoding
    model: Model
    level_medians: DataFrame | None = None
    roles: Roles = HR
    single_row_mode: str = "fitted"

    def features(self, records: DataFrame, key: str = "row_id") -> DataFrame:
        ready = engineer(fill_defaults(records), self.level_medians, self.single_row_mode)
        return apply_encoding(ready, self.encoding, self.roles, key)

    def __call__(self, records: DataFrame, key: str = "row_id") -> DataFrame:
        scored = score(self.model, self.features(records, key), self.encoding.features)
        return scored.select(key, "score", "prediction").withColumn("risk", risk_band(F.col("score")))
