"""The composed preparation: validate, clean, engineer, encode and scale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from stayscope.functions.ranges import SINGLE_RANGE_ROWS
from stayscope.operators.clean import CleanParams, apply_clean, fit_clean
from stayscope.operators.encode import FittedEncoding, NotFittedError, apply_encoding, fit_encoding
from stayscope.operators.features import engineer, level_medians
from stayscope.operators.profile import profile_table, validate
from stayscope.operators.split import stratified_split
from stayscope.schema import HR, Roles
from stayscope.session import lookup_table


@dataclass
class Prepared:
    features: DataFrame  # row_id, label, scaled features
    cleaned: DataFrame  # readable rows before feature engineering


class Preparation:
    """Fit on one raw table, then transform others with the fitted parameters.

    With ``fit_on="all"`` (the default) bounds, medians and moments come from the whole table;
    ``fit_on="train"`` takes them from the training part of the same split the models use.
    """

    def __init__(
        self, row_id: str | None = None, roles: Roles = HR, strict_reference: bool = False,
        rows_per_range: int = SINGLE_RANGE_ROWS, reuse: bool = True, fit_on: str = "all",
    ):
        if fit_on not in ("all", "train"):
            raise ValueError(f"fit_on must be 'all' or 'train', not {fit_on!r}")
        self.row_id, self.roles, self.strict_reference = row_id, roles, strict_reference
        self.rows_per_range, self.reuse, self.fit_on = rows_per_range, reuse, fit_on
        self.clean_params: CleanParams | None = None
        self.medians: DataFrame | None = None
        self.encoding: FittedEncoding | None = None

    @property
    def feature_names(self) -> list[str]:
        return self.encoding.features if self.encoding else []

    @property
    def identifier(self) -> str | None:
        return self.clean_params.row_id if self.clean_params else None

    def fit_transform(self, raw: DataFrame) -> Prepared:
        profile = profile_table(raw)
        ok, issues = validate(raw, profile, self.roles)
        if not ok:
            raise ValueError("the table cannot be prepared: " + "; ".join(issues))
        params, cleaned = fit_clean(
            raw, self.row_id, self.roles, self.strict_reference, self.rows_per_range, self.reuse, profile
        )
        if self.fit_on == "train":
            labelled = cleaned.withColumn("_y", F.col(self.roles.label))
            kept = stratified_split(labelled, "_y")[0].select("row_id")
            params, _ = fit_clean(
                raw, roles=self.roles, rows_per_range=self.rows_per_range, reuse=self.reuse, plan=params, only=kept
            )
            cleaned = apply_clean(raw, params)
            basis = cleaned.join(kept, "row_id", "left_semi")
        else:
            basis = cleaned
        self.clean_params = params
        if {"MonthlyIncome", "JobLevel"} <= set(cleaned.columns):
            self.medians = lookup_table(level_medians(basis, rows_per_range=self.rows_per_range))
        self.encoding, features = fit_encoding(engineer(basis, self.medians), self.roles)
        if self.fit_on == "train":
            features = apply_encoding(engineer(cleaned, self.medians), self.encoding, self.roles)
        return Prepared(features, cleaned)

    def transform(self, raw: DataFrame, deduplicate: bool = True) -> Prepared:
        """Prepare another table; never drops a column for being constant in it."""
        if self.clean_params is None:
            raise NotFittedError("fit the preparation before transforming")
        cleaned = apply_clean(raw, self.clean_params, deduplicate)
        return Prepared(
            apply_encoding(engineer(cleaned, self.medians), self.encoding, self.roles), cleaned
        )
