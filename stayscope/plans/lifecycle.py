"""The four steps of a study: analyse a raw table, train, predict with explanations, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from stayscope.operators.explain import attribution, narrative_text
from stayscope.operators.models import Settings, Trained, feature_importance, score, train_all
from stayscope.operators.scoring import Scorer, risk_band
from stayscope.operators.split import stratified_split
from stayscope.plans.preparation import Preparation, Prepared
from stayscope.session import materialise
from stayscope.sources.tables import write_report


@dataclass
class Study:
    """A prepared table with the models trained on it."""

    preparation: Preparation
    prepared: Prepared
    train: DataFrame
    trained: Trained

    @property
    def scorer(self) -> Scorer:
        return Scorer(self.preparation.encoding, self.trained.best, self.preparation.medians)


def run_study(raw: DataFrame, settings: Settings = Settings(), **options) -> Study:
    """Prepare the table, split it and compare the models. ``options`` go to the preparation."""
    preparation = Preparation(**options)
    prepared = preparation.fit_transform(raw)
    features = materialise(prepared.features, "features")
    train, test = stratified_split(features)
    trained = train_all(train, test, preparation.feature_names, settings)
    return Study(preparation, Prepared(features, prepared.cleaned), train, trained)


def predict_and_explain(study: Study, records: DataFrame, key: str = "row_id") -> DataFrame:
    """Score, risk band, contributions and text for every record.

    Scores travel beside the features into the attribution: nothing is joined, so records that
    share a key, or have none, keep their own rows.
    """
    scorer = study.scorer
    names = scorer.encoding.features
    scored = score(scorer.model, scorer.features(records, key), names).withColumn("risk", risk_band(F.col("score")))
    kept = ("score", "prediction", "risk")
    explained = attribution(scored, scorer.model, names, study.train, key, keep=kept)
    return explained.withColumn("explanation", narrative_text())


def write_study_report(study: Study, folder: str, generated_at: str | None = None) -> dict[str, str]:
    """All report sheets of a study, below ``folder``."""
    spark = study.train.sparkSession
    importance = feature_importance(study.trained.best, study.preparation.feature_names, spark)
    return write_report(study.prepared.cleaned, folder, study.trained.metrics, importance, generated_at)
