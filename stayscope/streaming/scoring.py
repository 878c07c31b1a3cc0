"""Scoring records as they arrive.

The fitted scorer is map-only with static parameters, so the batch code serves a stream as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from stayscope.operators.scoring import Scorer


def score_stream(
    records: DataFrame, scorer: Scorer, checkpoint: str, key: str = "row_id"
) -> DataStreamWriter:
    """A writer of scored records in append mode; the caller picks sink and trigger.

    ``checkpoint`` must be on storage all executors share; with it a restarted query goes on
    where it stopped.
    """
    return scorer(records, key).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
