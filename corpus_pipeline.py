"""The corpus pipeline: quality, near copies, test passages, secrets, tokens.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir), where ``docs`` is what the stage before
kept, and returns a DataFrame that is written as Parquet and read again. All but the last return the columns of
their ``docs``. Null and empty texts, null ids, repeated rows and extra columns pass as the operators say; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayscope.llm import bpe, decontaminate, quality, secrets, simhash
from stayscope.llm.common import fold, small_batches, table
from stayscope.session import materialise


def _length_column(docs: DataFrame) -> str | None:
    return "n_chars" if "n_chars" in docs.columns else None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of the rows outside fold 0 of 5."""
    model = quality.train(docs.filter(fold(F.col("doc_id"), 5) != 0), table(spark, sf_dir, "labels"))
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    text = inner[docs.columns.index("text")]
    scored = quality.classify(docs.toDF(*inner), model, text=text, keep=tuple(inner))
    return scored.filter("predicted = 1").select(*inner).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at two bits or fewer: that with the smallest id."""
    small_batches(spark)
    return simhash.one_per_group(docs, words=3, distance=2)


def cut_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items; those that are mostly test passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), length_column=_length_column(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    small_batches(spark)
    return secrets.redact(docs, length_column=_length_column(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids, and the digests of the ids and of the bytes that they decode to."""
    small_batches(spark)
    return bpe.round_trip(docs, bpe.public_vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", cut_test_passages),
    ("secret scans", redact_secrets),
    ("byte-level bpe", encode_tokens),
]
# A trained classifier, XXH64 fingerprints and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
