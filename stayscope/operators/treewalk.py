"""Scores of tree ensembles by relational algebra: node tables joined to the rows, one level at a time.

A second way to a model's score that uses nothing but joins and sums, so a score can be checked, explained or computed where
the model itself cannot be loaded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from stayscope.operators.boosting import BoostedTrees
from stayscope.operators.treeshap import forest_nodes
from stayscope.session import LOOKUP_ROWS, materialise


def node_table(model: Model | BoostedTrees, spark: SparkSession) -> DataFrame:
    """(tree, node, feature, threshold, left, right, value): a leaf has left = -1 and pays ``value``.

    Values are log-odds for boosted trees and the trees' shares of the probability for a forest.
    """
    if isinstance(model, BoostedTrees):
        return model.node_table(spark).select("tree", "node", "feature", "threshold", "left", "right", "value")
    trees = len(model.trees)
    return forest_nodes(model, spark).select(
        "tree", F.col("id").alias("node"), "feature", "threshold", "left", "right",
        (F.when(F.col("cover") > 0, F.col("stats")[1] / F.col("cover")).otherwise(0.0) / trees).alias("value"),
    )


def with_levels(nodes: DataFrame) -> DataFrame:
    """The node table with ``level``, the steps from the root; a tree at a time. Written."""

    def number(tree: pd.DataFrame) -> pd.DataFrame:
        below = dict(zip(tree["node"], zip(tree["left"], tree["right"])))
        levels, here = {0: 0}, [0]
        while here:
            here = [child for node in here for child in below[node] if child >= 0]
            levels.update(dict.fromkeys(here, max(levels.values()) + 1))
        return tree.assign(level=tree["node"].map(levels).astype("int32"))

    schema = T.StructType([*nodes.schema.fields, T.StructField("level", T.IntegerType())])
    return materialise(nodes.groupBy("tree").applyInPandas(number, schema), "levels")


def walk(df: DataFrame, features: list[str], nodes: DataFrame, depth: int, key: str = "row_id") -> DataFrame:
    """(key, total): the sum of the values of the leaves that a row reaches. ``key`` tells the rows apart.

    Every row starts at the root of every tree; each level is an equality join with the nodes of that level, so that all
    joins together hold the model once. Only the sums per row are exchanged, combined before.
    """
    nodes = with_levels(nodes)
    x = F.array(*[F.col(f).cast("double") for f in features])
    sizes = {row["level"]: row["n"] for row in nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    trees = nodes.agg(F.max("tree")).first()[0]
    here = df.select(key, x.alias("x")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees)))).withColumn("node", F.lit(0))
    here = here.withColumn("paid", F.lit(None).cast("double"))
    for level in range(depth + 1):
        at_level = nodes.where(F.col("level") == level).select([F.col(c).alias(f"_{c}") for c in nodes.columns if c != "level"])
        at_level = F.broadcast(at_level) if sizes.get(level, 0) <= LOOKUP_ROWS else at_level
        here = here.join(at_level, (F.col("tree") == F.col("_tree")) & (F.col("node") == F.col("_node")), "left")
        below = F.when(F.col("x")[F.col("_feature")] <= F.col("_threshold"), F.col("_left")).otherwise(F.col("_right"))
        # a row that is paid has no node any more
        here = here.select(
            key, "x", "tree", F.when(F.col("_left") >= 0, below).alias("node"), F.when(F.col("_left") < 0, F.col("_value")).otherwise(F.col("paid")).alias("paid")
        )
    return here.groupBy(key).agg(F.sum("paid").alias("total"))


def walked_scores(df: DataFrame, features: list[str], model: Model | BoostedTrees, key: str = "row_id") -> DataFrame:
    """(key, walked): the probability of class 1 by the node tables."""
    if isinstance(model, BoostedTrees):
        depth, margin = model.depth, F.col("total") + F.lit(model.base)
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    else:
        depth, score = max(tree.depth for tree in model.trees), F.col("total")
    return walk(df, features, node_table(model, df.sparkSession), depth, key).select(key, score.alias("walked"))
