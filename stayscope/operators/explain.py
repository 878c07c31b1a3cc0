"""Attributions of scores to features and the tables and texts made from them.

A row's attributions travel as one array of (feature, display_name, value, shap) structs next to
its key. Ranking the handful of features of a row is then an in-row array sort: top-k reports and
narratives need no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from stayscope.functions.expr import fixed_text, nearest_decimal
from stayscope.functions.hashing import digest
from stayscope.operators.coalition import Scores, coalition_scores
from stayscope.operators.treeshap import TreeTables, tree_tables

BACKGROUND_ROWS = 100
#: Rows whose coalitions are scored at a time.
COALITION_ROWS = 1024
#: Values whose tree attributions are computed at a time: what is computed once for many rows is then shared by enough of them.
ATTRIBUTED_CELLS = 1 << 21
FORCEFUL, WATCHFUL = 0.7, 0.4
RISK, PROTECTIVE = "risk", "protective"


def display_name(feature: str, overrides: dict[str, str] | None = None) -> str:
    return (overrides or {}).get(feature, feature.replace("_", " ").title())


def contribution_array(
    values: list[Column], shaps: list[Column], features: list[str], overrides: dict[str, str] | None = None
) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(display_name(f, overrides)).alias("display_name"),
                v.cast("double").alias("value"),
                s.cast("double").alias("shap"),
            )
            for f, v, s in zip(features, values, shaps)
        ]
    )


def background(df: DataFrame, key: str = "row_id", n: int = BACKGROUND_ROWS, seed: object = 42) -> DataFrame:
    """At most ``n`` rows, picked by the digest of their key."""
    return df.orderBy(digest(seed, F.col(key)), key).limit(n)


def feature_means(df: DataFrame, features: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"m_{i}") for i, f in enumerate(features)]).first()
    return {f: row[f"m_{i}"] for i, f in enumerate(features)}


def linear_attribution(
    df: DataFrame, weights: dict[str, float], means: dict[str, float], intercept: float = 0.0,
    key: str = "row_id", overrides: dict[str, str] | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Log-odds attributions of a linear model, weight x (value - background mean).

    ``base_value`` plus the attributions is the margin. Plain column arithmetic. Columns in
    ``keep`` stay beside the result, here and in the other attributions.
    """
    features = list(weights)
    shaps = [F.lit(float(weights[f])) * (F.col(f) - F.lit(float(means[f]))) for f in features]
    base = intercept + sum(weights[f] * means[f] for f in features)
    return df.select(
        key,
        *keep,
        F.lit(float(base)).alias("base_value"),
        contribution_array([F.col(f) for f in features], shaps, features, overrides).alias("contributions"),
    )


def tree_attribution(
    df: DataFrame, model: Model, features: list[str], key: str = "row_id",
    overrides: dict[str, str] | None = None, tables: TreeTables | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Path-dependent tree attributions, a bounded number of rows at a time.

    The unit is probability for a forest and log-odds for boosted trees.
    The flattened trees shipped to the tasks are as large as the model, not the data.
    """
    tables = tables or tree_tables(model, df.sparkSession)
    width = len(features)
    rows = df.select(key, *keep, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    schema = T.StructType(rows.schema.fields + [T.StructField("_phi", T.ArrayType(T.DoubleType()))])

    def attributed(waiting: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phi = tables.attribute(np.concatenate([np.stack(batch["_x"].to_numpy()) for batch in waiting]), width)
        for batch, part in zip(waiting, np.split(phi, np.cumsum([len(batch) for batch in waiting])[:-1])):
            yield batch.assign(_phi=list(part))

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, rows = [], 0
        for batch in batches:
            if len(batch):
                waiting.append(batch)
                rows += len(batch)
            if rows * width >= ATTRIBUTED_CELLS:
                yield from attributed(waiting)
                waiting, rows = [], 0
        if waiting:
            yield from attributed(waiting)

    out = rows.mapInPandas(attribute, schema)
    return out.select(
        key,
        *keep,
        F.lit(float(tables.base_value)).alias("base_value"),
        contribution_array(
            [F.col("_x")[i] for i in range(width)], [F.col("_phi")[i] for i in range(width)], features, overrides
        ).alias("contributions"),
    )


def sampled_attribution(
    df: DataFrame, model: Model, features: list[str], reference: dict[str, float], key: str = "row_id",
    orders: int = 16, seed: object = 42, overrides: dict[str, str] | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Attributions of P(class 1) for any model, by sampled feature orders.

    In each order the features move one by one from the reference point to the row's value; the
    score changes are averaged. Every row expands into ``orders`` x (features + 1) points that are
    scored in one ``transform``, and they telescope: base plus attributions is the row's score.
    """
    d = len(features)
    x = F.array(*[F.col(f).cast("double") for f in features])
    ref = F.array(*[F.lit(float(reference[f])) for f in features])
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda i: F.struct(digest(seed, F.col(key), F.col("_order"), i).alias("h"), i.alias("i")),
    )
    order = F.transform(F.array_sort(picks), lambda s: s["i"])
    walked = (
        df.select(key, *keep, x.alias("_x"))
        .withColumn("_order", F.explode(F.sequence(F.lit(1), F.lit(orders))))
        .withColumn("_perm", order)
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    )
    mixed = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda i: F.when(
            F.array_position(F.col("_perm"), i) <= F.col("_step"), F.element_at("_x", i + 1)
        ).otherwise(F.element_at(ref, i + 1)),
    )
    points = walked.withColumn("features", array_to_vector(mixed))
    scored = model.transform(points).withColumn("_p", vector_to_array("probability")[1])
    enters = F.when(F.col("_step") > 0, F.element_at("_perm", F.col("_step")))
    leaves = F.when(F.col("_step") < d, F.element_at("_perm", F.col("_step") + 1))
    # A step adds its score to the feature that just entered and takes it from the next one. All
    # buffers are numbers, so rows are combined by hash before the shuffle.
    totals = scored.groupBy(key, *keep).agg(
        *[F.first(F.element_at("_x", i + 1)).alias(f"_x{i}") for i in range(d)],
        F.avg(F.when(F.col("_step") == 0, F.col("_p"))).alias("base_value"),
        *[
            (
                F.sum(F.when(enters == i, F.col("_p")).otherwise(F.when(leaves == i, -F.col("_p")).otherwise(F.lit(0.0))))
                / F.lit(float(orders))
            ).alias(f"_s{i}")
            for i in range(d)
        ],
    )
    return totals.select(
        key, *keep, "base_value",
        contribution_array(
            [F.col(f"_x{i}") for i in range(d)], [F.col(f"_s{i}") for i in range(d)], features, overrides
        ).alias("contributions"),
    )


@dataclass
class Coalitions:
    """Which features take the row's value (the others the background's), and what each coalition's score adds to each attribution."""

    masks: np.ndarray  # coalitions x features, the empty one first and the full one last
    shares: np.ndarray  # coalitions x features


def coalitions(d: int, budget: int = 2048, seed: int = 42) -> Coalitions:
    """All coalitions of ``d`` features if the budget allows, else ``budget`` seeded ones drawn by their kernel weight in pairs.

    The attributions are the least-squares fit to the scores under kernel weights whose sum is bound to the score's distance from
    the base. It is linear in the scores and the same for every row, so it is solved once, here.
    """
    if 2 ** d - 2 <= budget:
        inner = (np.arange(1, 2 ** d - 1)[:, None] >> np.arange(d) & 1).astype(float)
        size = inner.sum(axis=1)
        weight = np.array([(d - 1) / (math.comb(d, int(s)) * s * (d - s)) for s in size])
    else:
        draw = np.random.default_rng(seed)
        chance = np.array([(d - 1) / (s * (d - s)) for s in range(1, d)])
        sizes = draw.choice(np.arange(1, d), budget // 2, p=chance / chance.sum())
        half = np.array([np.isin(np.arange(d), draw.choice(d, s, replace=False)) for s in sizes]).astype(float)
        inner, times = np.unique(np.concatenate([half, 1 - half]), axis=0, return_counts=True)
        weight = times.astype(float)
    empty, full = np.zeros((1, d)), np.ones((1, d))
    if not len(inner):  # a single feature takes the whole distance
        return Coalitions(np.concatenate([empty, full]), np.array([[-1.0], [1.0]]))
    inverse = np.linalg.pinv((inner.T * weight) @ inner)
    even = inverse.sum(axis=1) / inverse.sum()
    fit = inverse @ (inner.T * weight)
    fit -= np.outer(even, fit.sum(axis=0))
    shares = np.concatenate([[-fit.sum(axis=1) - even], fit.T, [even]])
    return Coalitions(np.concatenate([empty, inner, full]), shares)


def shapley_shares(d: int) -> Coalitions:
    """Every coalition with its share by the definition: the reference for ``coalitions``."""
    masks = (np.arange(2 ** d)[:, None] >> np.arange(d) & 1).astype(float)
    size = masks.sum(axis=1).astype(int)
    with_it = np.array([math.factorial(max(s - 1, 0)) * math.factorial(d - max(s, 1)) / math.factorial(d) for s in size])
    without = np.array([math.factorial(min(s, d - 1)) * math.factorial(d - 1 - min(s, d - 1)) / math.factorial(d) for s in size])
    return Coalitions(masks, np.where(masks > 0, with_it[:, None], -without[:, None]))


def kernel_attribution(
    df: DataFrame, model: Model, features: list[str], reference: np.ndarray, key: str = "row_id", budget: int = 2048,
    seed: int = 42, overrides: dict[str, str] | None = None, keep: tuple[str, ...] = (), plan: Coalitions | None = None,
) -> DataFrame:
    """Attributions of P(class 1) for any model with ``transform``, by weighted coalitions of features.

    ``reference`` holds the background: a row per point, a column per feature (a bounded sample). A coalition's score is the mean over the
    background. For the linear model and tree ensembles a row's coalitions are scored together in its task (``coalition_scores``). For
    other models every row becomes coalitions x background points, made in its task and scored in one ``transform``; their weighted
    scores are summed before anything is exchanged. With all coalitions (11 features or fewer by default) the result is exact.
    ``key`` and ``keep`` tell the rows apart.
    """
    d, plan = len(features), plan or coalitions(len(features), budget, seed)
    ground = np.atleast_2d(np.asarray(reference, float))
    rows = df.select(key, *keep, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    scores = coalition_scores(model, df.sparkSession, plan.masks, ground)
    if scores is not None:
        return _attributed(rows, scores, plan, features, key, overrides, keep)
    schema = T.StructType([
        *rows.schema.fields, T.StructField("_mixed", T.ArrayType(T.DoubleType())), T.StructField("_share", T.ArrayType(T.DoubleType())),
        T.StructField("_base", T.DoubleType()),
    ])
    masks = np.repeat(plan.masks, len(ground), axis=0)
    shares = list(np.repeat(plan.shares, len(ground), axis=0) / len(ground))
    rest = (1 - masks) * np.tile(ground, (len(plan.masks), 1))
    base = np.where(masks.any(axis=1), 0.0, 1.0 / len(ground))

    def mix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                mixed = pd.DataFrame([row] * len(masks), columns=batch.columns)
                yield mixed.assign(_mixed=list(masks * np.asarray(row[-1]) + rest), _share=shares, _base=base)

    points = rows.mapInPandas(mix, schema).withColumn("features", array_to_vector("_mixed"))
    scored = model.transform(points).withColumn("_p", vector_to_array("probability")[1])
    weighed = [F.col("_p") * F.col("_share")[i] for i in range(d)]
    return _summed(scored, F.col("_p") * F.col("_base"), weighed, features, key, overrides, keep)


def _attributed(
    rows: DataFrame, scores: Scores, plan: Coalitions, features: list[str], key: str, overrides: dict[str, str] | None, keep: tuple[str, ...],
) -> DataFrame:
    """Attributions of rows with ``_x``, whose coalitions' scores ``scores`` gives."""
    shares, empty = plan.shares, ~plan.masks.any(axis=1)
    schema = T.StructType([*rows.schema.fields, T.StructField("_phi", T.ArrayType(T.DoubleType())), T.StructField("_base", T.DoubleType())])

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), COALITION_ROWS):
                part = batch.iloc[start: start + COALITION_ROWS]
                p = scores(np.stack(part["_x"].to_numpy()))
                yield part.assign(_phi=list(p @ shares), _base=p[:, empty].sum(axis=1))

    points = rows.mapInPandas(attribute, schema)
    return _summed(points, F.col("_base"), [F.col("_phi")[i] for i in range(len(features))], features, key, overrides, keep)


def _summed(
    points: DataFrame, base: Column, shaps: list[Column], features: list[str], key: str, overrides: dict[str, str] | None, keep: tuple[str, ...],
) -> DataFrame:
    d = len(features)
    totals = points.groupBy(key, *keep).agg(
        *[F.first(F.col("_x")[i]).alias(f"_x{i}") for i in range(d)], F.sum(base).alias("base_value"),
        *[F.sum(shap).alias(f"_s{i}") for i, shap in enumerate(shaps)],
    )
    return totals.select(
        key, *keep, "base_value",
        contribution_array([F.col(f"_x{i}") for i in range(d)], [F.col(f"_s{i}") for i in range(d)], features, overrides).alias("contributions"),
    )


def attribution(
    df: DataFrame, model: Model, features: list[str], training: DataFrame, key: str = "row_id",
    overrides: dict[str, str] | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Pick the attribution by model kind: trees, linear, or weighted coalitions for anything else."""
    if hasattr(model, "trees"):
        return tree_attribution(df, model, features, key, overrides, keep=keep)
    means = feature_means(training, features)
    if hasattr(model, "coefficients"):
        weights = dict(zip(features, (float(w) for w in model.coefficients)))
        return linear_attribution(df, weights, means, float(model.intercept), key, overrides, keep)
    return kernel_attribution(df, model, features, np.array([means[f] for f in features]), key, overrides=overrides, keep=keep)


# Tables made from contributions -------------------------------------------------------------


def global_importance(explained: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature over all rows, greatest first."""
    each = explained.select(F.explode("contributions").alias("c")).select("c.feature", F.abs("c.shap").alias("size"))
    return each.groupBy("feature").agg(F.avg("size").alias("mean_abs_shap")).orderBy(
        F.col("mean_abs_shap").desc(), "feature"
    )


def _ranked(column: str = "contributions") -> Column:
    """The row's contributions by descending size; equal sizes by feature name."""
    return F.array_sort(
        F.transform(
            column,
            lambda c: F.struct(
                (-F.abs(c["shap"])).alias("order"),
                c["feature"].alias("feature"),
                c["display_name"].alias("display_name"),
                nearest_decimal(c["value"], 4).alias("value"),
                nearest_decimal(c["shap"], 4).alias("shap"),
                F.when(c["shap"] > 0, F.lit("↑ Risk")).otherwise(F.lit("↓ Risk")).alias("direction"),
                F.abs(c["shap"]).alias("abs_shap"),
            ),
        )
    )


def explain_rows(explained: DataFrame, key: str = "row_id") -> DataFrame:
    """One row per (key, feature), ranked by absolute attribution."""
    long = explained.select(key, F.posexplode(_ranked()).alias("rank", "c"))
    return long.select(
        key, (F.col("rank") + 1).alias("rank"), "c.feature", "c.display_name", "c.value", "c.shap",
        "c.direction", "c.abs_shap",
    )


def _leading(n: int, upward: bool) -> Column:
    """The first ``n`` ranked contributions whose rounded attribution points up (or down)."""
    return F.slice(
        F.filter(_ranked(), lambda c: (c["shap"] > 0) if upward else (c["shap"] < 0)), 1, n
    )


def top_factors(explained: DataFrame, n: int = 5, key: str = "row_id") -> DataFrame:
    """Per row, its ``n`` strongest risk factors and ``n`` strongest protective ones."""

    def typed(upward: bool, kind: str) -> Column:
        return F.transform(
            _leading(n, upward),
            lambda c, i: F.struct(
                F.lit(kind).alias("type"), (i + 1).alias("rank"),
                c["display_name"].alias("factor"), c["shap"].alias("impact"),
            ),
        )

    both = F.concat(typed(True, RISK), typed(False, PROTECTIVE))
    return explained.select(key, F.explode(both).alias("f")).select(key, "f.type", "f.rank", "f.factor", "f.impact")


def waterfall(explained: DataFrame, n: int = 10, key: str = "row_id") -> DataFrame:
    """Per row, its ``n`` largest contributions in ascending order of attribution."""
    top = F.array_sort(
        F.transform(
            F.slice(_ranked(), 1, n),
            lambda c: F.struct(c["shap"].alias("shap"), c["feature"].alias("feature"), c["display_name"].alias("display_name")),
        )
    )
    return explained.select(key, F.posexplode(top).alias("position", "c")).select(
        key, (F.col("position") + 1).alias("position"), "c.feature", "c.display_name", "c.shap"
    )


# Wording of the narrative.
ACTIONS_FORCEFUL = (
    "🚨Immediate retention conversation recommended",
    "• Consider salary review or career advancement discussion",
    "• Review overtime workload and work-life balance",
)
ACTIONS_WATCHFUL = (
    "⚠️ Schedule engagement check-in within 30 days",
    "• Review promotion history and growth opportunities",
)
ACTIONS_CALM = (
    "✅ Monitor in next quarterly review",
    "• Maintain current engagement programs",
)
TEXT_STATUS = "Attrition Assessment: "
TEXT_CHANCE = ("This employee has a ", "% probability of leaving.")
TEXT_DRIVERS = "Primary Risk Drivers:"
TEXT_PROTECTIVE = "Protective Factors:"
TEXT_ACTIONS = "Recommended HR Actions:"
TEXT_DRIVER = ("• ", ": contributing +", " to attrition risk")
TEXT_PROTECTOR = ("• ", ": reducing attrition risk by ", "")


def narrative(
    explained: DataFrame, score: str = "score", prediction: str = "prediction", key: str = "row_id"
) -> DataFrame:
    """One explanation text per row from its contributions, score and prediction."""
    return explained.select(key, narrative_text(score, prediction).alias("explanation"))


def narrative_text(score: str = "score", prediction: str = "prediction") -> Column:
    p = F.col(score)

    def lines(n: int, upward: bool, words: tuple[str, str, str]) -> Column:
        return F.transform(
            _leading(n, upward),
            lambda c: F.concat(
                F.lit(words[0]), c["display_name"], F.lit(words[1]),
                fixed_text(F.abs(c["shap"]), 3), F.lit(words[2]),
            ),
        )

    def block(texts: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(t) for t in texts])

    protectors = lines(2, False, TEXT_PROTECTOR)
    head = F.array(
        F.concat(F.lit(TEXT_STATUS), F.when(F.col(prediction) == 1, F.lit("HIGH RISK")).otherwise(F.lit("LOW RISK"))),
        F.concat(F.lit(TEXT_CHANCE[0]), fixed_text(p * 100, 1), F.lit(TEXT_CHANCE[1])),
        F.lit(""),
        F.lit(TEXT_DRIVERS),
    )
    shield = F.when(
        F.size(protectors) > 0, F.concat(block(("", TEXT_PROTECTIVE)), protectors)
    ).otherwise(F.array().cast("array<string>"))
    actions = (
        F.when(p > FORCEFUL, block(ACTIONS_FORCEFUL)).when(p > WATCHFUL, block(ACTIONS_WATCHFUL))
        .otherwise(block(ACTIONS_CALM))
    )
    text = F.concat(head, lines(3, True, TEXT_DRIVER), shield, block(("", TEXT_ACTIONS)), actions)
    return F.array_join(text, "\n")
