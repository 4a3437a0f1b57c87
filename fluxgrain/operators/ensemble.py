"""Blends of calibrated scores, weight search and fusion with flow scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BENIGN
from . import metrics

# Fixed value: the attack label that flow scores are tuned on, and the least number of its windows.
HIDDEN, FEW = "BOT", 10


def blend(scores: DataFrame, weights: Mapping[str, float], ids: Sequence[str] = ("series", "win")) -> DataFrame:
    """ids and score: the weighted mean over the models present, in [0, 1].

    scores has a row per id and model; weights are renormalised over models that have rows.
    """
    if sum(weights.values()) <= 0:
        raise ValueError("no model has a positive weight")
    weight = F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m, float(w))])[F.col("model")]
    known = scores.filter(F.col("model").isin(list(weights)))
    mixed = known.groupBy(*ids).agg(F.try_divide(F.sum(F.col("score") * weight), F.sum(weight)).alias("score"))
    return mixed.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))


def compositions(models: int, steps: int) -> Iterator[tuple[int, ...]]:
    """All ways to deal steps units to the models, the last one's share growing first."""
    if models == 1:
        yield (steps,)
        return
    for first in range(steps + 1):
        for rest in compositions(models - 1, steps - first):
            yield (first, *rest)


def search_weights(wide: DataFrame, models: Sequence[str], step: float = 0.05, least: float = 0.55, metric: str = "auroc") -> DataFrame:
    """A row per weighting of the eligible models with its metric on (y, one column per model),
    best first; among equals the first in grid order.

    Valid weightings alone are enumerated; each row meets each weighting once, in one pass.
    """
    spark = wide.sparkSession
    each = wide.select("y", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models])).alias("s")).select("y", "s.*")
    good = {r["model"]: r["auroc"] for r in metrics.auc(each, ["model"]).collect()}
    names = [m for m in models if (good.get(m) or 0) >= least] or list(models)
    units = round(1 / step)
    grid = spark.createDataFrame([(i, [k / units for k in c]) for i, c in enumerate(compositions(len(names), units))], "combo int, w array<double>")
    score = sum((F.col("w")[i] * F.col(m) for i, m in enumerate(names)), F.lit(0.0))
    rows = wide.crossJoin(F.broadcast(grid)).select("combo", "y", score.alias("score"))  # weightings: a number fixed by step
    scored = metrics.auc(rows, ["combo"])
    value = F.col("auroc" if metric == "auroc" else "auprc")
    return scored.join(grid, "combo").select("combo", *[F.col("w")[i].alias(m) for i, m in enumerate(names)], value.alias("value")).orderBy(F.col("value").desc(), "combo")


def fuse(windows: DataFrame, weight: float) -> DataFrame:
    """score blended with flow_score: (1 - weight) * score + weight * flow_score."""
    if weight <= 0:
        return windows
    return windows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - weight) * F.col("score") + weight * F.col("flow_score"))))


def sweep_fusion(windows: DataFrame, weights: Sequence[float] = (0.0, 0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """weight and average precision of each fusion; flows are scored once, before.  Where windows
    have labels and FEW of them are of the kind that spectra miss, it and benign ones alone count."""
    if "label" in windows.columns:
        hidden = F.upper("label") == HIDDEN
        if windows.filter(hidden).limit(FEW).count() >= FEW:
            windows = windows.filter(hidden | (F.upper("label") == BENIGN)).withColumn("y", hidden.cast("int"))
    grid = F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight")
    rows = windows.select("y", "score", "flow_score", grid)
    mixed = rows.select("weight", "y", ((1 - F.col("weight")) * F.col("score") + F.col("weight") * F.col("flow_score")).alias("score"))
    return metrics.auc(mixed, ["weight"]).select("weight", "auprc")


def best_row(rows: Sequence[tuple[float, object]]) -> object:
    """Of (value, what): what has the greatest value, the first of equals; NaN never wins."""
    best, kept = -math.inf, None
    for value, what in rows:
        if value == value and value > best:
            best, kept = value, what
    return kept
