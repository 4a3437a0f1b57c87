"""Robust scaling and score calibration by exact percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def unpivot(rows: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(ids), list(features), "feature", "x")


def fit_scaler(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, place, center (median) and scale (interquartile range, 1 where that is 0)."""
    spark = train.sparkSession
    order = spark.createDataFrame(list(enumerate(features)), "place int, feature string")
    q = ranks.percentiles(unpivot(train, [], features), ["feature"], "x", [0.25, 0.5, 0.75])
    iqr = F.col("q")[2] - F.col("q")[0]
    return q.join(order, "feature").select("feature", "place", F.col("q")[1].alias("center"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale"))


def scale(rows: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features less center, by scale; the scaler is a row per feature and becomes literals."""
    by = {r["feature"]: r for r in scaler.collect()}
    if list(features) != [r["feature"] for r in sorted(by.values(), key=lambda r: r["place"])]:
        raise ValueError("the features differ from those the scaler was fit on")
    return rows.withColumns({c: (F.col(f"`{c}`") - by[c]["center"]) / by[c]["scale"] for c in features})


def bounds(scores: DataFrame, by: Sequence[str] = ("model",), low: float = 0.05, high: float = 0.95) -> DataFrame:
    """low and high of each model's raw scores: percentiles of benign rows, all rows if there are
    none, the extremes where the percentiles meet, and a hair more where these do too."""
    benign = F.col("y") == 0
    calm = scores.groupBy(*by).agg(F.max(benign.cast("int")).alias("__some"))
    use = scores.join(calm, list(by)).filter(benign | (F.coalesce("__some", F.lit(0)) == 0))
    ends = use.groupBy(*by).agg(F.min("raw").alias("n"), F.max("raw").alias("x"))
    use = ends.join(ranks.percentiles(use, by, "raw", [low, high]).withColumnRenamed("q", "p"), list(by))
    meet, flat = F.col("p")[1] <= F.col("p")[0], F.col("x") <= F.col("n")
    return use.select(*by, F.when(meet, F.col("n")).otherwise(F.col("p")[0]).alias("low"), F.when(meet & flat, F.col("n") + 1e-6).when(meet, F.col("x")).otherwise(F.col("p")[1]).alias("high"))


def normalised(raw, low, high):
    return F.when(high - low < 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - low) / (high - low))))


def calibrate(scores: DataFrame, reference: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """scores with score in [0, 1] by the bounds that the reference (validation) rows give."""
    return scores.join(bounds(reference, by), list(by)).withColumn("score", normalised(F.col("raw"), F.col("low"), F.col("high"))).drop("low", "high")
