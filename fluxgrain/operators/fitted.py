"""Detectors that are fit once, kept, and score later: one protocol for all kinds.

Relational detectors keep their train rows as Parquet; forests and networks keep arrays.  Score
bounds come from benign reference rows and are kept beside the model.  Nothing is pickled.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import read_text, write_text
from . import detectors, ensemble, scaling

MODELS = {"iforest": detectors.IsolationForest, "vae": detectors.VariationalAutoencoder, "svdd": detectors.DeepSvdd}


class Detector(Protocol):
    """What the ensemble asks of a detector."""

    name: str
    features: list[str]
    bounds: tuple[float, float] | None

    def fit(self, train: DataFrame, features: Sequence[str]) -> "Detector": ...

    def raw(self, rows: DataFrame, ids: Sequence[str]) -> DataFrame: ...

    def set_bounds(self, reference: DataFrame, ids: Sequence[str]) -> "Detector": ...

    def score(self, rows: DataFrame, ids: Sequence[str]) -> DataFrame: ...

    def save(self, path: str) -> None: ...


class Base:
    """Bounds, calibrated scores and decisions, the same for every kind."""

    def __init__(self, name: str, **settings) -> None:
        self.name, self.settings, self.features, self.bounds = name, settings, [], None

    def raw(self, rows: DataFrame, ids: Sequence[str]) -> DataFrame:
        raise NotImplementedError

    def set_bounds(self, reference: DataFrame, ids: Sequence[str] = ("series", "win")) -> "Base":
        """Bounds from reference rows, which have y; all rows count where none is benign."""
        scored = self.raw(reference, ids).join(reference.select(*ids, "y"), list(ids)).withColumn("model", F.lit(self.name))
        b = scaling.bounds(scored).first()
        self.bounds = (float(b["low"]), float(b["high"])) if b else None
        return self

    def score(self, rows: DataFrame, ids: Sequence[str] = ("series", "win")) -> DataFrame:
        """ids, raw and score in [0, 1]; without bounds, those of the rows themselves."""
        raw = self.raw(rows, ids)
        low, high = self.bounds or tuple(raw.agg(F.min("raw"), F.max("raw")).first())
        return raw.withColumn("score", scaling.normalised(F.col("raw"), F.lit(low), F.lit(high)))

    def predict(self, rows: DataFrame, threshold: float, ids: Sequence[str] = ("series", "win")) -> DataFrame:
        return self.score(rows, ids).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

    def _head(self) -> dict:
        return {"name": self.name, "settings": self.settings, "features": self.features, "bounds": self.bounds}


class Relational(Base):
    """ecod, copod and hbos: scores of rows against the train rows."""

    train: DataFrame

    def fit(self, train: DataFrame, features: Sequence[str]) -> "Relational":
        self.features = list(features)
        self.train = train.select(*self.features)
        return self

    def raw(self, rows: DataFrame, ids: Sequence[str] = ("series", "win")) -> DataFrame:
        if self.name == "hbos":
            return detectors.hbos_scores(self.train, rows, ids, self.features, **self.settings)
        return detectors.inductive_tail_scores(self.train, rows, ids, self.features, self.name)

    def save(self, path: str) -> None:
        self.train.write.mode("overwrite").parquet(f"{path}/train")
        write_text(self.train.sparkSession, f"{path}/detector.json", json.dumps(self._head()))


class Matrix(Base):
    """iforest, vae and svdd: arrays that travel with the tasks."""

    model: object = None
    spark: SparkSession

    def fit(self, train: DataFrame, features: Sequence[str]) -> "Matrix":
        self.features, self.spark = list(features), train.sparkSession
        self.model = MODELS[self.name](**self.settings).fit(detectors.matrix(train, self.features))
        return self

    def raw(self, rows: DataFrame, ids: Sequence[str] = ("series", "win")) -> DataFrame:
        return detectors.score_batches(rows, ids, self.features, self.model)

    def save(self, path: str) -> None:
        arrays = arrays_of(self.model)
        plain = {k: {"shape": list(v.shape), "type": str(v.dtype), "values": v.ravel().tolist()} for k, v in arrays.items()}
        write_text(self.spark, f"{path}/arrays.json", json.dumps(plain))
        write_text(self.spark, f"{path}/detector.json", json.dumps(self._head()))


def arrays_of(model) -> dict[str, np.ndarray]:
    if isinstance(model, detectors.IsolationForest):
        trees = [np.stack([t[0], t[2], t[3]]) for t in model.forest]
        return {"size": np.array(model.size), "ends": np.cumsum([t.shape[1] for t in trees]), "nodes": np.concatenate(trees, 1), "values": np.concatenate([np.stack([t[1], t[4]]) for t in model.forest], 1)}
    own = {f"p.{k}": v for k, v in model.p.items()} | {f"state.{k}": v for k, v in getattr(model, "state", {}).items()}
    return own | ({"centre": model.centre} if hasattr(model, "centre") else {})


def restore(model, arrays: Mapping[str, np.ndarray]):
    if isinstance(model, detectors.IsolationForest):
        model.size = int(arrays["size"])
        at = 0
        for end in arrays["ends"].astype(int).tolist():
            (f, left, right), (cut, depth) = arrays["nodes"][:, at:end], arrays["values"][:, at:end]
            model.forest.append((f, cut, left, right, depth))
            at = end
        return model
    model.p = {k[2:]: v for k, v in arrays.items() if k.startswith("p.")}
    if hasattr(model, "state"):
        model.state = {k[6:]: v for k, v in arrays.items() if k.startswith("state.")}
    if "centre" in arrays:
        model.centre = arrays["centre"]
    return model


def create(name: str, **settings) -> Relational | Matrix:
    """A detector by its name: ecod, copod, hbos, iforest, vae or svdd."""
    if name in MODELS:
        return Matrix(name, **settings)
    if name in ("ecod", "copod", "hbos"):
        return Relational(name, **settings)
    raise ValueError(f"unknown detector {name}")


def load(spark: SparkSession, path: str) -> Relational | Matrix:
    head = json.loads(read_text(spark, f"{path}/detector.json"))
    out = create(head["name"], **head["settings"])
    out.features, out.bounds = head["features"], tuple(head["bounds"]) if head["bounds"] else None
    if isinstance(out, Relational):
        out.train = spark.read.parquet(f"{path}/train")
        return out
    plain = json.loads(read_text(spark, f"{path}/arrays.json"))
    out.spark = spark
    out.model = restore(MODELS[out.name](**{k: tuple(v) if isinstance(v, list) else v for k, v in head["settings"].items()}), {k: np.array(v["values"], v["type"]).reshape(v["shape"]) for k, v in plain.items()})
    return out


class Ensemble:
    """Detectors by name with weights; the score is their weighted mean."""

    def __init__(self, detectors: Mapping[str, Relational | Matrix], weights: Mapping[str, float] | None = None) -> None:
        self.detectors, self.weights = dict(detectors), dict(weights or dict.fromkeys(detectors, 1.0))

    def fit(self, train: DataFrame, features: Sequence[str], reference: DataFrame | None = None) -> "Ensemble":
        for d in self.detectors.values():
            d.fit(train, features)
            if reference is not None:
                d.set_bounds(reference)
        return self

    def scores(self, rows: DataFrame, ids: Sequence[str] = ("series", "win")) -> DataFrame:
        """ids, model, raw and score: a row for each detector."""
        out = None
        for name, d in self.detectors.items():
            one = d.score(rows, ids).withColumn("model", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out

    def score(self, rows: DataFrame, ids: Sequence[str] = ("series", "win")) -> DataFrame:
        return ensemble.blend(self.scores(rows, ids), self.weights, ids)

    def save(self, spark: SparkSession, path: str) -> None:
        for name, d in self.detectors.items():
            d.save(f"{path}/{name}")
        write_text(spark, f"{path}/ensemble.json", json.dumps({"detectors": list(self.detectors), "weights": self.weights}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Ensemble":
        head = json.loads(read_text(spark, f"{path}/ensemble.json"))
        return cls({n: load(spark, f"{path}/{n}") for n in head["detectors"]}, head["weights"])
