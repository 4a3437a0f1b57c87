"""Anomaly detectors.

The tail, copula and histogram detectors are relational: features are unpivoted, ranks are running
counts over ranges of a feature's values, and scores add up over features.  Transductive mode
ranks train and scored rows together; inductive mode freezes the train's distribution.  Forests
and networks train on the driver, on TRAIN_ROWS rows of the window matrix at most (a parameter;
with windows of a minute's hop that is 138 days), and score in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks
from .networks import DeepSvdd, VariationalAutoencoder
from .scaling import unpivot

#: Rows that driver-side training uses at most, chosen by hash.
TRAIN_ROWS = 200_000


def _signs(rows: DataFrame) -> DataFrame:
    """feature and sign of its skewness, 0 for a constant one; a row per feature."""
    mean = rows.groupBy("feature").agg(F.avg("x").alias("m"))
    third = rows.join(F.broadcast(mean), "feature").groupBy("feature").agg(F.avg(F.pow(F.col("x") - F.col("m"), F.lit(3))).alias("m3"), F.max("x").alias("hi"), F.min("x").alias("lo"))
    return third.select("feature", F.when(F.col("hi") == F.col("lo"), 0.0).otherwise(F.signum("m3")).alias("sign"))


def _tails(rows: DataFrame) -> DataFrame:
    """-ln of both tail probabilities of each value among its feature's, and the skewness sign.

    Ranks come from running counts of distinct values, over ranges of a feature's values.
    """
    t = ranks.counted(rows, ["feature"], "x")
    left, n = F.col("run_c"), F.col("all_c")
    ranked = t.select("feature", "x", (-F.ln(left / n)).alias("l"), (-F.ln((n - left + F.col("c")) / n)).alias("r"))
    return rows.join(ranked, ["feature", "x"]).join(F.broadcast(_signs(rows)), "feature")


def tail_scores(rows: DataFrame, ids: Sequence[str], features: Sequence[str], kind: str = "ecod") -> DataFrame:
    """ids and raw of each row, ranked among all rows given (train and batch together).

    ecod: sum over features of max(L, R, S); copod: of max(S, (L + R) / 2); S is the tail that
    the skewness points to.
    """
    t = _tails(unpivot(rows, ids, features))
    skewed = F.when(F.col("sign") < 0, F.col("l")).when(F.col("sign") > 0, F.col("r")).otherwise(F.col("l") + F.col("r"))
    each = F.greatest("l", "r", skewed) if kind == "ecod" else F.greatest(skewed, (F.col("l") + F.col("r")) / 2)
    return t.groupBy(*ids).agg(F.sum(each).alias("raw"))


def inductive_tail_scores(train: DataFrame, rows: DataFrame, ids: Sequence[str], features: Sequence[str], kind: str = "ecod") -> DataFrame:
    """As tail_scores with each row ranked against the train rows alone.

    Values of both are merged before they are ranked; the row itself counts once.
    """
    t, r = unpivot(train, [], features), unpivot(rows, ids, features)
    both = t.groupBy("feature", "x").agg(F.count("*").alias("w")).unionByName(r.select("feature", "x", F.lit(0).cast("long").alias("w")))
    c = ranks.counted(both, ["feature"], "x")
    left, n = F.col("run_c"), F.col("all_c")
    ranked = c.select("feature", "x", (-F.ln((left + 1) / (n + 1))).alias("l"), (-F.ln((n - left + F.col("c") + 1) / (n + 1))).alias("r"))
    j = r.join(ranked, ["feature", "x"]).join(F.broadcast(_signs(t)), "feature")
    skewed = F.when(F.col("sign") < 0, F.col("l")).when(F.col("sign") > 0, F.col("r")).otherwise(F.col("l") + F.col("r"))
    each = F.greatest("l", "r", skewed) if kind == "ecod" else F.greatest(skewed, (F.col("l") + F.col("r")) / 2)
    return j.groupBy(*ids).agg(F.sum(each).alias("raw"))


def hbos_scores(train: DataFrame, rows: DataFrame, ids: Sequence[str], features: Sequence[str], bins: int = 10, alpha: float = 0.1, tolerance: float = 0.5) -> DataFrame:
    """-sum over features of log2(density + alpha) under equal-width histograms of the train rows.

    Values within tolerance widths of an edge take its bin; others the feature's least density.
    """
    t = unpivot(train, [], features)
    edge = t.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    edge = edge.withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins))
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.col("width")).cast("int")))
    cells = t.join(F.broadcast(edge), "feature").groupBy("feature", place.alias("cell")).agg(F.count("*").alias("c"))
    grid = edge.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("cell")).join(cells, ["feature", "cell"], "left")
    grid = grid.withColumn("logd", F.log2(F.coalesce("c", F.lit(0)) / (F.col("n") * F.col("width")) + alpha))
    worst = grid.groupBy("feature").agg(F.min("logd").alias("worst"))
    r = unpivot(rows, ids, features).join(F.broadcast(edge.join(worst, "feature")), "feature").withColumn("cell", place)
    far = (F.col("x") < F.col("lo") - tolerance * F.col("width")) | (F.col("x") > F.col("hi") + tolerance * F.col("width"))
    scored = r.join(F.broadcast(grid.select("feature", "cell", "logd")), ["feature", "cell"])
    return scored.groupBy(*ids).agg(F.sum(-F.when(far, F.col("worst")).otherwise(F.col("logd"))).alias("raw"))


def matrix(rows: DataFrame, features: Sequence[str], limit: int = TRAIN_ROWS, seed: int = 42) -> np.ndarray:
    """The features of at most limit rows (chosen by hash), on the driver."""
    chosen = rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features]).withColumn("__by", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in features])).orderBy("__by").limit(limit).drop("__by")
    return chosen.toPandas().to_numpy(float)


def score_batches(rows: DataFrame, ids: Sequence[str], features: Sequence[str], model) -> DataFrame:
    """ids and raw by model.raw on Arrow batches; the model travels with the task."""

    def run(batches):
        for b in batches:
            yield b[list(ids)].assign(raw=model.raw(b[list(features)].to_numpy(float)) if len(b) else np.empty(0))

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in features]).mapInPandas(run, ", ".join([*(f"`{c}` {types[c]}" for c in ids), "raw double"]))


@dataclass
class IsolationForest:
    """Random axis-parallel trees over subsamples; raw is 2^(-mean depth / c)."""

    trees: int = 200
    samples: int = 512
    share: float = 1.0  # of the features, drawn anew for each tree
    seed: int = 42
    forest: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    size: int = 0

    @staticmethod
    def _norm(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def fit(self, x: np.ndarray) -> "IsolationForest":
        rng = np.random.default_rng(self.seed)
        self.size = min(self.samples, len(x))
        top = math.ceil(math.log2(max(self.size, 2)))
        for _ in range(self.trees):
            part = x[rng.choice(len(x), self.size, replace=False)]
            allowed = np.zeros(x.shape[1], bool)
            allowed[rng.permutation(x.shape[1])[: max(1, int(self.share * x.shape[1]))]] = True
            feature, cut, left, right, depth = [], [], [], [], []
            stack = [(np.arange(self.size), 0, -1, False)]
            while stack:
                ids, level, parent, is_right = stack.pop()
                me = len(feature)
                if parent >= 0:
                    (right if is_right else left)[parent] = me
                feature.append(-1), cut.append(0.0), left.append(-1), right.append(-1)
                depth.append(level + self._norm(len(ids)))
                lo, hi = part[ids].min(0), part[ids].max(0)
                wide = np.nonzero((hi > lo) & allowed)[0]
                if level >= top or len(ids) <= 1 or not len(wide):
                    continue
                f = int(rng.choice(wide))
                at = float(rng.uniform(lo[f], hi[f]))
                feature[me], cut[me] = f, at
                below = part[ids, f] < at
                stack += [(ids[~below], level + 1, me, True), (ids[below], level + 1, me, False)]
            self.forest.append((np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(depth)))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, depth in self.forest:
            node = np.zeros(len(x), int)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                below = x[np.arange(len(x)), np.maximum(f, 0)] < cut[node]
                node = np.where(inner, np.where(below, left[node], right[node]), node)
            total += depth[node]
        return 2.0 ** (-total / len(self.forest) / max(self._norm(self.size), 1e-12))


FITTED = {"iforest": IsolationForest, "vae": VariationalAutoencoder, "svdd": DeepSvdd}
