"""The anomaly pipeline end to end: series, windows, features, labels, splits, scores, metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BENIGN, Evaluation, Spectral
from ..operators import detectors, ensemble, labels, metrics, scaling, spectral, splits, timeseries
from ..operators.fitted import Ensemble, create
from ..sources.scratch import keep


def subset_features(flows: DataFrame, cfg: Spectral, rule: Evaluation = Evaluation(), ts: str = "ts", series: str | None = None, multiscale: bool = False, engine: str = "auto") -> DataFrame:
    """Features, y and label of each full window of the flows."""
    dense = timeseries.log_channels(timeseries.flow_series(flows, ts, cfg.bin_seconds, series), cfg.log_channels)
    made = spectral.multiscale_matrix(dense, cfg, engine) if multiscale else spectral.feature_matrix(dense, cfg, engine=engine)
    marks = labels.window_labels(labels.bin_labels(flows, ts, cfg.bin_seconds, series=series), cfg.window, cfg.hop, rule.rule, rule.attack_share)
    return made.join(marks, ["series", "win"])


COLUMNS = ["series", "win", "split", "y", "label", "model", "score"]


@dataclass
class Prepared:
    """Scaled windows with y, label and split, and what made them."""

    split: DataFrame
    names: list[str]
    scaler: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.split.filter(F.col("split") == name)


def prepare(train_flows: DataFrame, eval_flows: DataFrame, cfg: Spectral = Spectral(), ev: Evaluation = Evaluation(), ts: str = "ts", multiscale: bool = False, exclude: Sequence[str] = (), scaler: DataFrame | None = None, engine: str = "auto") -> Prepared:
    """Features, splits and scaling of a train day and an evaluation day.

    Each table that is used several times is written once to the shared folder.  exclude leaves
    windows of these attack labels out of val and test; a given scaler has to fit the features.
    """
    a, b = (subset_features(f, cfg, ev, ts, multiscale=multiscale, engine=engine) for f in (train_flows, eval_flows))
    names = [f"{p}{n}" for p in (("fast__", "slow__") if multiscale else ("",)) for n in spectral.feature_names(cfg)]
    rows = keep(a.unionByName(b.withColumn("series", F.col("series") + 1)).fillna(0.0, names), "features")
    heads = rows.select("series", "win", "y", "label")
    marks = splits.day_split(heads.filter("series = 0"), heads.filter("series > 0"), ev.holdout)
    if exclude:
        marks = marks.filter("split = 'train'").unionByName(labels.without_labels(marks.filter("split <> 'train'"), list(exclude)))
    return scaled(rows.drop("y", "label").join(marks, ["series", "win"]), names, scaler)


def raw_prepared(train_flows: DataFrame, eval_flows: DataFrame, cfg: Spectral = Spectral(), ev: Evaluation = Evaluation(), ts: str = "ts") -> Prepared:
    """As prepare, with the mean and the maximum of each channel in a window as its features."""
    parts = []
    for k, flows in enumerate((train_flows, eval_flows)):
        dense = timeseries.flow_series(flows, ts, cfg.bin_seconds)
        win = timeseries.windows(dense, cfg.window, cfg.hop, list(cfg.channels))
        made = win.groupBy("series", "win").agg(*[f(c).alias(f"{c}__{f.__name__}") for c in cfg.channels for f in (F.mean, F.max)])
        marks = labels.window_labels(labels.bin_labels(flows, ts, cfg.bin_seconds), cfg.window, cfg.hop, ev.rule, ev.attack_share)
        parts.append(made.join(marks, ["series", "win"]).withColumn("series", F.col("series") + k))
    rows = keep(parts[0].unionByName(parts[1]), "features")
    heads = rows.select("series", "win", "y", "label")
    marks = splits.day_split(heads.filter("series = 0"), heads.filter("series > 0"), ev.holdout)
    return scaled(rows.drop("y", "label").join(marks, ["series", "win"]), [c for c in rows.columns if "__" in c])


def scaled(split: DataFrame, names: Sequence[str], scaler: DataFrame | None = None) -> Prepared:
    split = keep(split, "split")
    scaler = scaler if scaler is not None else keep(scaling.fit_scaler(split.filter("split = 'train'"), names), "scaler")
    return Prepared(keep(scaling.scale(split, scaler, names), "scaled"), list(names), scaler)


def fit_ensemble(data: Prepared, models: Sequence[str] = ("ecod", "copod", "hbos"), weights: Mapping[str, float] | None = None, settings: Mapping[str, Mapping] | None = None) -> Ensemble:
    """Detectors fit on the train windows, their bounds on the validation windows."""
    made = {m: create(m, **(settings or {}).get(m, {})) for m in models}
    return Ensemble(made, weights).fit(data.part("train"), data.names, data.part("val"))


def score_all(data: Prepared, fitted: Ensemble, whole: str = "ensemble") -> DataFrame:
    """COLUMNS of val and test windows for each detector and their blend; written once."""
    rest = data.split.filter("split <> 'train'")
    heads = rest.select("series", "win", "split", "y", "label")
    each = keep(fitted.scores(rest).drop("raw").join(heads, ["series", "win"]).select(COLUMNS), "each")
    mixed = ensemble.blend(each, fitted.weights).withColumn("model", F.lit(whole)).join(heads, ["series", "win"])
    return keep(each.unionByName(mixed.select(COLUMNS)), "scores")


def evaluate_models(scores: DataFrame, method: str = "f1_optimal") -> DataFrame:
    """Metrics on the test windows at each model's own validation threshold, best AUROC first."""
    val, test = scores.filter("split = 'val'"), scores.filter("split = 'test'")
    return metrics.evaluate(test, metrics.threshold(val, method, ["model"]), ["model"]).orderBy(F.desc_nulls_last("auroc"), "model")


def evaluate_methods(scores: DataFrame, methods: Sequence[str] = ("f1", "youden_j", "percentile_95"), model: str = "ensemble") -> DataFrame:
    """Metrics of one model at the threshold of each method: a row per method."""
    val, test = (scores.filter((F.col("split") == s) & (F.col("model") == model)) for s in ("val", "test"))
    out = None
    for m in methods:
        row = metrics.evaluate(test, metrics.threshold(val, m)).select(F.lit(model).alias("model"), F.lit(m).alias("threshold_method"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def detect(train_flows: DataFrame, eval_flows: DataFrame, cfg: Spectral = Spectral(), ev: Evaluation = Evaluation(), models: Sequence[str] = ("ecod", "copod", "hbos"), weights: Mapping[str, float] | None = None, ts: str = "ts", fitted: Ensemble | None = None, engine: str = "auto") -> dict[str, DataFrame]:
    """Scores and evaluation tables of a train day against an evaluation day; with fitted, of an
    ensemble that was fit before."""
    data = prepare(train_flows, eval_flows, cfg, ev, ts, engine=engine)
    all_ = score_all(data, fitted or fit_ensemble(data, models, weights))
    return {"scores": all_, "models": evaluate_models(all_), "per_class": metrics.per_class(all_.filter("split = 'test' AND model = 'ensemble'"))}


def flow_scores(train_flows: DataFrame, flows: DataFrame, ids: Sequence[str] = ("event_id",), features: Sequence[str] = ("total_bytes", "total_packets", "duration")) -> DataFrame:
    """ids and flow_score in [0, 1]: each flow's tail score against benign train flows, by the
    least and greatest score given."""
    raw = keep(detectors.inductive_tail_scores(train_flows, flows, list(ids), list(features)), "flowraw")
    span = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    return raw.select(*ids, scaling.normalised(F.col("raw"), F.lit(span["lo"]), F.lit(span["hi"])).alias("flow_score"))


def pooled_flow_scores(flows: DataFrame, scores: DataFrame, cfg: Spectral, ts: str = "ts", how: str = "max", ids: Sequence[str] = ("event_id",)) -> DataFrame:
    """series, win and flow_score of each full window: the greatest or mean score of its flows, 0
    without any."""
    day = flows.join(scores, list(ids))
    bins = timeseries.binned(day, ts, cfg.bin_seconds, [F.max("flow_score").alias("top"), F.sum("flow_score").alias("sum"), F.count("*").cast("double").alias("n")])
    dense = timeseries.densified(bins, cfg.bin_seconds, ["top", "sum", "n"])
    win = timeseries.windows(dense, cfg.window, cfg.hop, ["top", "sum", "n"]).groupBy("series", "win")
    value = F.max("top") if how == "max" else F.coalesce(F.try_divide(F.sum("sum"), F.sum("n")), F.lit(0.0))
    return win.agg(value.alias("flow_score"))


def calibrate_pooled(windows: DataFrame) -> DataFrame:
    """flow_score rescaled by the 5th and 95th percentile of benign validation windows."""
    named = windows.withColumn("model", F.lit("flow")).withColumnRenamed("flow_score", "raw")
    done = scaling.calibrate(named.drop("score"), named.filter("split = 'val'").drop("score"))
    return windows.drop("flow_score").join(done.select("series", "win", F.col("score").alias("flow_score")), ["series", "win"])


def fusion_windows(train_flows: DataFrame, eval_flows: DataFrame, scores: DataFrame, cfg: Spectral, ts: str = "ts", how: str = "max") -> DataFrame:
    """The ensemble's windows with calibrated flow_score beside score: what fuse and sweep take."""
    benign = train_flows.filter(F.col("label") == BENIGN)
    parts = [pooled_flow_scores(f, flow_scores(benign, f), cfg, ts, how).withColumn("series", F.col("series") + k) for k, f in enumerate((train_flows, eval_flows))]
    mixed = scores.filter("model = 'ensemble'").join(parts[0].unionByName(parts[1]), ["series", "win"], "left").fillna(0.0, ["flow_score"])
    return calibrate_pooled(keep(mixed, "fusion"))


def fusion_ablation(windows: DataFrame, weights: Sequence[float] = (0.0, 0.1, 0.2, 0.3)) -> DataFrame:
    """Metrics over all test windows and for each attack kind at each fusion weight."""
    out = None
    for w in weights:
        fused = ensemble.fuse(windows, w)
        val, test = fused.filter("split = 'val'"), fused.filter("split = 'test'")
        limit = metrics.threshold(val, "f1_optimal")
        at = limit.first()["threshold"]
        whole = metrics.evaluate(test, limit).select(F.lit("all").alias("attack_type"), "auroc", "auprc", "f1", "recall", "fpr")
        kinds = metrics.per_class(test, at).select("attack_type", "auroc", "auprc", "f1", "recall", "fpr")
        rows = whole.unionByName(kinds).select(F.lit(float(w)).alias("weight"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def compare_feature_sets(sets: Mapping[str, Prepared], models: Sequence[str] = ("ecod", "hbos")) -> DataFrame:
    """auroc and auprc of each detector on each feature set (spectral against raw)."""
    out = None
    for name, data in sets.items():
        scores = score_all(data, fit_ensemble(data, models)).filter("split = 'test' AND model <> 'ensemble'")
        a = metrics.auc(scores, ["model"]).withColumn("features", F.lit(name))
        out = a if out is None else out.unionByName(a)
    return out
