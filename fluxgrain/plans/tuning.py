"""Grid sweeps of detectors on validation windows, ensemble weights and the dual label rule."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Evaluation, Spectral
from ..operators import ensemble, metrics
from ..operators.fitted import Ensemble, create
from . import pipeline
from .pipeline import Prepared

#: Settings tried for each detector, the last one varying first.
GRIDS: dict[str, dict[str, tuple]] = {
    "vae": {"latent": (16, 32), "beta": (0.5, 1.0), "dropout": (0.1, 0.2), "epochs": (40, 60)},
    "iforest": {"trees": (200, 400), "samples": (256, 512), "share": (1.0, 0.8)},
    "hbos": {"bins": (5, 10, 20)},
    # shares of outliers expected, as other libraries ask for, can't change these scores: one setting
    "ecod": {},
    "copod": {},
}


def settings_of(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def sweep(data: Prepared, model: str, grid: Mapping[str, Sequence] | None = None) -> tuple[dict, list[dict]]:
    """The settings of greatest validation AUROC, the first of equals, and a row for each tried."""
    rows, val = [], data.part("val")
    for s in settings_of(GRIDS[model] if grid is None else grid):
        fitted = create(model, **s).fit(data.part("train"), data.names).set_bounds(val)
        found = metrics.auc(fitted.score(val).join(val.select("series", "win", "y"), ["series", "win"])).first()["auroc"]
        rows.append({"model": model, **s, "val_auroc": found})
    keys = [k for k in rows[0] if k not in ("model", "val_auroc")]
    best = ensemble.best_row([(r["val_auroc"] if r["val_auroc"] is not None else float("nan"), {k: r[k] for k in keys}) for r in rows])
    return best or {}, rows


def tune(data: Prepared, models: Sequence[str] = ("vae", "iforest", "ecod", "copod", "hbos"), grids: Mapping[str, Mapping[str, Sequence]] | None = None, step: float = 0.05) -> dict:
    """Best settings of each model, ensemble weights by validation AUROC, and all rows tried."""
    best, tried = {}, []
    for m in models:
        best[m], rows = sweep(data, m, (grids or {}).get(m))
        tried += rows
    fitted = pipeline.fit_ensemble(data, models, settings=best)
    scores = pipeline.score_all(data, fitted).filter("split = 'val' AND model <> 'ensemble'")
    wide = scores.groupBy("series", "win").agg(F.max("y").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in models])
    top = ensemble.search_weights(wide, list(models), step).first().asDict()
    weights = {m: top.get(m) or 0.0 for m in models}
    return {"settings": best, "weights": weights, "val_auroc": top["value"], "tried": tried}


def dual_evaluation(train_flows: DataFrame, eval_flows: DataFrame, cfg: Spectral, ev: Evaluation, models: Sequence[str], settings: Mapping[str, Mapping] | None = None, weights: Mapping[str, float] | None = None, exclude: Sequence[str] = (), ts: str = "ts") -> dict[str, dict[str, DataFrame]]:
    """The evaluation tables under each label rule, windows and detectors made anew for each."""
    out = {}
    for rule in ("majority", "any"):
        data = pipeline.prepare(train_flows, eval_flows, cfg, replace(ev, rule=rule), ts, exclude=exclude)
        scores = pipeline.score_all(data, pipeline.fit_ensemble(data, models, weights, settings))
        out[rule] = {"models": pipeline.evaluate_models(scores), "per_class": metrics.per_class(scores.filter("split = 'test' AND model = 'ensemble'"))}
    return out


def tuned_ensemble(data: Prepared, found: Mapping) -> Ensemble:
    """An ensemble of what tune() found, without the models of weight 0."""
    weights = {m: w for m, w in found["weights"].items() if w > 0}
    return pipeline.fit_ensemble(data, list(weights), weights, found["settings"])
