"""Commands: train and evaluate, score with kept models, tune, write the synthetic sample.

    python -m fluxgrain evaluate --sample --out results
    python -m fluxgrain evaluate --data flows/ --models kept/ --skip-train
    python -m fluxgrain tune --data flows/ --out results
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BENIGN, from_settings
from .operators import metrics
from .operators.fitted import Ensemble
from .plans import pipeline, tuning
from .sources import flows, store

NAMES = {"isolation_forest": "iforest", "deep_svdd": "svdd"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fluxgrain", description="Spectral anomaly detection on network flows")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("evaluate", "tune"):
        c = sub.add_parser(name)
        c.add_argument("--data", help="folder, file or pattern of flow CSVs")
        c.add_argument("--sample", action="store_true", help="use the synthetic sample")
        c.add_argument("--rows", type=int, default=5_000, help="flows of the sample")
        c.add_argument("--config", help="YAML of settings")
        c.add_argument("--cache", help="folder of Parquet copies of the CSVs")
        c.add_argument("--out", default="results", help="folder of tables and models")
        c.add_argument("--exclude", default="", help="attack labels to leave out of val and test, comma-separated")
    e = sub.choices["evaluate"]
    e.add_argument("--skip-train", action="store_true", help="load the models instead of fitting them")
    e.add_argument("--models", help="folder of kept models (default: models in --out)")
    e.add_argument("--tuned", help="JSON that tune wrote")
    e.add_argument("--threshold", default=None, help="f1, youden_j, percentile_95 or fpr_x")
    s = sub.add_parser("sample")
    s.add_argument("--rows", type=int, default=5_000)
    s.add_argument("--out", default="sample")
    return p


def days(spark: SparkSession, args: argparse.Namespace, settings: dict) -> tuple[DataFrame, DataFrame]:
    """Train and evaluation flows; the sample trains on its first benign third."""
    if args.sample:
        all_ = flows.as_flows(flows.sample_flows(spark, args.rows))
        start = all_.agg(F.min("ts")).first()[0]
        early = F.col("ts") < F.lit(start) + F.make_dt_interval(secs=F.lit(args.rows // 3))
        return all_.filter(early & (F.col("label") == BENIGN)), all_.filter(~early)
    first = settings.get("data", {}).get("train_day", "Monday")
    later = settings.get("evaluation", {}).get("eval_days", ["Friday"])
    all_ = flows.as_flows(flows.load(spark, "cicids", args.data, list(dict.fromkeys([first, *later])), args.cache))
    return all_.filter(F.col("day") == first), all_.filter(F.col("day").isin(*later))


def show(table: DataFrame) -> None:
    """A metrics table, four decimals."""
    table.select(*[F.round(F.col(f.name), 4).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in table.schema.fields]).show(100, truncate=False)


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    settings = store.merge_tuned(store.load_config(args.config) if args.config else {}, {})
    tuned = store.load_tuned(args.tuned) if args.tuned else None
    cfg, ev, weights = from_settings(settings)
    weights = {NAMES.get(m, m): w for m, w in (tuned["weights"] if tuned else weights).items() if w > 0}
    train, later = days(spark, args, settings)
    where = args.models or f"{args.out}/models"
    fitted = Ensemble.load(spark, where) if args.skip_train else None
    names = [n for n in pipeline.spectral.feature_names(cfg)]
    scaler = store.load_scaler(spark, f"{where}/scaler", names) if args.skip_train else None
    data = pipeline.prepare(train, later, cfg, ev, exclude=[x for x in args.exclude.split(",") if x], scaler=scaler)
    if fitted is None:
        fitted = pipeline.fit_ensemble(data, list(weights), weights, tuned and tuned["settings"])
        fitted.save(spark, where)
        store.save_scaler(data.scaler, f"{where}/scaler")
    scores = pipeline.score_all(data, fitted)
    method = args.threshold or settings.get("evaluation", {}).get("default_threshold_method", "f1_optimal")
    tables = {
        "model_comparison": pipeline.evaluate_models(scores, method),
        "threshold_comparison": pipeline.evaluate_methods(scores, ev.methods),
        "per_attack": metrics.per_class(scores.filter("split = 'test' AND model = 'ensemble'")),
    }
    for name, table in tables.items():
        store.write_table(table, f"{args.out}/metrics/{name}")
        show(table)


def tune(spark: SparkSession, args: argparse.Namespace) -> None:
    settings = store.load_config(args.config) if args.config else {}
    cfg, ev, _ = from_settings(settings)
    train, later = days(spark, args, settings)
    data = pipeline.prepare(train, later, cfg, ev, exclude=[x for x in args.exclude.split(",") if x])
    found = tuning.tune(data)
    store.write_text(spark, f"{args.out}/tuned.json", json.dumps({k: found[k] for k in ("settings", "weights", "val_auroc")}, indent=2))
    store.write_text(spark, f"{args.out}/metrics/tuning_results.json", json.dumps(found["tried"], indent=2))
    show(pipeline.evaluate_models(pipeline.score_all(data, tuning.tuned_ensemble(data, found))))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command in ("evaluate", "tune") and not (args.sample or args.data):
        raise SystemExit("--data or --sample is needed")
    spark = SparkSession.builder.appName("fluxgrain").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "sample":
        flows.write_sample(spark, args.out, args.rows)
    else:
        {"evaluate": evaluate, "tune": tune}[args.command](spark, args)


if __name__ == "__main__":
    main()
