"""Caches, fingerprints and sinks: Parquet and JSON instead of pickles."""

from __future__ import annotations

import copy
import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession


def fingerprint(*parts) -> str:
    """16 hex digits over sorted JSON of the parts (settings, source path, seed)."""
    plain = [asdict(p) if is_dataclass(p) else p for p in parts]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cache_path(folder: str, version: int, rule: str, *parts) -> str:
    return os.path.join(folder, f"splits_v{version}_{rule}_{fingerprint(*parts)}.parquet")


def save_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small report as one file; larger tables as Parquet."""
    if kind == "csv":
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.fspath(path))
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def modified(spark: SparkSession, path: str) -> int:
    """When a file was last written, in milliseconds; that of a folder's success mark, if it has one."""
    p, fs = _hadoop(spark, path)
    mark, _ = _hadoop(spark, f"{os.fspath(path)}/_SUCCESS")
    return fs.getFileStatus(mark if fs.exists(mark) else p).getModificationTime()


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a pattern matches, in order of their names."""
    p, fs = _hadoop(spark, pattern)
    return sorted(str(f.getPath().toString()) for f in fs.globStatus(p) or [])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever store the path names."""
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(os.fspath(path), wholetext=True).first()["value"]


def save_json(value: Mapping, path: str) -> None:
    with open(path, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)


def load_tuned(path: str) -> dict | None:
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def load_config(path: str) -> dict:
    """Settings from YAML; JSON where the YAML reader is not installed."""
    with open(path) as f:
        try:
            import yaml
        except ModuleNotFoundError:
            return json.load(f)
        return yaml.safe_load(f) or {}


def merge_tuned(config: Mapping, tuned: Mapping | None) -> dict:
    """A deep copy of config with the tuned weights, model settings and flow section over it."""
    out = copy.deepcopy(dict(config))
    for key, value in (tuned or {}).items():
        if isinstance(value, Mapping) and isinstance(out.get(key), Mapping):
            out[key] = merge_tuned(out[key], value)
        else:
            out[key] = copy.deepcopy(value)
    return out


def save_scaler(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """The saved scaler; raises if its features are not the given ones in the given order."""
    df = spark.read.parquet(path)
    names = [r["feature"] for r in df.orderBy("place").select("feature").collect()]
    if names != list(features):
        raise ValueError(f"the scaler was fit on other features: {names} instead of {list(features)}")
    return df
