"""Power spectra and feature matrices of windows.

Two engines give the same numbers.  ``catalyst`` multiplies windows with a broadcast cosine and
sine table (of a size given by the window length alone) and adds up in one aggregate.  ``arrow``
packs windows into arrays and runs real FFTs on Arrow batches; it scales as W log W and is the
one for long windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Spectral
from ..functions import spectral as S
from ..sources.flows import finite
from . import timeseries as ts


def coefficients(n: int, kind: str = "hann") -> list[float]:
    """The periodic Hann window; ones for none or rectangular; anything else is Hann."""
    if kind in ("none", "rectangular"):
        return [1.0] * n
    return [0.5 - 0.5 * math.cos(2 * math.pi * j / n) for j in range(n)]


#: Windows up to so many bins get their spectra by sums in Catalyst, n/2 + 1 rows a sample; longer ones by FFTs.
NARROW = 16


def long_form(win: DataFrame, channels: Sequence[str]) -> DataFrame:
    """A row for each sample of each channel, non-finite samples 0 and counted."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in channels)
    rows = win.selectExpr("series", "win", "j", f"stack({len(channels)}, {pairs}) AS (channel, raw)")
    ok = finite(F.col("raw"))
    return rows.select("series", "win", "j", "channel", F.when(ok, F.col("raw")).otherwise(0.0).alias("x"), ok.cast("int").alias("ok"))


def psd(win: DataFrame, channels: Sequence[str], n: int, kind: str = "hann") -> DataFrame:
    """series, win, channel, psd (one-sided array), mean and dead of each window."""
    spark = win.sparkSession
    w, size = coefficients(n, kind), n // 2 + 1
    table = [(j, k, w[j] * math.cos(2 * math.pi * (j * k % n) / n), w[j] * math.sin(2 * math.pi * (j * k % n) / n)) for j in range(n) for k in range(size)]
    basis = F.broadcast(spark.createDataFrame(table, "j int, k int, c double, s double"))
    rows = long_form(win, channels)
    waves = rows.join(basis, "j").groupBy("series", "win", "channel", "k").agg(F.sum(F.col("x") * F.col("c")).alias("re"), F.sum(F.col("x") * F.col("s")).alias("im"), F.sum("x").alias("sum"), F.max("ok").alias("ok"))
    double = (F.col("k") > 0) & ((F.col("k") < size - 1) if n % 2 == 0 else F.lit(True))
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n * F.when(double, 2.0).otherwise(1.0)
    packed = waves.withColumn("p", power).groupBy("series", "win", "channel").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("bins"), (F.max("sum") / n).alias("mean"), (F.max("ok") == 0).alias("dead"))
    return packed.select("series", "win", "channel", F.transform("bins", lambda b: b["p"]).alias("psd"), "mean", "dead")


def psd_arrow(win: DataFrame, channels: Sequence[str], n: int, kind: str = "hann") -> DataFrame:
    """As psd, by real FFTs over Arrow batches of packed windows."""
    w = np.array(coefficients(n, kind))
    packed = long_form(win, channels).groupBy("series", "win", "channel").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("rows"), F.avg("x").alias("mean"), (F.max("ok") == 0).alias("dead"))
    packed = packed.select("series", "win", "channel", F.transform("rows", lambda r: r["x"]).alias("x"), "mean", "dead")

    @F.pandas_udf("array<double>")
    def spectrum(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        p = np.abs(np.fft.rfft(np.stack(x.to_numpy()) * w, axis=1)) ** 2 / n
        p[:, 1 : -1 if n % 2 == 0 else None] *= 2
        return pd.Series(list(p))

    return packed.select("series", "win", "channel", spectrum("x").alias("psd"), "mean", "dead")


def describe(spectra: DataFrame, n: int, fs: float, rolloffs: tuple[float, ...] = (0.85, 0.95)) -> DataFrame:
    """series, win, channel and the descriptors."""
    return spectra.select("series", "win", "channel", *S.describe(F.col("psd"), F.col("mean"), F.col("dead"), n, fs, rolloffs))


def feature_names(cfg: Spectral, prefix: str = "") -> list[str]:
    names = [f"{prefix}{c}__{d}" for c in cfg.channels for d in S.descriptor_names(cfg.rolloff)]
    return names + ([f"{prefix}{c}__{d}" for c in cfg.channels for d in ("delta_mean", "delta_std")] if cfg.deltas else [])


def feature_matrix(series: DataFrame, cfg: Spectral, size: int | None = None, hop: int | None = None, engine: str = "auto") -> DataFrame:
    """series, win and one column per feature: a row per full window."""
    n, step = size or cfg.window, hop or cfg.hop
    channels = [c for c in cfg.channels if c in series.columns]
    if n < 4 or step < 1:
        raise ValueError("a window has 4 bins at least and moves on by 1 at least")
    win = ts.windows(series, n, step, channels)
    spectra = (psd if engine == "catalyst" or engine == "auto" and n <= NARROW else psd_arrow)(win, channels, n, cfg.window_function)
    long = describe(spectra, n, 1.0 / cfg.bin_seconds, cfg.rolloff)
    names = S.descriptor_names(cfg.rolloff)
    wide = long.groupBy("series", "win").agg(*[F.max(F.when(F.col("channel") == c, F.col(d))).alias(f"{c}__{d}") for c in channels for d in names])
    if cfg.deltas:
        wide = wide.join(ts.deltas(win, channels, n), ["series", "win"])
    missing = [F.lit(0.0).alias(f"{c}__{d}") for c in cfg.channels if c not in channels for d in [*names, *(("delta_mean", "delta_std") if cfg.deltas else ())]]
    return wide.select("series", "win", "*", *missing).select("series", "win", *feature_names(cfg)) if missing else wide.select("series", "win", *feature_names(cfg))


def multiscale_matrix(series: DataFrame, cfg: Spectral, engine: str = "auto") -> DataFrame:
    """Fast features beside those of the slow window that a fast one's start falls in; null
    beside those of a series too short for a slow window."""
    fast = feature_matrix(series, cfg, engine=engine)
    slow_hop = cfg.slow_window - cfg.slow_overlap
    slow = feature_matrix(series, cfg, cfg.slow_window, slow_hop, engine)
    names = feature_names(cfg)
    left = fast.select("series", "win", *[F.col(c).alias(f"fast__{c}") for c in names])
    match = ts.as_of_window(fast, slow, cfg.hop, slow_hop)
    right = slow.select("series", F.col("win").alias("slow_win"), *[F.col(c).alias(f"slow__{c}") for c in names])
    return left.join(match, ["series", "win"], "left").join(right, ["series", "slow_win"], "left").drop("slow_win")
