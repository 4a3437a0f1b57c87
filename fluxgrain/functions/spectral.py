"""Spectral descriptors of a power spectrum held as array<double>, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BANDS, EPSILON



def total(psd: Column) -> Column:
    return F.aggregate(psd, F.lit(0.0), lambda a, p: a + p)


def frequency(k: Column | int, n: int, fs: float) -> Column:
    return (F.lit(k) if isinstance(k, int) else k) * F.lit(fs / n)


def _guard(power: Column, value: Column) -> Column:
    return F.when(power <= EPSILON, F.lit(0.0)).otherwise(value)


def entropy(psd: Column, power: Column) -> Column:
    """-sum p ln p, natural logarithm, shares clipped at epsilon and not renormalised."""
    share = lambda p: F.greatest(p / power, F.lit(EPSILON))
    return _guard(power, F.aggregate(psd, F.lit(0.0), lambda a, p: a - share(p) * F.ln(share(p))))


def centroid(psd: Column, power: Column, n: int, fs: float) -> Column:
    weighed = F.transform(psd, lambda p, k: p * frequency(k.cast("double"), n, fs))
    return _guard(power, total(weighed) / power)


def bandwidth(psd: Column, power: Column, centre: Column, n: int, fs: float) -> Column:
    spread = F.transform(psd, lambda p, k: p * F.pow(frequency(k.cast("double"), n, fs) - centre, F.lit(2.0)))
    return _guard(power, F.sqrt(total(spread) / power))


def flatness(psd: Column) -> Column:
    """Geometric over arithmetic mean, powers clipped at epsilon."""
    clipped = F.transform(psd, lambda p: F.greatest(p, F.lit(EPSILON)))
    mean = total(clipped) / F.size(psd)
    logs = F.aggregate(clipped, F.lit(0.0), lambda a, p: a + F.ln(p)) / F.size(psd)
    return F.when(mean <= EPSILON, F.lit(0.0)).otherwise(F.exp(logs) / mean)


def rolloff(psd: Column, power: Column, share: float, n: int, fs: float) -> Column:
    """The first frequency at which the running power reaches the share."""
    state = F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("k"))
    seen = F.aggregate(psd, state, lambda s, p: F.struct((s["run"] + p).alias("run"), (s["k"] + F.when((s["run"] + p) / power < share, 1).otherwise(0)).alias("k")), lambda s: s["k"])
    return _guard(power, frequency(F.least(seen, F.size(psd) - 1).cast("double"), n, fs))


def dominant(psd: Column, power: Column) -> Column:
    """struct(k, power) of the strongest bin but the first; the lowest of equals (to 1e-9, so
    that the order of additions doesn't decide)."""
    tagged = F.transform(F.slice(psd, 2, 1 << 30), lambda p, k: F.struct(F.round(p, 9).alias("about"), (-(k + 1)).alias("minus"), p.alias("power")))
    top = F.array_max(tagged)
    return F.struct(F.when(power <= EPSILON, 0).otherwise(-top["minus"]).alias("k"), _guard(power, top["power"]).alias("power"))


def bands(psd: Column, power: Column, size: int) -> list[Column]:
    """Shares of power in BANDS slices of the bins, bounds rounded half to even."""
    cuts = [int(round(i * size / BANDS)) for i in range(BANDS + 1)]
    return [_guard(power, total(F.slice(psd, a + 1, b - a)) / power) for a, b in zip(cuts, cuts[1:])]


def descriptor_names(rolloffs: tuple[float, ...]) -> list[str]:
    """Canonical order."""
    return [
        "entropy", "centroid", "flatness", "bandwidth", "dominant_frequency", "dominant_amplitude", "total_power", "dc_component",
        *(f"rolloff_{int(r * 100)}" for r in rolloffs), *(f"energy_band_{i}" for i in range(BANDS)),
    ]


def describe(psd: Column, mean: Column, dead: Column, n: int, fs: float, rolloffs: tuple[float, ...]) -> list[Column]:
    """All descriptors of a window of n bins; all 0 where dead (no finite sample)."""
    size = n // 2 + 1
    power = total(psd)
    centre = centroid(psd, power, n, fs)
    top = dominant(psd, power)
    values = [entropy(psd, power), centre, flatness(psd), bandwidth(psd, power, centre, n, fs), frequency(top["k"].cast("double"), n, fs), top["power"], power, mean, *(rolloff(psd, power, r, n, fs) for r in rolloffs), *bands(psd, power, size)]
    return [F.when(dead, F.lit(0.0)).otherwise(v).alias(name) for name, v in zip(descriptor_names(rolloffs), values)]
