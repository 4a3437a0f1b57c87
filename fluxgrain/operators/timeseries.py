"""Dense time series and windows over them.

Bins are arithmetic on epoch microseconds from midnight of the first day; gaps become zero rows.
Windows are positions in the dense series, so a window is an equality of computed ids: nothing
here compares ranges, and partial edge windows don't arise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def bin_number(ts: str, origin: Column, seconds: int) -> Column:
    return F.floor((_micros(ts) - origin) / F.lit(seconds * 1_000_000))


def binned(df: DataFrame, ts: str, seconds: int, aggregates: Sequence[Column], series: str | None = None) -> DataFrame:
    """Aggregates per bin: series, bin (number from midnight of the series' first day)."""
    key = F.col(series) if series else F.lit(0)
    rows = df.filter(F.col(ts).isNotNull()).withColumn("series", key)
    origin = rows.groupBy("series").agg(F.unix_micros(F.date_trunc("day", F.min(ts).cast("timestamp"))).alias("origin"))
    return rows.join(origin, "series").withColumn("bin", bin_number(ts, F.col("origin"), seconds)).groupBy("series", "origin", "bin").agg(*aggregates)


def densified(bins: DataFrame, seconds: int, values: Sequence[str], zero: dict[str, object] | None = None) -> DataFrame:
    """Every bin from a series' first to its last, with its position and time; gaps as zero."""
    span = bins.groupBy("series", "origin").agg(F.min("bin").alias("low"), F.max("bin").alias("high"))
    grid = span.select("series", "origin", "low", F.explode(F.sequence("low", "high")).alias("bin"))
    full = grid.join(bins.drop("origin"), ["series", "bin"], "left")
    fill = [F.coalesce(F.col(v), F.lit((zero or {}).get(v, 0.0))).alias(v) for v in values]
    at = F.timestamp_micros(F.col("origin") + F.col("bin") * (seconds * 1_000_000)).cast("timestamp_ntz")
    return full.select("series", (F.col("bin") - F.col("low")).cast("long").alias("bin_idx"), at.alias("bin_ts"), *fill)


def flow_series(flows: DataFrame, ts: str = "ts", seconds: int = 1, series: str | None = None, size: str = "total_bytes", packets: str = "total_packets", duration: str = "duration") -> DataFrame:
    """The four channels of flow records: count, bytes, packets, mean duration."""
    channels = [F.count("*").cast("double").alias("flow_count"), F.sum(size).alias("total_bytes"), F.sum(packets).alias("total_packets"), F.avg(duration).alias("mean_duration")]
    return densified(binned(flows, ts, seconds, channels, series), seconds, ["flow_count", "total_bytes", "total_packets", "mean_duration"])


def sum_series(df: DataFrame, ts: str, seconds: int, columns: Sequence[str], series: str | None = None) -> DataFrame:
    """Sums of the given columns and the count, per bin."""
    made = [F.sum(c).cast("double").alias(c) for c in columns]
    return densified(binned(df, ts, seconds, [*made, F.count("*").cast("double").alias("flow_count")], series), seconds, [*columns, "flow_count"])


def log_channels(series: DataFrame, channels: Sequence[str]) -> DataFrame:
    return series.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in channels if c in series.columns})


def windows(series: DataFrame, size: int, hop: int, values: Sequence[str]) -> DataFrame:
    """Hopping windows of full length: series, win, j (place in the window), win_ts and values."""
    if size < 1 or hop < 1:
        raise ValueError("windows have a length and a hop of 1 at least")
    length = series.groupBy("series").agg((F.max("bin_idx") + 1).alias("length"))
    i = F.col("bin_idx")
    low = F.greatest(F.lit(0), F.ceil((i - size + 1) / F.lit(hop)))
    high = F.least(F.floor((F.col("length") - size) / F.lit(hop)), F.floor(i / F.lit(hop)))
    rows = series.join(length, "series").filter(F.col("length") >= size).withColumn("low", low).withColumn("high", high).filter("low <= high")
    rows = rows.withColumn("win", F.explode(F.sequence("low", "high"))).withColumn("win", F.col("win").cast("long"))
    return rows.select("series", "win", (i - F.col("win") * hop).cast("int").alias("j"), "bin_ts", *values)


def tumbling(series: DataFrame, size: int, values: Sequence[str]) -> DataFrame:
    return windows(series, size, size, values)


def _difference_moments(x: Column, size: int) -> tuple[Column, Column]:
    """Mean and population variance of the steps of an array."""
    d = F.zip_with(F.slice(x, 2, size), F.slice(x, F.lit(1), F.size(x) - 1), lambda b, a: b - a)
    n = F.greatest(F.size(d), F.lit(1))
    mean = F.aggregate(d, F.lit(0.0), lambda a, v: a + v) / n
    return mean, F.aggregate(d, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n


def deltas(win: DataFrame, channels: Sequence[str], size: int) -> DataFrame:
    """Mean and population deviation of first differences in each window; 0 for a single bin.

    Differences come from sorted arrays, so there is one aggregate and no window function.
    """
    packed = win.groupBy("series", "win").agg(F.array_sort(F.collect_list(F.struct("j", *channels))).alias("rows"))
    out = ["series", "win"]
    for c in channels:
        mean, spread = _difference_moments(F.col(f"rows.{c}"), size)
        out += [mean.alias(f"{c}__delta_mean"), F.sqrt(spread).alias(f"{c}__delta_std")]
    return packed.select(*out)


def first_differences(series: DataFrame, channel: str) -> DataFrame:
    from pyspark.sql import Window

    step = F.col(channel) - F.lag(channel, 1).over(Window.partitionBy("series").orderBy("bin_idx"))
    return series.select("series", "bin_idx", step.alias("difference"))


def as_of_window(fast: DataFrame, slow: DataFrame, fast_hop: int, slow_hop: int) -> DataFrame:
    """The last slow window that starts no later than each fast one, clipped to those there are.

    Both grids are regular, so the match is computed and joined as an equality.
    """
    count = slow.groupBy("series").agg((F.max("win") + 1).alias("slow_count"))
    ids = fast.select("series", "win").distinct().join(count, "series")
    match = F.least(F.floor(F.col("win") * fast_hop / F.lit(slow_hop)), F.col("slow_count") - 1)
    return ids.select("series", "win", match.cast("long").alias("slow_win"))


def pool_interval(points: DataFrame, starts: DataFrame, ts: str, value: str, seconds: int, inclusive_end: bool = False) -> DataFrame:
    """Max and mean of points in [start, start + seconds) of each window (id, start), any starts.

    Points and windows meet in buckets of the window's length: a window touches two of them.
    """
    width = F.lit(seconds * 1_000_000)
    p = points.select(_micros(ts).alias("at"), F.col(value).alias("value")).withColumn("bucket", F.floor(F.col("at") / width))
    w = starts.select("id", _micros("start").alias("from")).withColumn("first", F.floor(F.col("from") / width))
    touched = w.withColumn("bucket", F.explode(F.array(F.col("first"), F.col("first") + 1)))
    upper = F.col("at") <= F.col("from") + width if inclusive_end else F.col("at") < F.col("from") + width
    hit = touched.join(p, "bucket").filter((F.col("at") >= F.col("from")) & upper)
    pooled = hit.groupBy("id").agg(F.max("value").alias("pooled_max"), F.avg("value").alias("pooled_mean"), F.count("*").alias("n"))
    return starts.select("id").join(pooled, "id", "left").select("id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pooled_max", "pooled_mean")), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
