"""The streaming twin of the dense hopping windows: bins with a watermark, windows with state."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bins(flows: DataFrame, ts: str, seconds: int, late: str, series: str | None = None) -> DataFrame:
    """Counts, bytes and packets per bin of a stream, given out once the watermark passes."""
    key = F.col(series) if series else F.lit(0)
    rows = flows.withColumn("at", F.col(ts).cast("timestamp")).withColumn("series", key).withWatermark("at", late)
    agg = rows.groupBy("series", F.window("at", f"{seconds} seconds")).agg(F.count("*").cast("double").alias("flow_count"), F.sum("total_bytes").alias("total_bytes"), F.sum("total_packets").alias("total_packets"))
    return agg.select("series", F.col("window.start").alias("bin_ts"), "flow_count", "total_bytes", "total_packets")


def stream_windows(bins: DataFrame, seconds: int, size: int, hop: int, channels: Sequence[str]) -> DataFrame:
    """Full hopping windows of a stream of bins: win_ts and an array per channel.

    State is the last size bins of a series; gaps are filled with zero rows.
    """
    names = list(channels)
    out = "series int, win long, win_ts timestamp, " + ", ".join(f"{c} array<double>" for c in names)
    state = "first long, next long, tail array<array<double>>"

    def run(key, parts, held: GroupState):
        first, nxt, tail = held.get if held.exists else (None, None, [])
        tail = [list(r) for r in tail]
        rows = pd.concat(list(parts)).sort_values("bin_ts")
        done = []
        for r in rows.itertuples(index=False):
            at = int(r.bin_ts.timestamp()) // seconds
            if first is None:
                first = nxt = at
            while nxt <= at:
                tail.append([float(getattr(r, c)) if nxt == at else 0.0 for c in names])
                tail = tail[-size:]
                start = nxt - size + 1 - first
                if start >= 0 and start % hop == 0:
                    done.append((key[0], start // hop, pd.Timestamp((first + start) * seconds, unit="s"), *([t[i] for t in tail] for i in range(len(names)))))
                nxt += 1
        held.update((first, nxt, tail))
        yield pd.DataFrame(done, columns=["series", "win", "win_ts", *names])

    return bins.groupBy("series").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)
