"""Labels of bins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ATTACK, BENIGN
from . import timeseries as ts

#: A mean this close below a share reaches it.
TIE = 1e-9


def bin_labels(flows: DataFrame, at: str, seconds: int, label: str = "label", order: str = "event_id", series: str | None = None) -> DataFrame:
    """attack_count, flow_count, attack_fraction and dominant_attack of each dense bin.

    The dominant attack is the most frequent attack label; among equals the one seen first.
    Counting runs by (bin, label), so a bin with very many flows is combined before any shuffle.
    """
    bad = (F.col(label) != BENIGN).cast("double")
    counts = ts.binned(flows.withColumn("__bad", bad), at, seconds, [F.sum("__bad").alias("attack_count"), F.count("*").cast("double").alias("flow_count")], series)
    key = F.col(series) if series else F.lit(0)
    rows = flows.filter(F.col(at).isNotNull()).withColumn("series", key)
    origin = counts.select("series", "origin").distinct()
    attacks = rows.filter(F.col(label) != BENIGN).join(F.broadcast(origin), "series").withColumn("bin", ts.bin_number(at, F.col("origin"), seconds))
    kinds = attacks.groupBy("series", "bin", label).agg(F.count("*").alias("n"), F.min(F.struct(at, order)).alias("first"))
    best = kinds.groupBy("series", "bin").agg(F.max_by(label, F.struct("n", (-F.unix_micros(F.col(f"first.{at}").cast("timestamp"))).alias("t"), (-F.col(f"first.{order}")).alias("o"))).alias("dominant_attack"))
    full = counts.join(best, ["series", "bin"], "left")
    out = ts.densified(full, seconds, ["attack_count", "flow_count", "dominant_attack"], {"dominant_attack": BENIGN})
    return out.withColumn("attack_fraction", F.coalesce(F.try_divide("attack_count", "flow_count"), F.lit(0.0)))


def window_labels(bins: DataFrame, size: int, hop: int, rule: str = "majority", share: float = 0.5) -> DataFrame:
    """series, win, y and label of each full window.

    any: one attack in it; majority: the mean of its bins' attack fractions reaches the share (to
    TIE, so that the order of additions doesn't decide).
    The label is the attack that dominates most bins, the least of equals; ATTACK if none does.
    """
    if rule not in ("any", "majority"):
        raise ValueError("the rule is any or majority")
    win = ts.windows(bins, size, hop, ["attack_count", "attack_fraction", "dominant_attack"])
    hit = (F.max("attack_count") > 0) | (F.max("attack_fraction") > 0) if rule == "any" else F.avg("attack_fraction") >= share - TIE
    y = win.groupBy("series", "win").agg(hit.cast("int").alias("y"))
    named = win.filter((F.col("attack_count") > 0) & (F.col("dominant_attack") != BENIGN)).groupBy("series", "win", "dominant_attack").count()
    top = named.groupBy("series", "win").agg(F.max("count").alias("count"))
    mode = named.join(top, ["series", "win", "count"]).groupBy("series", "win").agg(F.min("dominant_attack").alias("mode"))
    return y.join(mode, ["series", "win"], "left").select("series", "win", "y", F.when(F.col("y") == 1, F.coalesce("mode", F.lit(ATTACK))).otherwise(F.lit(BENIGN)).alias("label"))


def attack_runs(bins: DataFrame) -> DataFrame:
    """Contiguous stretches of bins with attacks: first and last bin and their number."""
    bad = bins.filter(F.col("attack_count") > 0).select("series", "bin_idx")
    place = F.row_number().over(Window.partitionBy("series").orderBy("bin_idx"))
    island = bad.withColumn("island", F.col("bin_idx") - place)
    return island.groupBy("series", "island").agg(F.min("bin_idx").alias("first_bin"), F.max("bin_idx").alias("last_bin"), F.count("*").alias("bins")).drop("island")


def without_labels(rows: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    return rows.filter(~F.upper(label).isin([n.upper() for n in names])) if names else rows
