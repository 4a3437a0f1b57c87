"""Train, validation and test partitions of windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


#: Classes of the order by which evaluation windows are permuted.
TURNS = 10007


def _permuted(rows: DataFrame) -> DataFrame:
    """place (from 0, by a hash class of the window, then series and window) and many.

    Places inside a class run in a window over that class; a table of TURNS rows at most carries
    what stands before.
    """
    turn = F.pmod(F.col("win") * 7919 + 13, F.lit(TURNS))
    dealt = rows.withColumn("__turn", turn)
    sized = dealt.groupBy(F.col("__turn").alias("__class")).agg(F.count("*").alias("__n"))
    up_to = Window.orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.select("__class", F.coalesce(F.sum("__n").over(up_to), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("many"))
    inside = F.row_number().over(Window.partitionBy("__turn").orderBy("series", "win"))
    return dealt.withColumn("place", inside - 1).join(before, F.col("__turn") == F.col("__class")).withColumn("place", F.col("place") + F.col("__before")).drop("__turn", "__class", "__before")


def day_split(train: DataFrame, evaluation: DataFrame, share: float = 0.30, seed: int | None = None) -> DataFrame:
    """Benign windows of the train day: head to train, tail halved in time to val and test; all
    windows of the evaluation day, permuted, halved to val and test.

    The permutation is by a hash of the window, or numpy's for a seed (small tables only).
    Columns: series, win, y, label, split.
    """
    b = ranks.places(train.filter("y = 0"), "win")
    hold = F.greatest(F.lit(2), F.floor(F.col("many") * share))
    after = F.col("place") - (F.col("many") - hold)
    half = F.greatest(F.lit(1), F.floor(hold / 2))
    benign = b.withColumn("split", F.when(after < 0, "train").when(after < half, "val").otherwise("test"))
    if seed is None:
        a = _permuted(evaluation)
    else:
        a = ranks.places(evaluation, "win")
        n = evaluation.count()
        order = np.empty(n, int)
        order[np.random.RandomState(seed).permutation(n)] = np.arange(n)
        table = evaluation.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(order)], "place long, turn long")
        a = a.join(table, "place").withColumn("place", F.col("turn")).drop("turn")
    attack = a.withColumn("split", F.when(F.col("place") < F.greatest(F.lit(1), F.floor(F.col("many") / 2)), "val").otherwise("test"))
    keep = ["series", "win", "y", "label", "split"]
    return benign.select(*keep).unionByName(attack.select(*keep))


def disjoint_split(rows: DataFrame, share: float = 0.30) -> DataFrame:
    """One stream: benign windows by time as in day_split, attack windows halved by hash order."""
    out = day_split(rows, rows.filter("y = 1"), share)
    return out


def overlap(split: DataFrame) -> int:
    """Windows that are in train and in another part: 0 in a sound split."""
    ids = lambda c: split.filter(c).select("series", "win")
    return ids("split = 'train'").intersect(ids("split <> 'train'")).count()


def summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("windows"), F.sum("y").alias("attacks"), F.avg("y").alias("attack_share"))
