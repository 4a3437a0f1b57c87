"""Running sums, places and exact percentiles that no task computes alone.

Values are cut into as many ranges per group as there are shuffle partitions, at approximate
percentiles of the group's own values.  Windows run inside one range; a table of one row per
group and range carries what stands before it.  The sums are exact wherever the cuts fall.

Rows come combined by (group, value), so one value that many rows share is one row here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep


def _with(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of small, a row per group; small is one row where there are no keys."""
    if not keys:
        return rows.join(small, F.lit(True))
    renamed = small.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    met = rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return met.drop(*[f"__of_{k}" for k in keys])


def running(points: DataFrame, keys: Sequence[str], x: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """points with, for each c of sums, run_c (over the values up to the row's own, itself
    included) and all_c (over the group).

    points has one row per (keys, x); it and the cuts are written once to the shared folder; descending runs
    from the greatest value down.  Null values of x come first, as in an ascending sort (last,
    descending).
    """
    points = keep(points, "points")
    many = max(2, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written once as well: an approximate percentile may come out differently when it is asked again
    cuts = keep(points.groupBy(*keys).agg(F.percentile_approx(x, [i / many for i in range(1, many)], 1000).alias("__cuts")), "cuts")
    cell = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(x))), F.lit(-1))
    cut = _with(points, cuts, keys).withColumn("__cell", F.when(F.col(x).isNull(), F.lit(-1)).otherwise(cell)).drop("__cuts")
    cells = cut.groupBy(*keys, "__cell").agg(*[F.sum(c).alias(f"__in_{c}") for c in sums])
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = Window.partitionBy(*keys).orderBy(turn("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and range: as many rows as shuffle partitions in each group
    offsets = cells.select(*keys, "__cell", *[F.coalesce(F.sum(f"__in_{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums], *[F.sum(f"__in_{c}").over(Window.partitionBy(*keys)).alias(f"all_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "__cell").orderBy(turn(x)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = _with(cut.withColumns({f"run_{c}": F.sum(c).over(inside) for c in sums}), offsets, [*keys, "__cell"])
    return ranked.withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"__before_{c}") for c in sums}).drop("__cell", *[f"__before_{c}" for c in sums])


def counted(rows: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """keys, x, c (rows of that value; a row with a column w counts w times), run_c and all_c, of
    the values that are not null."""
    w = F.col("w") if "w" in rows.columns else F.lit(1)
    points = rows.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.sum(w).alias("c"))
    return running(points, keys, x, ["c"])


def percentiles(rows: DataFrame, keys: Sequence[str], x: str, shares: Sequence[float]) -> DataFrame:
    """keys and q: the exact percentiles of x, linear between neighbours; groups without values
    are left out.  No buffer holds a group's values."""
    t = counted(rows, keys, x)
    first, last, most = F.col("run_c") - F.col("c"), F.col("run_c") - 1, F.col("all_c") - 1
    at = [F.lit(float(p)) * most for p in shares]
    pick = lambda place: F.max(F.when((first <= place) & (place <= last), F.col(x).cast("double")))
    ends = t.groupBy(*keys).agg(*[pick(F.floor(a)).alias(f"lo{i}") for i, a in enumerate(at)], *[pick(F.ceil(a)).alias(f"hi{i}") for i, a in enumerate(at)], F.max(most).alias("most"))
    between = [F.lit(float(p)) * F.col("most") - F.floor(F.lit(float(p)) * F.col("most")) for p in shares]
    value = [F.col(f"lo{i}") * (1 - w) + F.col(f"hi{i}") * w for i, w in enumerate(between)]
    found = ends.filter(F.col("most").isNotNull())
    return found.select(*keys, F.array(*value).alias("q"))


def places(rows: DataFrame, x: str) -> DataFrame:
    """rows of (series, x), each pair once, with place (from 0, by series and x) and many."""
    sized = running(rows.groupBy("series").agg(F.count("*").alias("n")), [], "series", ["n"])
    within = running(rows.withColumn("one", F.lit(1)), ["series"], x, ["one"])
    before = sized.select("series", (F.col("run_n") - F.col("n")).alias("__before"), F.col("all_n").alias("many"))
    return _with(within, before, ["series"]).withColumn("place", F.col("__before") + F.col("run_one") - 1).drop("__before", "run_one", "all_one", "one")

