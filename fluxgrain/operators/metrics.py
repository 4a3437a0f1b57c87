"""Detection metrics and thresholds, as running sums over distinct scores.

Rows are combined by (group, score) before anything is ordered, and the ordered sums run over
ranges of scores (ranks.running), so one group never needs all its scores in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BENIGN
from . import ranks


def _weight(scores: DataFrame):
    """How many rows a row stands for: its w, if there is such a column, or one."""
    return F.col("w") if "w" in scores.columns else F.lit(1)


def curve(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, score, p, n (of that score), tp, fp (of scores at least it), all_p and all_n, per distinct score."""
    w = _weight(scores)
    points = scores.groupBy(*by, "score").agg(F.sum((F.col("y") == 1).cast("long") * w).alias("p"), F.sum((F.col("y") == 0).cast("long") * w).alias("n"))
    run = ranks.running(points, by, "score", ["p", "n"], descending=True)
    return run.select(*by, "score", "p", "n", F.col("run_p").alias("tp"), F.col("run_n").alias("fp"), "all_p", "all_n")


def auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """auroc (ties count half) and auprc (average precision); null for a single class."""
    c = curve(scores, by)
    wins = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / F.lit(2.0)))
    ap = F.sum(F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    both = (F.max("all_p") > 0) & (F.max("all_n") > 0)
    return c.groupBy(*by).agg(F.when(both, wins / (F.max("all_p").cast("double") * F.max("all_n"))).alias("auroc"), F.when(F.max("all_p") > 0, ap / F.max("all_p")).alias("auprc"))


def _f1(tp, fp, P):
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + (P - tp)), F.lit(0.0))


def roc_points(scores: DataFrame, by: Sequence[str] = (), thin: bool = False) -> DataFrame:
    """by, threshold, fpr, tpr; thin leaves out points between collinear neighbours."""
    c = curve(scores, by)
    if thin:
        c = _corners(c, by)
    return c.select(*by, F.col("score").alias("threshold"), (F.col("fp") / F.greatest(F.col("all_n"), F.lit(1))).alias("fpr"), (F.col("tp") / F.greatest(F.col("all_p"), F.lit(1))).alias("tpr"), "tp", "fp", "all_p", "all_n")


def _corners(c: DataFrame, by: Sequence[str]) -> DataFrame:
    """The points of a curve whose step before differs from the step after; the ends stay.

    A point's neighbours are found by place: place k and k + 1 meet in one equality join.
    """
    numbered = ranks.running(c.withColumn("one", F.lit(1)), by, "score", ["one"], descending=True)
    later = numbered.select(*[F.col(k).alias(f"__{k}") for k in by], (F.col("run_one") - 1).alias("__at"), F.col("p").alias("__p"), F.col("n").alias("__n"))
    met = numbered.join(later, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by] + [F.col("run_one") == F.col("__at")], "left")
    kept = (F.col("run_one") == 1) | F.col("__p").isNull() | (F.col("p") != F.col("__p")) | (F.col("n") != F.col("__n"))
    return met.filter(kept).select(c.columns)


def parse_method(method: str) -> tuple[str, float | None]:
    """Aliases and fpr_x: (name, target)."""
    m = {"f1": "f1_optimal", "percentile": "percentile_95"}.get(method, method)
    if m.startswith("fpr_"):
        return "fpr", float(m[4:])
    if m not in ("f1_optimal", "youden_j", "percentile_95"):
        raise ValueError(f"unknown threshold method {method}")
    return m, None


def threshold(scores: DataFrame, method: str, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold and value.  Single-class groups take the 95th percentile and value 0."""
    kind, target = parse_method(method)
    ends = scores.groupBy(*by).agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
    p95 = ranks.percentiles(scores, by, "score", [0.95]).select(*by, F.col("q")[0].alias("p95"))
    fallback = ends.join(p95, list(by)) if by else ends.join(p95, F.lit(True))
    if kind == "percentile_95":
        joined = scores.join(fallback, list(by)) if by else scores.join(fallback, F.lit(True))
        hit = (F.col("score") >= F.col("p95")).cast("long")
        got = joined.groupBy(*by).agg(F.sum(hit * (F.col("y") == 1).cast("long")).alias("tp"), F.sum(hit * (F.col("y") == 0).cast("long")).alias("fp"), F.sum("y").alias("all_p"))
        got = got.select(*by, F.lit(None).cast("double").alias("t"), _f1(F.col("tp"), F.col("fp"), F.col("all_p")).alias("value"))
    else:
        pts = roc_points(scores, by, thin=kind == "fpr")
        if kind == "f1_optimal":
            value = _f1(F.col("tp"), F.col("fp"), F.col("all_p"))
        elif kind == "youden_j":
            value = F.col("tpr") - F.col("fpr")
        else:
            value = -F.col("threshold")
            pts = pts.filter(F.col("fpr") <= target)
        best = pts.groupBy(*by).agg(F.max(F.struct(value.alias("v"), F.col("threshold").alias("t"), F.col("tpr").alias("r"))).alias("best"))
        got = best.select(*by, F.col("best.t").alias("t"), (F.col("best.r") if kind == "fpr" else F.col("best.v")).alias("value"))
        if kind == "youden_j":
            # the start of the curve (no row predicted) has J = 0 and no finite threshold
            got = got.withColumn("t", F.when(F.col("value") > 0, F.col("t"))).withColumn("value", F.greatest("value", F.lit(0.0)))
    joined = fallback.join(got, list(by), "left") if by else fallback.join(got, F.lit(True), "left")
    single = F.col("hi") == F.col("lo")
    return joined.select(*by, F.when(single, F.col("p95")).otherwise(F.coalesce("t", "p95")).alias("threshold"), F.when(single, 0.0).otherwise(F.coalesce("value", F.lit(0.0))).alias("value"))


def confusion(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp and the rates at each group's threshold (score >= threshold is positive)."""
    t = thresholds.select(*by, "threshold")
    rows = scores.join(t, list(by)) if by else scores.join(t, F.lit(True))
    hit, pos = F.col("score") >= F.col("threshold"), F.col("y") == 1
    n = lambda c: F.sum(c.cast("long") * _weight(scores))
    c = rows.groupBy(*by, "threshold").agg(n(~hit & ~pos).alias("tn"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"), n(hit & pos).alias("tp"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select(
        *by, "threshold", "tn", "fp", "fn", "tp",
        zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), zero(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        (F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))).alias("fpr"), (F.col("fn") / F.greatest(F.col("fn") + F.col("tp"), F.lit(1))).alias("fnr"),
    )


def evaluate(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """auroc, auprc and everything at the threshold."""
    a, c = auc(scores, by), confusion(scores, thresholds, by)
    return a.join(c, list(by)) if by else a.join(c, F.lit(True))


def per_class(scores: DataFrame, threshold_value: float | None = None, least: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Each attack label against the benign rows; classes with fewer than least rows in all are
    left out.  Without a threshold F1 is optimised on these very rows (threshold_source 'test').

    Benign rows are combined by score before each class meets them: what is repeated is a row per
    distinct benign score, not a row per window.
    """
    key = [*by, "attack_type"]
    hot = F.upper("label") != BENIGN
    attack = scores.filter(hot).groupBy(*by, F.col("label").alias("attack_type"), "score").agg(F.count("*").alias("w")).withColumn("y", F.lit(1))
    calm = scores.filter(~hot).groupBy(*by, "score").agg(F.count("*").alias("w")).withColumn("y", F.lit(0))
    kinds = attack.select(*key).distinct()  # a row per class
    benign = calm.join(kinds, list(by)) if by else calm.join(kinds, F.lit(True))
    rows = benign.select(*key, "score", "w", "y").unionByName(attack.select(*key, "score", "w", "y"))
    size = rows.groupBy(*key).agg(F.sum("w").alias("all"), F.sum(F.col("w") * F.col("y")).alias("n_samples")).filter((F.col("all") >= least) & (F.col("n_samples") > 0))
    rows = rows.join(size.select(*key), key)
    t = threshold(rows, "f1", key) if threshold_value is None else size.select(*key, F.lit(float(threshold_value)).alias("threshold"))
    return size.select(*key, "n_samples").join(evaluate(rows, t, key), key).withColumn("threshold_source", F.lit("test" if threshold_value is None else "given"))


def normalised_confusion(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c = confusion(scores, thresholds, by)
    share = lambda a, b: (F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))).alias(f"{a}_share")
    return c.select(*by, share("tn", "fp"), share("fp", "tn"), share("fn", "tp"), share("tp", "fn"))


def histogram(scores: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    cell = F.greatest(F.lit(1), F.least(F.lit(bins), F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)))).cast("int")
    return scores.groupBy(*by, cell.alias("cell")).agg(F.count("*").alias("n"))
