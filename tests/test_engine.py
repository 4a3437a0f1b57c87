"""Numerics, edge cases and invariants of the engine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrain.config import Spectral
from fluxgrain.operators import detectors, ensemble, metrics, scaling, spectral, splits, timeseries
from fluxgrain.sources import flows, store


def series(spark, values, name="flow_count"):
    return spark.createDataFrame([(0, i, float(v) if v is not None else None) for i, v in enumerate(values)], f"series int, bin_idx long, {name} double").withColumn("bin_ts", F.timestamp_seconds("bin_idx").cast("timestamp_ntz"))


@pytest.mark.parametrize("n", [8, 9, 64])
def test_psd_equals_fft(spark, n):
    x = np.random.default_rng(0).poisson(5, 2 * n).astype(float)
    win = timeseries.windows(series(spark, x), n, n, ["flow_count"])
    w = np.array(spectral.coefficients(n))
    for made in (spectral.psd(win, ["flow_count"], n), spectral.psd_arrow(win, ["flow_count"], n)):
        rows = {r["win"]: np.array(r["psd"]) for r in made.collect()}
        assert set(rows) == {0, 1}
        for k in rows:
            p = np.abs(np.fft.rfft(x[k * n : (k + 1) * n] * w)) ** 2 / n
            p[1 : -1 if n % 2 == 0 else None] *= 2
            np.testing.assert_allclose(rows[k], p, rtol=1e-9, atol=1e-9)


def test_fast_windows_without_a_slow_one_stay(spark):
    cfg = Spectral(window=8, overlap=4, channels=("flow_count",), deltas=False, slow_window=32)
    both = series(spark, range(16)).unionByName(series(spark, range(40)).withColumn("series", F.lit(1)))
    rows = spectral.multiscale_matrix(both, cfg).toPandas()
    assert rows.groupby("series").size().to_dict() == {0: 3, 1: 9}
    slow = rows.filter(like="slow__").notna().all(axis=1)
    assert rows.filter(like="fast__").notna().all(axis=None) and (slow == (rows["series"] == 1)).all()


@pytest.mark.parametrize("t,w,hop", [(10, 4, 2), (11, 4, 3), (4, 4, 1), (3, 4, 1), (12, 5, 7)])
def test_hopping_windows(spark, t, w, hop):
    got = sorted((r["win"], r["j"], r["flow_count"]) for r in timeseries.windows(series(spark, range(t)), w, hop, ["flow_count"]).collect())
    assert got == [(k, j, float(k * hop + j)) for k in range((t - w) // hop + 1 if t >= w else 0) for j in range(w)]


def test_dead_windows_are_zero(spark):
    win = timeseries.windows(series(spark, [float("nan")] * 8 + [0.0] * 8), 8, 8, ["flow_count"])
    out = spectral.describe(spectral.psd(win, ["flow_count"], 8), 8, 1.0).toPandas()
    assert np.isfinite(out.drop(columns=["series", "win", "channel"]).to_numpy(float)).all()
    assert (out[out.win == 0].drop(columns=["series", "win", "channel"]).to_numpy(float) == 0).all()


def test_feature_names_match_columns(spark):
    cfg = Spectral(window=8, overlap=4, channels=("flow_count", "absent"))
    made = spectral.feature_matrix(series(spark, range(16)), cfg)
    assert made.columns == ["series", "win", *spectral.feature_names(cfg)]


def test_empty_bins_become_zero(spark):
    df = spark.sql("SELECT timestamp_ntz'2020-01-01 00:00:10' ts, 1D total_bytes, 1D total_packets, 2D duration UNION ALL SELECT timestamp_ntz'2020-01-01 00:00:40', 3D, 1D, 4D UNION ALL SELECT NULL, 1D, 1D, 1D")
    got = [(r["bin_idx"], r["flow_count"], r["total_bytes"]) for r in timeseries.flow_series(df, seconds=7).orderBy("bin_idx").collect()]
    assert got == [(0, 1.0, 1.0), (1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 1.0, 3.0)]


def test_csv_scan(spark, tmp_path):
    (tmp_path / "Monday-a.csv").write_text(" Flow Duration, Label ,Timestamp,Other\n1,benign,3/7/2017 8:01,x\nbad, Web Attack XSS ,nonsense,y\n")
    rows = flows.read_cicids(spark, str(tmp_path)).orderBy("Flow Duration").collect()
    assert [(r["Flow Duration"], r["Label"], r["day"]) for r in rows] == [(0.0, "WEB ATTACK XSS", "Monday"), (1.0, "BENIGN", "Monday")]
    assert rows[0]["Timestamp"] is None and str(rows[1]["Timestamp"]) == "2017-07-03 08:01:00"


def scores(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")


def test_metrics_by_brute_force(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 60), np.round(rng.random(60), 1)
    a = metrics.auc(scores(spark, y, s)).first()
    pairs = [(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]]
    assert abs(a["auroc"] - np.mean(pairs)) < 1e-12
    t = metrics.threshold(scores(spark, y, s), "f1").first()
    f1 = {v: 2 * ((s >= v) & (y == 1)).sum() / ((s >= v).sum() + y.sum()) for v in set(s)}
    assert abs(t["value"] - max(f1.values())) < 1e-12 and t["threshold"] == max(v for v in f1 if f1[v] == max(f1.values()))
    t = metrics.threshold(scores(spark, y, s), "fpr_0.2").first()["threshold"]
    assert ((s >= t) & (y == 0)).sum() / (y == 0).sum() <= 0.2


def test_single_class(spark):
    t = metrics.threshold(scores(spark, [0] * 20, np.linspace(0, 1, 20)), "f1_optimal").first()
    assert abs(t["threshold"] - 0.95) < 1e-9 and t["value"] == 0.0
    assert metrics.auc(scores(spark, [0, 0], [1, 2])).first()["auroc"] is None


def test_scaler_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(9)], "a double, b double")
    s = scaling.fit_scaler(df, ["a", "b"])
    store.save_scaler(s, str(tmp_path / "s"))
    back = store.load_scaler(spark, str(tmp_path / "s"), ["a", "b"])
    assert {r["feature"]: (r["center"], r["scale"]) for r in back.collect()} == {"a": (4.0, 4.0), "b": (5.0, 1.0)}
    with pytest.raises(ValueError):
        store.load_scaler(spark, str(tmp_path / "s"), ["b", "a"])


def test_split_is_disjoint(spark):
    rows = spark.createDataFrame([(0, i, int(i >= 20), "BENIGN" if i < 20 else "DDOS") for i in range(30)], "series int, win long, y int, label string")
    out = splits.disjoint_split(rows)
    assert splits.overlap(out) == 0 and out.count() == 30 and out.filter("split = 'train' AND y = 1").count() == 0


def test_detectors_rank_outliers_first(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(200, 3)), rng.normal(8, 0.1, size=(5, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    f, train = ["a", "b", "c"], df.filter("id < 200")
    made = {
        "ecod": detectors.tail_scores(df, ["id"], f), "copod": detectors.tail_scores(df, ["id"], f, "copod"), "hbos": detectors.hbos_scores(train, df, ["id"], f), "inductive": detectors.inductive_tail_scores(train, df, ["id"], f),
        **{k: detectors.score_batches(df, ["id"], f, m.fit(x[:200])) for k, m in (("if", detectors.IsolationForest(50, 128)), ("vae", detectors.VariationalAutoencoder((16, 8), 2, epochs=30, batch=32)), ("svdd", detectors.DeepSvdd(8, 3, 10, 10, 32)))},
    }
    for name, out in made.items():
        best = {r["id"] for r in out.orderBy(F.desc("raw")).limit(5).collect()}
        assert len(best & set(range(200, 205))) >= 4, name


def test_blend_and_weights(spark):
    df = spark.createDataFrame([(0, 0, "a", 0.2), (0, 0, "b", 0.6)], "series int, win int, model string, score double")
    assert abs(ensemble.blend(df, {"a": 3, "b": 1, "c": 5}).first()["score"] - 0.3) < 1e-12
    assert len(list(ensemble.compositions(3, 4))) == 15
    with pytest.raises(ValueError):
        ensemble.blend(df, {"a": 0.0})


def test_streaming_windows_equal_batch(spark, tmp_path):
    from fluxgrain.streaming import windows as sw

    rows = [(0, i) for i in range(23) if i not in (5, 6)]
    spark.createDataFrame(rows, "series int, sec long").select("series", F.timestamp_seconds("sec").alias("bin_ts"), F.lit(1.0).alias("flow_count")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series int, bin_ts timestamp, flow_count double").parquet(str(tmp_path / "in"))
    q = sw.stream_windows(stream, 1, 8, 4, ["flow_count"]).writeStream.format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["win"]: list(r["flow_count"]) for r in spark.table("w").collect()}
    x = [float(i not in (5, 6)) for i in range(23)]
    assert got == {k: x[4 * k : 4 * k + 8] for k in range(4)}


def test_tuned_merge():
    assert store.merge_tuned({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 1}
    assert store.fingerprint({"b": 1, "a": 2}) == store.fingerprint({"a": 2, "b": 1})
