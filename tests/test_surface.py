"""Sources, kept models, tuning, thresholds and commands: behaviour that queries don't reach."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrain import __main__ as command
from fluxgrain import config
from fluxgrain.config import Evaluation, Spectral
from fluxgrain.operators import detectors, fitted, metrics, networks, ranks, scaling, splits
from fluxgrain.plans import pipeline, tuning
from fluxgrain.sources import flows, scratch, store

CFG = Spectral(bin_seconds=1, window=8, overlap=4)


def scores(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")


def fpr_threshold(y, s, most):
    """The lowest threshold of the curve's corners with at most that share of false alarms; p95 without any."""
    values = sorted(set(s.tolist()), reverse=True)
    points = [(int(((s >= v) & (y == 0)).sum()), int(((s >= v) & (y == 1)).sum()), v) for v in values]
    steps = [(0, 0, None), *points]
    corner = [k in (0, len(points) - 1) or (points[k][0] - steps[k][0], points[k][1] - steps[k][1]) != (points[k + 1][0] - points[k][0], points[k + 1][1] - points[k][1]) for k in range(len(points))]
    best, found = float(np.percentile(s, 95)), 0.0
    for keep, (fp, tp, v) in zip(corner, points):
        if keep and fp / (y == 0).sum() <= most:
            best, found = v, tp / (y == 1).sum()
    return best, found


@pytest.mark.parametrize("seed", range(4))
def test_threshold_at_a_false_alarm_rate(spark, seed):
    rng = np.random.default_rng(seed)
    y, s = rng.integers(0, 2, 50), np.round(rng.random(50), 2 - seed % 2)
    for most in (0.01, 0.05, 0.3):
        got = metrics.threshold(scores(spark, y, s), f"fpr_{most}").first()
        assert (got["threshold"], got["value"]) == pytest.approx(fpr_threshold(y, s, most))
    # the first point stays though the steps around it are equal: one alarm of twenty
    y, s = np.r_[np.zeros(20, int), np.ones(5, int)], np.r_[0.9, 0.8, np.full(18, 0.1), np.full(5, 0.05)]
    assert metrics.threshold(scores(spark, y, s), "fpr_0.05").first()["threshold"] == 0.9


def test_running_sums_with_hot_values(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(x)) for g, x in zip(rng.integers(0, 3, 3000), np.round(rng.normal(size=3000), 2))] + [(0, 0.5)] * 2000
    df = spark.createDataFrame(rows, "g int, x double")
    got = {(r["g"], r["x"]): (r["c"], r["run_c"], r["all_c"]) for r in ranks.counted(df, ["g"], "x").collect()}
    for g in range(3):
        mine = np.array([x for k, x in rows if k == g])
        for x in set(mine.tolist()):
            assert got[g, x] == ((mine == x).sum(), (mine <= x).sum(), len(mine))
    q = {r["g"]: r["q"] for r in ranks.percentiles(df, ["g"], "x", [0.05, 0.5, 0.95]).collect()}
    for g in range(3):
        assert q[g] == pytest.approx(np.percentile([x for k, x in rows if k == g], [5, 50, 95]))
    assert ranks.percentiles(df.limit(0), [], "x", [0.5]).count() == 0


def test_places(spark):
    rows = spark.createDataFrame([(s, w) for s in (2, 0, 1) for w in range(7 * s + 1)], "series int, win long")
    got = sorted((r["place"], r["series"], r["win"], r["many"]) for r in ranks.places(rows, "win").collect())
    want = sorted((s, w) for s in (0, 1, 2) for w in range(7 * s + 1))
    assert got == [(k, s, w, len(want)) for k, (s, w) in enumerate(want)]
    split = splits.day_split(rows.withColumns({"y": F.lit(0), "label": F.lit("BENIGN")}), rows.withColumns({"y": F.lit(1), "label": F.lit("DDOS")}))
    assert split.groupBy("split").count().count() == 3


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "Monday-a.csv").write_text(" Flow Duration, Label ,Timestamp\n1,benign,3/7/2017 8:01\n")
    (tmp_path / "Friday-b.csv").write_text("Label,Timestamp,Total Fwd Packets, Flow Duration\nDDoS,7/7/2017 9:30,4,20\n")
    rows = {r["day"]: r for r in flows.read_cicids(spark, str(tmp_path)).collect()}
    assert rows["Friday"]["Label"] == "DDOS" and rows["Friday"]["Flow Duration"] == 20.0 and str(rows["Friday"]["Timestamp"]) == "2017-07-07 09:30:00"
    assert rows["Monday"]["Flow Duration"] == 1.0 and rows["Monday"]["Total Fwd Packets"] is None
    assert [r["day"] for r in flows.read_cicids(spark, str(tmp_path), ["Monday"]).collect()] == ["Monday"]
    assert flows.read_cicids(spark, str(tmp_path), ["Sunday"]).count() == 2
    with pytest.raises(FileNotFoundError):
        flows.read_cicids(spark, str(tmp_path / "none"))


def test_cache_follows_the_files(spark, tmp_path):
    a, cache = tmp_path / "Monday-a.csv", str(tmp_path / "cache")
    a.write_text("Flow Duration,Label\n1,benign\n")
    (tmp_path / "Friday-b.csv").write_text("Flow Duration,Label\n2,x\n")
    assert flows.read_cicids(spark, str(tmp_path), ["Monday"], cache).count() == 1
    assert flows.read_cicids(spark, str(tmp_path), None, cache).count() == 2
    a.write_text("Flow Duration,Label\n1,benign\n3,benign\n")
    os.utime(a, (time.time() + 60, time.time() + 60))
    assert flows.read_cicids(spark, str(tmp_path), None, cache).count() == 3


def test_unsw_files(spark, tmp_path):
    (tmp_path / "UNSW_features.csv").write_text("No.,Name\n1,srcip\n")
    (tmp_path / "a.csv").write_text("srcip, dur,Sbytes,attack_cat,Label\n1.1.1.1,0.5,,Fuzzers,1\n")
    (tmp_path / "b.csv").write_text("2.2.2.2,1.5,7,,0\n")
    rows = flows.read_unsw(spark, str(tmp_path), names=["srcip", "dur", "sbytes", "attack_cat", "label"]).orderBy("src_ip").collect()
    assert [(r["src_ip"], r["Flow Duration"], r["Total Length of Fwd Packets"], r["label"]) for r in rows] == [("1.1.1.1", 0.5, 0.0, 1), ("2.2.2.2", 1.5, 7.0, 0)]


def test_columns_and_days(spark, tmp_path):
    df = flows.sample_flows(spark, 200)
    assert len([f for f in df.schema.fields if f.dataType.simpleString() == "double"]) == 76
    assert flows.feature_columns(df) == ["Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets"]
    assert flows.feature_columns(df, ["absent"], most=2) == ["Flow Duration", "Total Fwd Packets"]
    assert list(flows.by_day(df)) == ["Monday"] and flows.day_against_rest(df)[1].count() == 0
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (2.0,)], "x double")
    assert [r["x"] for r in flows.finite_or_zero(odd, ["x"]).collect()] == [0.0, 0.0, 0.0, 2.0]
    with pytest.raises(ValueError):
        flows.load(spark, "unsw")
    flows.write_sample(spark, str(tmp_path / "Monday"), 50)
    back = flows.read_cicids(spark, str(tmp_path / "Monday"))
    assert back.count() == 50 and back.filter("Timestamp IS NULL").count() == 0


def test_sample_has_one_burst(spark):
    rows = flows.sample_flows(spark, 1000).orderBy("flow_id").collect()
    bad = [k for k, r in enumerate(rows) if r["Label"] != "BENIGN"]
    assert bad == list(range(400, 600)) and len({rows[k]["Label"] for k in bad}) == 7
    ratio = np.mean([rows[k]["Flow Duration"] for k in bad]) / np.mean([r["Flow Duration"] for r in rows[:400]])
    assert 3.5 < ratio < 6.5
    assert rows == flows.sample_flows(spark, 1000).orderBy("flow_id").collect()


def brute_depths(forest, x):
    """Mean path length over trees, one row and tree at a time."""
    out = []
    for row in x:
        total = 0.0
        for feature, cut, left, right, depth in forest.forest:
            node = 0
            while feature[node] >= 0:
                node = int(left[node] if row[int(feature[node])] < cut[node] else right[node])
            total += depth[node]
        out.append(2.0 ** (-total / len(forest.forest) / forest._norm(forest.size)))
    return np.array(out)


def test_forest_by_brute_force():
    x = np.random.default_rng(0).normal(size=(300, 4))
    forest = detectors.IsolationForest(20, 64, share=0.5).fit(x)
    assert np.allclose(forest.raw(x[:40]), brute_depths(forest, x[:40]))
    for feature, *_ in forest.forest:
        assert len({int(f) for f in feature if f >= 0}) <= 2


class Still:
    def random(self, shape):
        return np.ones(shape)


def test_autoencoder_gradients_by_differences():
    rng = np.random.default_rng(0)
    x, eps = rng.normal(size=(30, 6)), rng.normal(size=(30, 3))
    model = networks.VariationalAutoencoder(hidden=(8, 5), latent=3, dropout=0.0)
    model._create(rng, 6)
    grads = model.gradients(x, eps, 0.7, Still())[1]
    for name, values in model.p.items():
        flat = values.reshape(-1)
        for i in range(min(4, len(flat))):
            was = flat[i]
            flat[i] = was + 1e-6
            up = model.gradients(x, eps, 0.7, Still())[0]
            flat[i] = was - 1e-6
            down = model.gradients(x, eps, 0.7, Still())[0]
            flat[i] = was
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5), name


def test_networks_know_their_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[:, 4:] = 2 * x[:, :4]
    odd = rng.normal(size=(40, 8)) * 2
    for model in (networks.VariationalAutoencoder((32, 16), 4), networks.DeepSvdd(16, 4, 20, 20)):
        model.fit(x)
        assert np.median(model.raw(odd)) > 1.5 * np.median(model.raw(x)) and len(model.raw(odd[:0])) == 0


def test_kept_detectors_score_the_same(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(0, i, int(i >= 110), *map(float, rng.normal(3 * (i >= 110), 1, 3))) for i in range(120)]
    df = spark.createDataFrame(rows, "series int, win long, y int, a double, b double, c double")
    train, names = df.filter("win < 80"), ["a", "b", "c"]
    settings = {"iforest": {"trees": 10, "samples": 32}, "vae": {"hidden": (8,), "latent": 2, "epochs": 3, "batch": 16}, "svdd": {"hidden": 4, "latent": 2, "pretrain": 2, "epochs": 2}, "hbos": {"bins": 5}}
    models = ("ecod", "copod", "hbos", "iforest", "vae", "svdd")
    made = fitted.Ensemble({m: fitted.create(m, **settings.get(m, {})) for m in models}, {m: k + 1.0 for k, m in enumerate(models)}).fit(train, names, df.filter("win >= 80"))
    made.save(spark, str(tmp_path / "e"))
    back = fitted.Ensemble.load(spark, str(tmp_path / "e"))
    rest = df.filter("win >= 80")
    one, two = ({(r["win"], r["model"]): r["score"] for r in e.scores(rest).collect()} for e in (made, back))
    assert one.keys() == two.keys() and len(one) == 40 * 6 and all(one[k] == pytest.approx(two[k]) for k in one)
    assert back.weights == made.weights and back.score(rest).count() == 40
    assert back.detectors["ecod"].predict(rest, 0.9).filter("predicted = 1").count() > 0
    with pytest.raises(ValueError):
        fitted.create("other")


def day(spark, n, attacks, start="2017-07-03 08:00:00"):
    rows = [(i, 5.0 if i in attacks else 1.0, "DDOS" if i in attacks else "BENIGN") for i in range(n)]
    base = spark.createDataFrame(rows, "event_id long, k double, label string")
    noise = lambda s: F.pmod(F.xxhash64("event_id", F.lit(s)), F.lit(100)) / 100.0
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("event_id")).cast("timestamp_ntz")
    return base.select("event_id", at.alias("ts"), (F.col("k") * (500 + 100 * noise(1))).alias("total_bytes"), (F.col("k") * (10 + noise(2))).alias("total_packets"), (F.col("k") * (1e6 + 1e5 * noise(3))).alias("duration"), "label")


@pytest.fixture(scope="module")
def two_days(spark):
    return day(spark, 300, set()), day(spark, 200, set(range(80, 140)), "2017-07-07 08:00:00")


@pytest.fixture(scope="module")
def prepared(two_days):
    return pipeline.prepare(*two_days, CFG)


def test_pipeline_finds_the_burst(spark, two_days, prepared):
    fit = pipeline.fit_ensemble(prepared, ("ecod", "hbos"))
    all_ = pipeline.score_all(prepared, fit)
    table = {r["model"]: r for r in pipeline.evaluate_models(all_).collect()}
    assert set(table) == {"ecod", "hbos", "ensemble"} and table["ensemble"]["auroc"] > 0.9
    methods = [r["threshold_method"] for r in pipeline.evaluate_methods(all_, ("f1", "youden_j", "fpr_0.05", "percentile_95")).collect()]
    assert methods == ["f1", "youden_j", "fpr_0.05", "percentile_95"]
    windows = pipeline.fusion_windows(*two_days, all_, CFG)
    assert windows.count() == all_.filter("model = 'ensemble'").count() and windows.filter("flow_score NOT BETWEEN 0 AND 1").count() == 0
    assert {r["weight"] for r in pipeline.fusion_ablation(windows, (0.0, 0.3)).collect()} == {0.0, 0.3}
    assert pipeline.prepare(*two_days, CFG, exclude=["ddos"]).split.filter("label = 'DDOS'").count() == 0
    multi = Spectral(bin_seconds=1, window=8, overlap=4, slow_window=32)
    assert any(n.startswith("slow__") for n in pipeline.prepare(*two_days, multi, multiscale=True).names)


def test_spectral_against_raw(two_days, prepared):
    rows = pipeline.compare_feature_sets({"spectral": prepared, "raw": pipeline.raw_prepared(*two_days, CFG)}, ("ecod",)).collect()
    assert {(r["features"], r["model"]) for r in rows} == {("spectral", "ecod"), ("raw", "ecod")}


def test_tuning(two_days, prepared):
    found = tuning.tune(prepared, ("hbos", "ecod"), {"hbos": {"bins": (5, 10)}}, step=0.5)
    assert len(found["tried"]) == 3 and abs(sum(found["weights"].values()) - 1) < 1e-9
    best = max(r["val_auroc"] for r in found["tried"] if r["model"] == "hbos")
    assert next(r["bins"] for r in found["tried"] if r["model"] == "hbos" and r["val_auroc"] == best) == found["settings"]["hbos"]["bins"]
    both = tuning.dual_evaluation(*two_days, CFG, Evaluation(), ("ecod",))
    assert set(both) == {"majority", "any"} and both["any"]["models"].count() == 2
    assert [len(tuning.settings_of(g)) for g in tuning.GRIDS.values()] == [16, 8, 3, 1, 1]


def test_commands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark.__class__, "stop", lambda self: None)
    settings = tmp_path / "c.yaml"
    settings.write_text("spectral:\n  window_size: 16\n  overlap: 8\nmodels:\n  ensemble:\n    weights: {ecod: 1.0, hbos: 1.0, isolation_forest: 0.0}\nevaluation:\n  threshold_methods: [f1_optimal]\n")
    out = str(tmp_path / "out")
    command.main(["evaluate", "--sample", "--rows", "1500", "--config", str(settings), "--out", out])
    first = spark.read.option("header", True).csv(f"{out}/metrics/model_comparison").collect()
    command.main(["evaluate", "--sample", "--rows", "1500", "--config", str(settings), "--out", out, "--skip-train", "--threshold", "youden_j"])
    again = spark.read.option("header", True).csv(f"{out}/metrics/model_comparison").collect()
    assert {r["model"]: r["auroc"] for r in first} == {r["model"]: r["auroc"] for r in again} and len(first) == 3
    command.main(["sample", "--rows", "20", "--out", str(tmp_path / "s")])
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 20
    with pytest.raises(SystemExit):
        command.main(["tune"])


def test_settings():
    cfg, ev, weights = config.from_settings({"spectral": {"window_size": 32, "multi_scale": {"slow_window_size": 128}}, "evaluation": {"window_label_rule": "any"}})
    assert (cfg.window, cfg.slow_window, ev.rule, weights) == (32, 128, "any", {"ecod": 0.7, "iforest": 0.3})
    assert Spectral().channels == ("total_bytes", "total_packets", "mean_duration")


def test_spectra_of_many_bins_are_quick(spark):
    """10,000 bins, three channels, windows of 64: under five seconds."""
    from fluxgrain.operators import spectral

    series = spark.range(10_000).select(F.lit(0).alias("series"), F.col("id").alias("bin_idx"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("bin_ts"), *[F.rand(k).alias(c) for k, c in enumerate(Spectral().channels)])
    cfg = Spectral(window=64, overlap=0)
    spectral.feature_matrix(series.limit(200), cfg).count()
    began = time.time()
    assert spectral.feature_matrix(series, cfg).write.format("noop").mode("overwrite").save() is None
    assert time.time() - began < 5


def test_scratch_tables(spark, tmp_path):
    kept = scratch.keep(spark.range(5), "t")
    path = scratch._PATHS[kept]
    assert kept.count() == 5 and store.exists(spark, path)
    scratch.release(kept, spark.range(1))
    assert not store.exists(spark, path)
    store.write_text(spark, str(tmp_path / "a.json"), json.dumps({"k": "é"}))
    assert json.loads(store.read_text(spark, str(tmp_path / "a.json"))) == {"k": "é"}


def test_bounds_follow_benign_rows(spark):
    rows = [("m", int(i % 4 == 0), float(i)) for i in range(40)] + [("flat", 0, 1.0)] * 3 + [("bad", 1, float(i)) for i in range(5)]
    got = {r["model"]: (r["low"], r["high"]) for r in scaling.bounds(spark.createDataFrame(rows, "model string, y int, raw double")).collect()}
    benign = [float(i) for i in range(40) if i % 4]
    assert got["m"] == pytest.approx(tuple(np.percentile(benign, [5, 95]))) and got["flat"] == pytest.approx((1.0, 1.000001)) and got["bad"] == pytest.approx((0.2, 3.8))
