"""Hand-computed fixtures and properties of the operators."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regimera.functions.columns import a_spectral_features, a_time_features
from regimera.functions.spectrum import with_magnitudes
from regimera.operators import causal, cluster, consensus, density, features, metrics, physics, retrieval, temporal, windows
from regimera.plans import catalog, runs
from regimera.sources import params, signals, store
from regimera.streaming import windows as streaming


def seq(spark, modes, unit=1):
    return spark.createDataFrame([(unit, i, m) for i, m in enumerate(modes)], "unit_id int, t int, mode int")


def test_time_features(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0, -4.0, 5.0, -6.0, 7.0, -8.0],), ([0.0] * 8,)], "x array<double>")
    found = a_time_features(F.col("x"))
    a, b = df.select(*[v.alias(k) for k, v in found.items()]).collect()
    want = dict(rms=5.0497524692, peak=8, crest_factor=1.5842360688, skewness=0, kurtosis=-1.3396725811, mean=-0.5, variance=25.25, range=15, iqr=8, zero_crossing_rate=0.875, autocorrelation_lag1=-0.9964984051)
    for k, v in want.items():
        assert a[k] == pytest.approx(v, abs=1e-9), k
    assert b["crest_factor"] == 0 and b["autocorrelation_lag1"] == 0 and b["skewness"] is None


def test_spectral_features(spark):
    df = with_magnitudes(spark.createDataFrame([([1.0, -2.0, 3.0, -4.0, 5.0, -6.0, 7.0, -8.0],), ([0.0] * 8,)], "x array<double>"), "x")
    a, b = df.select(*[v.alias(k) for k, v in a_spectral_features(F.col("mag"), 8.0, F.size("x")).items()]).collect()
    assert a["dominant_freq"] == 4 and a["spectral_centroid"] == pytest.approx(3.8423830137) and a["spectral_entropy"] == pytest.approx(0.6317414321)
    assert [a[f"harmonic_{i}_freq"] for i in range(4)] == [4, 3, 2, 1] and a["harmonic_0_mag"] == pytest.approx(36) and a["harmonic_4_mag"] == 0
    assert all(v == 0 for v in b.asDict().values())


def test_rolling_and_windows(spark):
    df = spark.createDataFrame([(1, i, v, v) for i, v in enumerate([1.0, 2.0, 4.0, 9.0, 16.0])], "unit_id int, cycle int, a double, b double")
    r = features.rolling(df, ["unit_id"], "cycle", {"m": ["a", "b"]}, size=5).first()
    assert (r["cycle"], r["m_a_mean"], r["m_a_range"], r["m_a_iqr"]) == (2, 6.4, 15, 7)
    assert r["m_a_std"] == pytest.approx(5.5353410012) and r["m_a_slope"] == pytest.approx(3.7) and r["m_avg_intra_correlation"] == pytest.approx(1)
    long = spark.createDataFrame([(2, i, 0.0, 1.0) for i in range(31)], df.schema)
    assert [x["cycle"] for x in features.rolling(long, ["unit_id"], "cycle", {"m": ["a"]}).orderBy("cycle").collect()] == [15, 16]
    one = lambda n: windows.array_windows(spark.createDataFrame([([0.0] * n,)], "s array<double>"), "s", 500, 0.5)
    assert [x["start"] for x in one(1000).orderBy("window_id").collect()] == [0, 250, 500] and one(499).count() == 0


def test_preprocess(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 1, 2, 3, 100])], "i int, x double")
    got = [r["x"] for r in features.clip_outliers(features.zscore(df, ["x"]), ["x"]).orderBy("i").collect()]
    assert got == pytest.approx([-0.48111046, -0.45841657, -0.43572268, -0.41302879, -0.34494712], abs=1e-7)
    holes = spark.createDataFrame([(0, None), (1, 2.0), (2, float("nan")), (3, 6.0)], "i int, x double")
    assert [r["x"] for r in features.impute(holes, ["x"], ["i"]).orderBy("i").collect()] == [2, 2, 2, 6]
    w = windows.ordered(["u"], ["i"])
    line = holes.withColumn("u", F.lit(1)).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    assert [r["y"] for r in line.withColumn("y", windows.interpolate(F.col("x"), F.col("i").cast("double"), w)).orderBy("i").collect()] == [2, 2, 4, 6]


def test_transitions(spark):
    df = seq(spark, [0, 0, 0, 1, 1, 0, 2, 0, 0, 1])
    p = {(r["from_mode"], r["to_mode"]): r["p"] for r in temporal.transition_matrix(df, ["unit_id"], ["t"], "mode").collect()}
    assert p[0, 0] == 0.5 and p[0, 1] == pytest.approx(1 / 3) and p[2, 0] == 1 and p[1, 1] == 0.5
    assert temporal.transition_entropy(df, ["unit_id"], ["t"], "mode").first()[0] == pytest.approx(1.1754887502)
    assert temporal.stability_index(df, ["unit_id"], ["t"], "mode").first()[0] == pytest.approx(4 / 9)
    r = windows.run_lengths(df, ["unit_id"], ["t"], "mode").orderBy("run_id").collect()
    assert [(x["mode"], x["length"]) for x in r] == [(0, 3), (1, 2), (0, 1), (2, 1), (0, 2), (1, 1)]
    assert {x["mode"]: x["mean_length"] for x in temporal.mean_durations(df, ["unit_id"], ["t"], "mode").collect()} == {0: 2.0, 1: 1.5, 2: 1.0}
    assert temporal.top_sequences(df, ["unit_id"], ["t"], "mode").count() == 4
    assert windows.run_lengths(df.limit(0), ["unit_id"], ["t"], "mode").count() == 0


def test_degradation(spark):
    risk = F.when(F.col("mode") == 0, 0.2).otherwise(0.6)
    df = seq(spark, [0, 0, 0, 1, 1, 0]).withColumn("risk", risk)
    r = temporal.degradation(df, ["unit_id"], ["t"], "mode", "risk", 5, 3).first()
    assert r["entropy"] == pytest.approx(0.6730116668, abs=1e-6) and r["imdti"] == pytest.approx(0.4331504048, abs=1e-6) and r["dominant_mode"] == 0
    calm = seq(spark, [0] * 6).withColumn("risk", F.lit(0.0))
    assert temporal.degradation(calm, ["unit_id"], ["t"], "mode", "risk", 5, 1).first()["imdti"] == pytest.approx(-0.25)
    assert temporal.degradation(calm, ["unit_id"], ["t"], "mode", "risk", 5, 1, clipped=True, high=0.6).first()["imdti"] == 0
    path = lambda u, n, f: [(u, i, float(f(i))) for i in range(n)]
    t = spark.createDataFrame(path(1, 9, lambda i: i) + path(2, 60, lambda i: i / 200) + path(3, 12, lambda i: 0.5), "unit_id int, t int, imdti double")
    got = {r["unit_id"]: r for r in temporal.remaining_life(t, ["unit_id"]).collect()}
    assert got[1]["rul"] is None and got[3]["rul"] == math.inf and got[2]["rul"] == pytest.approx(170 - 59) and got[2]["degradation_rate"] == pytest.approx(1 / 200) and got[3]["degradation_rate"] == 0


def test_precedence(spark):
    rows = [("u1", 3, ["A"]), ("u1", 7, ["B", "A"]), ("u2", 2, ["A"]), ("u2", 4, ["B"]), ("u3", 1, [])]
    e = causal.precedence_edges(spark.createDataFrame(rows, "u string, c int, v array<string>"), "u", "c", "v", 0.6).collect()
    assert len(e) == 1 and (e[0]["a"], e[0]["b"], e[0]["mean_lead"], e[0]["std_lead"]) == ("A", "B", 3, 1)
    assert e[0]["support"] == pytest.approx(2 / 3) and e[0]["p10_lead"] == pytest.approx(2.2)


def test_consensus(spark):
    v = spark.createDataFrame([(1, "a", 0, 0.9), (1, "b", 0, 0.6), (2, "a", -1, 0.9), (2, "b", -1, 0.8), (3, "a", 1, 0.5), (3, "b", 2, 0.5)], "row_id int, modality string, label int, prob double")
    got = {r["row_id"]: r for r in consensus.arbitrate(v, ["a", "b"]).collect()}
    assert got[1]["winner"] == "a:0" and got[1]["conflict"] and got[1]["dominance"]["a"] == pytest.approx(0.6)
    assert got[2]["label"] == -1 and got[2]["conflict"] and got[2]["dominance"] == {"a": 0, "b": 0}
    assert got[3]["winner"] == "a:1"


def test_rules(spark):
    q = lambda **k: {a: float(b) for a, b in k.items()}
    rows = [
        (0, q(temperature=41, current=3.8, vibration_rms=0.1, correlation_I_T=0.6)), (1, q(temperature=41.3, current=3.8, correlation_I_T=0.6)),
        (2, q(temperature=20, vibration_rms=0.5, correlation_I_T=0.9)), (3, q(temperature=90, vibration_rms=0.5, correlation_I_T=0.1, thermal_rate=3)),
    ]
    got = {r["mode_id"]: r for r in physics.filter_modes(spark.createDataFrame(rows, "mode_id int, q map<string,double>"), params.MOTOR).collect()}
    assert got[0]["feasible"] and got[0]["label"] == "Normal Operation" and got[0]["risk_score"] > 0  # the risk has no tolerance
    assert not got[1]["feasible"] and got[1]["violated"] == ["joule_heating"]
    assert got[2]["feasible"] and got[2]["is_fault_state"] and got[2]["label"] == "Mechanical Imbalance / Bearing Wear"
    assert got[3]["label"] == "Complete System Degradation" and got[3]["risk_rank"] == 1 and got[3]["feasible"]
    e = physics.filter_modes(spark.createDataFrame([(0, q(Nf=2600, Nc=8000, T50=1400, correlation_fuel_T50=0.6))], "mode_id int, q map<string,double>"), params.TURBOFAN).first()
    assert not e["feasible"] and e["label"] == "Unknown State" and e["severity"] == "UNCLASSIFIED" and e["violated"] == ["speed_bounds"]
    with pytest.raises(ValueError):
        params.validate({"domain": "electromechanical"})
    assert not params.active(params.MOTOR, "joule_heating") and params.active(params.MOTOR, "cross_modal_coupling") and params.active(params.MOTOR, "other")


def test_distances(spark):
    d = lambda xs: spark.createDataFrame([(float(x), 0) for x in xs], "x double, m int")
    r = metrics.distribution_shift(d([0, 1, 3]), d([5, 6, 8]), ["x"]).first()
    assert r["wasserstein"] == pytest.approx(5) and r["ks"] == 1
    same = metrics.distribution_shift(d([1, 2, 2]), d([1, 2, 2]), ["x"], ranges=2).first()
    assert same["wasserstein"] == 0 and same["ks"] == 0
    assert metrics.mode_kl(d([1, 2]), d([3]), "m").first()[0] == pytest.approx(0, abs=1e-8)
    lab = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0), (-1, 0)], "a int, b int")
    r = metrics.agreement_scores(lab, "a", "b").first()
    assert r["nmi"] == pytest.approx(1) and r["ari"] == pytest.approx(1)
    assert metrics.agreement_scores(lab.limit(1), "a", "b").first()["nmi"] == 0


def test_retrieval(spark):
    lib = spark.createDataFrame([(i, {"a": x, "b": 1 - x}, f"L{i % 2}", "s", 0.1) for i, x in enumerate([0.1, 0.5, 0.9])], "entry_id long, vector_normalized map<string,double>, outcome_label string, dataset_source string, risk_score double")
    q = spark.createDataFrame([(0, {"a": 9.0, "c": 0.5})], "query_id int, vector map<string,double>")
    m = retrieval.matches(q, lib, 2).orderBy("rank").collect()
    assert [r["entry_id"] for r in m] == [2, 1]
    assert retrieval.predict(retrieval.matches(q, lib, 2)).first()["predicted"] == "L0"
    fp = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])], "mode_id int, fp array<double>")
    assert [r["mode_b"] for r in retrieval.align(fp, fp).collect()] == [1]


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 5), (0, 5))] + [rng.uniform(-20, 20, (5, 2))])
    labels, probs, outlier = density.hdbscan(x, 15, 5)
    for k in range(3):
        part = labels[40 * k : 40 * k + 40]
        assert np.bincount(part[part >= 0]).max() >= 36
    assert len(set(labels[labels >= 0])) == 3 and (labels[120:] == -1).sum() >= 4
    assert ((probs >= 0) & (probs <= 1)).all() and (probs[labels == -1] == 0).all() and ((outlier >= 0) & (outlier <= 1)).all()
    assert density.dbcv(x[:120], np.repeat([0, 1, 2], 40)) > 0.7 and math.isnan(density.dbcv(x, np.full(125, -1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    exact = {r["row_id"]: r["label"] for r in density.density_modes(df, "id", "v").collect()}
    assert [exact[i] for i in range(125)] == labels.tolist()
    some = density.density_modes(df, "id", "v", min_size=10, max_points=90)
    assert some.count() == 125


def test_refinement_and_samples(spark):
    rows = [(i, [float(i % 3) * 10 + i * 0.01, 0.0], i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>, mode int")
    c = metrics.centroids(df, "mode", "v").select(F.col("mode").alias("mode_id"), "centroid")
    merged = cluster.refine(df, "id", "v", "mode", c, [0], "merge")
    assert {r["refined"] for r in merged.collect()} == {1, 2}
    assert cluster.refine(df, "id", "v", "mode", c, [0, 1, 2], "merge").where("refined <> mode").count() == 0
    assert cluster.refine(df, "id", "v", "mode", c, [2], "fault").where("refined = -2").count() == 10
    assert {r["refined"] for r in cluster.refine(df, "id", "v", "mode", c, [1], "split").collect()} == {0, 2, 3, 4}
    with pytest.raises(ValueError):
        cluster.refine(df, "id", "v", "mode", c, [1], "other")
    made = cluster.bounded_samples(df.where("mode = 0"), "id", "v", 20, lambda v: F.get(v, 0) <= 0.2).collect()
    assert len(made) == 20 and all(r["v"][0] <= 0.2 for r in made if r["accepted"])
    assert cluster.bounded_samples(df.limit(1), "id", "v", 5, lambda v: F.lit(True)).count() == 0


def test_sources(spark, tmp_path):
    for folder, number, names in (("IR007", 105, ("X105_DE_time", "X105_FE_time")), ("Normal", 97, ("X097_DE_time",)), ("Other", 1, ("A_DE_time",)), ("Ball007", 118, ("X_FE_time",))):
        (tmp_path / "mat" / folder).mkdir(parents=True)
        (tmp_path / "mat" / folder / f"{number}.mat").write_bytes(signals.write_mat({n: np.arange(10.0) + i for i, n in enumerate(names)}))
    (tmp_path / "mat" / "IR007" / "broken.mat").write_bytes(b"not a file")
    got = {r["source_file"]: r for r in signals.vibration_signals(spark, str(tmp_path / "mat")).collect()}
    assert set(got) == {"105.mat", "97.mat"} and got["105.mat"]["load_hp"] == 0 and got["105.mat"]["fault_type"] == "inner_race"
    assert got["97.mat"]["fe"] == [0.0] * 10 and got["105.mat"]["fe"] == [float(i + 1) for i in range(10)]
    (tmp_path / "train_FD001.txt").write_text("\n".join("  ".join(map(str, [1, c, *range(24)])) + "  " for c in (1, 2)) + "\nshort line\n")
    t = signals.engine_cycles(spark, str(tmp_path)).collect()
    assert len(t) == 2 and t[0]["s1"] == 3.0 and t[1]["cycle"] == 2
    (tmp_path / "rul.txt").write_text("112\n98\n")
    assert {r["unit_id"]: r["rul"] for r in signals.remaining_life_labels(spark, str(tmp_path / "rul.txt")).collect()} == {1: 112, 2: 98}
    with pytest.raises(ValueError):
        signals.engine_cycles(spark, str(tmp_path), split="valid")


def test_library_and_report(spark, tmp_path):
    path = str(tmp_path / "library")
    assert store.load_library(spark, path).count() == 0
    modes = spark.createDataFrame([(1, {"a": 0.7, "b": 0.3}, "ok", 0.2)], "mode_id int, dominance map<string,double>, label string, risk_score double")
    for _ in range(2):
        store.append_library(retrieval.library_entries(modes, "s"), path)
    rows = store.load_library(spark, path).collect()
    assert len(rows) == 2 and rows[0]["conflict_vector"]["a"] == pytest.approx(0.3) and not rows[0]["confirmed"]
    store.write_report(spark.createDataFrame([("b", 2.0), ("a", 1.0)], "metric string, value double"), str(tmp_path / "report"))
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part*"))
    assert text.splitlines() == ["a: 1.0", "b: 2.0"]
    assert store.describe(modes).count() == 4
    curve = store.density_curve(spark.createDataFrame([(float(i),) for i in range(50)], "x double"), "x", 20).collect()
    assert len(curve) == 20 and all(r["density"] > 0 for r in curve)


def test_stream(spark, tmp_path):
    rows = [(u, c, float(c * c % 7 + u)) for u in (1, 2) for c in range(40)]
    df = spark.createDataFrame(rows, "unit_id long, cycle long, value double")
    for i, (a, b) in enumerate(((0, 15), (15, 40))):
        df.where(f"cycle >= {a} and cycle < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.rolling_stream(stream, 10).writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["unit_id"], r["cycle"]): r for r in spark.sql("select * from rolled").collect()}
    want = {(r["unit_id"], r["cycle"]): r for r in features.rolling(df, ["unit_id"], "cycle", {"s": ["value"]}, size=10).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert [got[k][s] for s in ("mean", "std", "slope", "range", "iqr")] == pytest.approx([r[f"s_value_{s}"] for s in ("mean", "std", "slope", "range", "iqr")])


def test_discovery_run(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *[float(x) for x in rng.normal((i % 2) * 3, 0.3, 4)]) for i in range(80)]
    columns = ["de_rms", "de_mean", "fe_rms", "fe_kurtosis"]
    joint = features.zscore(spark.createDataFrame(rows, ["row_id", *columns]), columns)
    run = runs.discover(joint, {"vibration_de": columns[:2], "vibration_fe": columns[2:]}, columns, "row_id", params.MOTOR, k_max=2, iterations=3)
    assert run.tables["votes"].count() == 80 and run.tables["refined"].count() == 80 and run.facts["components"] == 2
    filtered = run.tables["filtered"].collect()
    assert len(filtered) == 2 and all("DOMINANT" in r["label"].upper() for r in filtered)
    shares = run.tables["dominance"].groupBy("mode_id").agg(F.sum("dominance").alias("s")).collect()
    assert all(0 <= r["s"] <= 1 + 1e-9 for r in shares)
    assert {r["metric"] for r in runs.evaluate(run).collect()} >= {"silhouette", "noise_ratio", "coherence_rate"}
    assert runs.align_runs(run, run).count() >= 1


def test_vibration_features_of_signals(spark):
    rows = [("f", [math.sin(i / 3) for i in range(200)], [math.cos(i / 3) for i in range(200)])]
    both = windows.array_windows(spark.createDataFrame(rows, "source_file string, de array<double>, fe array<double>").withColumn("pair", F.arrays_zip("de", "fe")).drop("de", "fe"), "pair", 64, 0.5)
    wide = both.select("source_file", "window_id", F.col("pair.de").alias("de"), F.col("pair.fe").alias("fe"))
    got = features.vibration(wide, ["source_file", "window_id"], ["de", "fe"])
    assert len(got.columns) == 50 and got.count() == 5 and got.first()["de_rms"] == pytest.approx(0.7, abs=0.05)


def test_latency_harness(spark):
    out = runs.latency(lambda d: d.count(), spark.range(20).toDF("x"), rows=5, calls=3, sizes=(2, 4))
    assert out["mean_s"] > 0 and set(out["sizes"]) == {2, 4}


def test_engine_run(spark):
    rng = np.random.default_rng(0)
    names = [n for group in params.modality_columns(params.TURBOFAN).values() for n in group]
    rows = [(u, c, *[float(x) for x in rng.normal((c // 25) * 2, 1, len(names))]) for u in (1, 2, 3) for c in range(60)]
    run = runs.engine_run(spark.createDataFrame(rows, ["unit_id", "cycle", *names]), k_max=2, iterations=2, size=10)
    assert run.tables["features"].count() == 3 * 51 and run.tables["timeline"].count() == 3 * 51
    assert run.tables["trajectory"].count() == 3 * 41 and run.tables["remaining_life"].count() == 3
    assert run.tables["filtered"].count() == 2 and run.tables["precedence"].columns[:2] == ["a", "b"]


def test_registered_scans_try_all_counts_and_starts(spark, monkeypatch):
    for name, starts in (("kmeans_scan", 10), ("mixture_scan", 5)):
        asked = inspect.signature(getattr(cluster, name))

        def bound(*args, asked=asked, **kw):
            found = asked.bind(*args, **kw)
            found.apply_defaults()
            return found.arguments

        monkeypatch.setattr(cluster, name, bound)
        got = catalog.QUERIES["kmeans_scan" if name == "kmeans_scan" else "gmm_scan"](spark, "/root/testdata/sf0.001")
        assert got["k_max"] == 10 and got["restarts"] == starts


def test_mixture_scan_keeps_the_best_start(spark):
    x = np.concatenate([np.random.default_rng(2).normal(c, 0.2, (30, 1)) for c in (0, 3, 6, 9)])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    fits = [cluster.mixture_scan(df, "v", k_max=3, iterations=5, seed=s, restarts=1).orderBy("k").collect() for s in (42, 43)]
    best = cluster.mixture_scan(df, "v", k_max=3, iterations=5, restarts=2).orderBy("k").collect()
    assert [r["log_likelihood"] for r in best] == pytest.approx([max(a["log_likelihood"], b["log_likelihood"]) for a, b in zip(*fits)])


def test_points_are_whole_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    assert {len(r["v"]) for r in catalog.t.points(spark, sf).select("v").collect()} == {64}
    assert {len(r["v"]) for r in catalog.QUERIES["synthetic_sampling"](spark, sf).collect()} == {64}


def test_density_over_all_rows_in_tiles(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.1, 60), ((5, 5), 0.3, 50), ((0, 5), 0.2, 40))] + [rng.uniform(-20, 20, (10, 2))])
    kind = np.concatenate([np.repeat([0, 1, 2], (60, 50, 40)), np.full(10, -1)])
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, kind))], "id long, v array<double>, kind int")
    labels = density.hdbscan(x, 15, 5)[0]
    got = {r["row_id"]: r["label"] for r in density.density_modes(df, "id", "v", size=30).collect()}
    pairs = {(a, got[i]) for i, a in enumerate(labels.tolist())}
    assert len(got) == 160 and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert density.density_validity(df, "v", "kind", size=30).first()[0] == pytest.approx(density.dbcv(x, kind))


def test_density_has_no_bound_on_rows(spark):
    x = np.concatenate([np.random.default_rng(5).normal(c, 0.1, (n, 2)) for c, n in (((0, 0), 4300), ((9, 9), 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    edges = density.spanning_trees(density.kth_nearest(df.withColumn("g", F.lit("a")).select("g", "id", "v"), 5)).collect()
    assert len(edges) == 4315


def test_quartiles_are_exact(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 500, 4000):
        a, b = rng.normal(size=n) ** 5 * 1e6, rng.integers(0, 4, n).astype(float)
        rows = [(float(x), float(y) if i % 5 else None, None, 7.0) for i, (x, y) in enumerate(zip(a, b))]
        got = features.quartiles(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"], parts=16).first()
        some = [y for _, y, _, _ in rows if y is not None]
        for name, x in (("a", a), ("b", some), ("d", [7.0])):
            want = np.percentile(x, [25, 75]) if len(x) else [None, None]
            assert list(got[f"_q_{name}"]) == (pytest.approx(list(want)) if len(x) else want)
        assert list(got["_q_c"]) == [None, None]


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select("id", F.lit(2.0).alias("x"))
    one, two = (sorted(map(tuple, cluster.jitter(d, ["x"], 0.1, key=["id"]).collect())) for d in (df, df.repartition(9)))
    assert one == two and 0.05 < np.std([x for _, x in one]) < 0.15


def test_text_of_large_doubles_is_that_of_sql(spark):
    import duckdb

    from regimera.functions.columns import text2

    xs = [0.0, 0.004, 0.125, 1.0, 2.5, 1234.565, 9999999.99, 1e7, 30211753.23, 84017672.1, 123456789012.5, 9.87654321e15, 1e16, 1.25e17, math.inf]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(text2(F.col("x"))).collect()]
    assert got == [duckdb.sql(f"SELECT CAST(round(CAST('{x!r}' AS DOUBLE), 2) AS VARCHAR)").fetchall()[0][0] for x in xs]


def test_decimal_risks_are_averaged_exactly(spark):
    rows = [("u", i, m, r) for i, (m, r) in enumerate([("b", "0.10"), ("a", "0.55"), ("c", "0.70"), ("a", "0.90"), ("b", "0.10")] * 3)]
    df = spark.createDataFrame(rows, "u string, t int, m string, r string").withColumn("r", F.col("r").cast("decimal(3,2)"))
    got = temporal.degradation(df, ["u"], ["t"], "m", "r", 10, 3, known=["a", "b", "c"]).collect()
    parts = [0.4 * math.log(0.4 + 1e-10), 0.4 * math.log(0.4 + 1e-10), 0.2 * math.log(0.2 + 1e-10)]
    assert {r["avg_risk"] for r in got} == {0.47} and {r["entropy"] for r in got} == {-sum(parts)}


def test_grown_trees_weigh_as_much_as_any_least_tree(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (220, 6)), rng.normal(9, 0.4, (90, 6)), np.repeat(rng.normal(4, 1, (3, 6)), 20, axis=0)])
    df = spark.createDataFrame([("a" if i < 370 else "b", i * 3, v.tolist()) for i, v in enumerate(np.concatenate([x, x[:40]]))], "g string, id long, v array<double>")
    cored = density.kth_nearest(df, 5, size=64).cache()
    d = density.distances(x, x)
    core = density.core_distances(d, 5)
    assert [r["core"] for r in cored.where("g = 'a'").orderBy("id").collect()] == pytest.approx(core.tolist(), abs=1e-12)
    want = density.spanning_tree(np.maximum(d, np.maximum(core[:, None], core[None, :])))[:, 2]
    for known in (2, 8):  # short lists leave components waiting, so rows search again
        edges = density.grown_trees(cored, size=64, known=known).collect()
        got = sorted(r["w"] for r in edges if r["g"] == "a")
        assert got == pytest.approx(want.tolist(), abs=1e-12) and got[0] == 0.0
        kept, _ = density.union(np.array([r["a"] // 3 for r in edges]), np.array([r["b"] // 3 for r in edges]), np.zeros(len(edges)), 410)
        assert len(kept) == len(edges) == 369 + 39


def test_searches_stay_in_many_tasks(spark):
    """Blocks of one group meet in groups of their own; joined by their group alone, one task held them all."""
    df = spark.createDataFrame([(i, [float(i % 17), float(i % 5), i / 400]) for i in range(400)], "id long, v array<double>")
    rows = df.select(F.lit("a").alias("g"), "id", F.lit(0.0).alias("core"), F.col("id").alias("comp"), "v")
    plan = density._cells(rows, rows, 4, 50, True)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "SortMergeJoin" not in plan and "hashpartitioning(g" in plan


def _jobs(spark, name, act):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = act()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_kmeans_scan_fits_all_starts_in_one_pass(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0, 4, 8, 12)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    rows, jobs = _jobs(spark, "kmeans-scan", lambda: cluster.kmeans_scan(df, "id", "v", k_max=6, restarts=6).orderBy("k").collect())
    assert jobs < 100  # a job for each start, count and step would be some hundreds
    assert [r["k"] for r in rows] == [2, 3, 4, 5, 6] and [r["k"] for r in rows if r["best"]] == [4]
    four, means = rows[2], np.stack([x[i * 40 : i * 40 + 40].mean(0) for i in range(4)])
    assert four["inertia"] == pytest.approx(((x - np.repeat(means, 40, axis=0)) ** 2).sum(), rel=1e-9)
    named = spark.createDataFrame([(i, v.tolist(), i // 40) for i, v in enumerate(x)], "id long, v array<double>, label int")
    assert four["silhouette"] == pytest.approx(metrics.silhouette(named, "id", "v", "label").first()[0], rel=1e-9)
    assert four["davies_bouldin"] == pytest.approx(metrics.davies_bouldin(named, "v", "label").first()[0], rel=1e-9)
    assert four["calinski_harabasz"] == pytest.approx(metrics.calinski_harabasz(named, "v", "label").first()[0], rel=1e-9)


def test_validity_of_many_labelings_counts_copies_and_lone_rows(spark):
    from regimera.operators import fits

    x = np.array([[0.0, 0.0]] * 5 + [[1e-9, 0.0], [3.0, 1.0], [50.0, 50.0]])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    centers = [np.array([[0.0, 0.0], [50.0, 50.0]]), np.array([[0.0, 0.0], [3.0, 1.0], [50.0, 50.0], [900.0, 900.0]]), np.array([[0.0, 0.0]])]
    got = fits.validity(fits.Blocks(df, "v", rows=3), centers)
    for c, scores in zip(centers[:2], got):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        named = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, own))], "id long, v array<double>, label int")
        assert scores[0] == pytest.approx(metrics.silhouette(named, "id", "v", "label").first()[0], rel=1e-9)
        assert scores[1] == pytest.approx(metrics.davies_bouldin(named, "v", "label").first()[0], rel=1e-9)
    assert got[2] is None


def test_mixture_scan_fits_all_starts_in_one_pass(spark):
    x = np.concatenate([np.random.default_rng(2).normal(c, 0.2, (50, 2)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    rows, jobs = _jobs(spark, "mixture-scan", lambda: cluster.mixture_scan(df, "v", k_max=4, restarts=4).orderBy("k").collect())
    assert jobs < 80  # a job for each start, count and step would be hundreds
    assert [r["k"] for r in rows] == [2, 3, 4] and [r["k"] for r in rows if r["best"]] == [3]
    y = x - np.repeat([x[i : i + 50].mean(0) for i in (0, 50, 100)], 50, axis=0)
    apart = 0.0
    for i in (0, 50, 100):
        cov = y[i : i + 50].T @ y[i : i + 50] / 50
        apart += -0.5 * (50 * np.log(np.linalg.det(2 * np.pi * cov)) + np.einsum("ij,ij->", y[i : i + 50] @ np.linalg.inv(cov), y[i : i + 50])) - 50 * np.log(3)
    assert rows[1]["log_likelihood"] == pytest.approx(apart, abs=0.1)


def test_moments_are_rounded_once_a_step(spark):
    from fractions import Fraction

    from regimera.functions.columns import a_moments, fma

    rng = np.random.default_rng(8)
    rows = [tuple(float(v) for v in r) for r in np.concatenate([rng.normal(0, 1, (200, 3)), [[0.1, 10.0, -1.0], [1 / 3, 3.0, -1.0]]])]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double").orderBy("i").select(fma(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [float(Fraction(a) * Fraction(b) + Fraction(c)) for a, b, c in rows]
    n = mx = my = c = s = 0.0
    for x, y, _ in rows:
        n, dx = n + 1.0, x - mx
        mx, my = mx + dx / n, my + (y - my) / n
        c, s = float(Fraction(dx) * Fraction(y - my) + Fraction(c)), float(Fraction(x - mx) * Fraction(dx) + Fraction(s))
    m = spark.createDataFrame([([r[:2] for r in rows],)], "p array<struct<x: double, y: double>>").select(a_moments(F.col("p")).alias("m")).first()["m"]
    assert (m["n"], m["c"], m["s"]) == (202.0, c, s)
