"""The end-to-end runs: vibration signals, engine cycles, the evaluation suite, and alignment of two runs."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import causal, cluster, consensus, density, features, metrics, physics, retrieval, temporal, windows
from ..sources import params as parameters
from ..sources.shared import settle


#: Synthetic samples drawn for each fault and infeasible mode.
SAMPLES = 50


@dataclass
class Run:
    """Tables of one run by name, lazily evaluated, and its few scalar facts."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    facts: dict[str, float] = field(default_factory=dict)


def _vectors(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.select(*keys, F.array(*columns).alias("v"))


def discover(joint: DataFrame, modalities: dict[str, list[str]], columns: list[str], row_id: str, p: dict, k_max: int = 10, max_points: int | None = None, iterations: int = 50) -> Run:
    """The part both runs share. joint: (row_id, standardised feature columns).

    Density clusters of each modality -> confidence votes -> mixture with the component count of least BIC -> proxies ->
    rules, risk, labels -> merge of infeasible modes -> library entries and fingerprints.
    """
    run = Run()
    joint = settle(joint, "run-joint")  # scanned by every model fit below
    long = None
    for name, cols in modalities.items():
        part = _vectors(joint, [row_id], cols).withColumn("modality", F.lit(name))
        long = part if long is None else long.unionByName(part)
    found = settle(density.density_modes(long, row_id, "v", "modality", max_points=max_points), "run-clusters")
    votes = consensus.arbitrate(found.select("row_id", "modality", "label", "prob"), list(modalities))
    data = _vectors(joint, [row_id], columns)
    baseline = cluster.kmeans_scan(data, row_id, "v", k_max=k_max)
    scan = cluster.mixture_scan(data, "v", k_max=k_max, iterations=iterations)
    k = scan.where("best").first()["k"]
    model, labelled = cluster.mixture(data, "v", int(k), iterations=iterations)
    labelled = settle(labelled, "run-modes")
    means = model.gaussiansDF.select(vector_to_array("mean").alias("mean")).collect()  # a row for each mode
    centroid = joint.sparkSession.createDataFrame([(i, list(map(float, r["mean"]))) for i, r in enumerate(means)], "mode_id int, centroid array<double>")
    z = centroid.select(F.col("mode_id").cast("long").alias("mode_id"), *[F.get("centroid", i).alias(c) for i, c in enumerate(columns)])
    last = lambda *parts: next((c for c in reversed(columns) if all(x in c for x in parts)), None)
    if p["domain"] == "electromechanical":
        q = physics.motor_proxies(z, p, last("de_", "rms"), last("de_", "mean"), last("kurtosis"))
    else:
        q = physics.engine_proxies(z, last("Nf_mean"), last("Nc_mean"), last("T50_mean") or last("T30_mean"))
    modes = labelled.select(F.col(row_id).alias("row_id"), F.col("mode_id").cast("long").alias("mode_id"))
    dominance = consensus.dominance_by_mode(votes, modes, list(modalities))
    signature = dominance.groupBy("mode_id").agg(F.map_from_entries(F.collect_list(F.struct("modality", "dominance"))).alias("signature"))
    filtered = settle(physics.filter_modes(q, p, signature), "run-filtered")
    bad = [r["mode_id"] for r in filtered.where("not feasible").select("mode_id").collect()]  # modes
    refined = cluster.refine(labelled.drop("responsibility"), row_id, "v", "mode_id", centroid, bad, "merge")
    refined = settle(refined, "run-refined")
    synthetic, seen = None, physics.synthesis_modes(filtered).collect()  # modes
    candidate = lambda v: physics.sample_allowed(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), v), p)
    for mode, kind in sorted((int(r["mode_id"]), r["kind"]) for r in seen):
        drawn = cluster.bounded_samples(labelled.where(F.col("mode_id") == mode), row_id, "v", SAMPLES, candidate)
        drawn = drawn.select(F.lit(mode).cast("long").alias("mode_id"), F.lit(kind).alias("kind"), "sample_id", "v", "accepted")
        synthetic = drawn if synthetic is None else synthetic.unionByName(drawn)
    if synthetic is None:
        synthetic = joint.sparkSession.createDataFrame([], "mode_id long, kind string, sample_id long, v array<double>, accepted boolean")
    entries = retrieval.library_entries(filtered.join(signature, "mode_id").select("mode_id", F.col("signature").alias("dominance"), "label", "risk_score"), p["domain"])
    prints = filtered.join(signature, "mode_id").select("mode_id", "label", retrieval.fingerprint(F.col("violated"), F.col("signature"), F.col("risk_score")).alias("fp"))
    run.tables |= {
        "clusters": found, "votes": votes, "baseline": baseline, "mixture_scan": scan, "modes": modes, "dominance": dominance, "filtered": filtered,
        "refined": refined, "synthetic": synthetic, "library": entries, "fingerprints": prints, "coherence": physics.coherence_rate(filtered),
        "conflict": votes.agg(F.avg(F.col("conflict").cast("double")).alias("conflict_rate")),
    }
    run.facts["components"] = int(k)
    return run


def vibration_run(signals: DataFrame, p: dict | None = None, size: int = 500, overlap: float = 0.5, rate: float = 12000.0, k_max: int = 10, iterations: int = 50) -> Run:
    """signals: (source_file, de, fe, ...). Windows -> 48 features -> discover."""
    p = p or parameters.MOTOR
    both = windows.array_windows(signals.withColumn("pair", F.arrays_zip("de", "fe")).drop("de", "fe"), "pair", size, overlap)
    wide = both.select("source_file", "window_id", F.col("pair.de").alias("de"), F.col("pair.fe").alias("fe"))
    made = features.vibration(wide, ["source_file", "window_id"], ["de", "fe"], rate)
    columns = [c for c in made.columns if c not in ("source_file", "window_id")]
    made = settle(made.withColumn("row_id", F.xxhash64("source_file", "window_id")), "run-features")  # preprocessing scans it twice
    ready = features.preprocess(made, columns, ["source_file", "window_id"], ["source_file"])
    run = discover(ready, {"vibration_de": [c for c in columns if c.startswith("de_")], "vibration_fe": [c for c in columns if c.startswith("fe_")]}, columns, "row_id", p, k_max, iterations=iterations)
    run.tables["features"] = ready
    return run


def engine_run(cycles: DataFrame, p: dict | None = None, size: int = 30, k_max: int = 10, imdti_window: int = 10, iterations: int = 50) -> Run:
    """cycles: (unit_id, cycle, sensor columns under their proper names). Rolling and cross features -> discover -> lifecycles."""
    p = p or parameters.TURBOFAN
    groups = parameters.modality_columns(p)
    rolled = features.rolling(cycles, ["unit_id"], "cycle", groups, size)
    rolled = settle(rolled, "run-rolled")
    crossed = features.cross_modal(rolled, ["unit_id"], "cycle", list(groups))
    keys = ["unit_id", "cycle"]
    joined = rolled.join(crossed, keys)
    columns = [c for c in joined.columns if c not in keys]
    ready = features.preprocess(joined.withColumn("row_id", F.xxhash64(*keys)), columns, ["cycle"], ["unit_id"])
    run = discover(ready, {m: [c for c in columns if c.startswith(f"{m}_")] for m in groups}, columns, "row_id", p, k_max, iterations=iterations)
    risk = run.tables["filtered"].select("mode_id", "risk_score", "violated")
    timeline = ready.select("row_id", *keys).join(run.tables["refined"].select("row_id", F.col("refined").cast("long").alias("mode_id")), "row_id")
    timeline = timeline.join(F.broadcast(risk), "mode_id", "left").withColumn("risk", F.coalesce("risk_score", F.lit(0.0)))  # a row for each mode
    timeline = settle(timeline, "run-timeline")
    n_modes = int(run.tables["filtered"].count())
    path = temporal.degradation(timeline, ["unit_id"], ["cycle"], "mode_id", "risk", imdti_window, n_modes)
    run.tables |= {
        "features": ready, "timeline": timeline, "trajectory": path, "remaining_life": temporal.remaining_life(path, ["unit_id"]),
        "precedence": causal.precedence_edges(timeline.withColumn("v", F.coalesce("violated", F.array().cast("array<string>"))), "unit_id", "cycle", "v", 0.5),
    }
    return run


def align_runs(a: Run, b: Run, threshold: float = 0.70) -> DataFrame:
    return retrieval.align(a.tables["fingerprints"], b.tables["fingerprints"], threshold).orderBy(F.desc("similarity"))


def evaluate(run: Run, row_id: str = "row_id", vector: str = "v") -> DataFrame:
    """(metric, value) of the core suite over a run's refined modes."""
    labelled = run.tables["refined"]
    parts = [
        metrics.silhouette(labelled, row_id, vector, "refined"), metrics.davies_bouldin(labelled, vector, "refined"), metrics.calinski_harabasz(labelled, vector, "refined"),
        labelled.agg(consensus.noise_ratio("refined").alias("noise_ratio")), run.tables["conflict"], run.tables["coherence"], density.density_validity(labelled, vector, "refined"),
    ]
    named = [p.select(F.lit(p.columns[0]).alias("metric"), F.col(p.columns[0]).cast("double").alias("value")) for p in parts]
    out = named[0]
    for n in itertools.islice(named, 1, None):
        out = out.unionByName(n)
    return out


def latency(process: Callable[[DataFrame], object], df: DataFrame, rows: int = 100, calls: int = 50, sizes: tuple[int, ...] = (10, 50, 100, 500, 1000)) -> dict:
    """Seconds of a processing function: one warm-up and `calls` timed calls on the first rows, then one call at each size."""
    few = df.limit(rows).cache()
    process(few)
    took = []
    for _ in range(calls):
        t = time.perf_counter()
        process(few)
        took.append(time.perf_counter() - t)
    took.sort()
    mean = sum(took) / len(took)
    out = {"mean_s": mean, "p99_s": took[min(len(took) - 1, math.ceil(0.99 * len(took)) - 1)], "per_second": 1 / mean if mean > 0 else math.inf, "sizes": {}}
    for n in sizes:
        t = time.perf_counter()
        process(df.limit(n))
        out["sizes"][n] = time.perf_counter() - t
    return out
