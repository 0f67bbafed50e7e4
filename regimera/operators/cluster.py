"""Centroid and mixture clustering on pyspark.ml, model scans, boundary refinement and bounded synthesis."""

from __future__ import annotations

import math

from py4j.protocol import Py4JJavaError
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fits
from .metrics import centroids
from .tiles import nearest, pack


def vectors(df: DataFrame, columns: list[str] | str, out: str = "features") -> DataFrame:
    """df plus a vector column, from an array column or a list of numeric columns."""
    a = F.col(columns) if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
    return df.withColumn(out, array_to_vector(a.cast("array<double>")))


def best_kmeans(df: DataFrame, k: int, seed: int = 42, restarts: int = 3, features: str = "features"):
    """The model with the least cost over several seeds (the library has no restarts of its own)."""
    models = [KMeans(k=k, seed=seed + i, featuresCol=features, maxIter=50).fit(df) for i in range(restarts)]
    return min(models, key=lambda m: m.summary.trainingCost)


def kmeans_labels(df: DataFrame, columns: list[str] | str, k: int, seed: int = 42, restarts: int = 3) -> DataFrame:
    tagged = vectors(df, columns, "_f").cache()
    model = best_kmeans(tagged, k, seed, restarts, "_f")
    return model.transform(tagged).withColumnRenamed("prediction", "label").drop("_f")


def kmeans_scan(df: DataFrame, row_id: str, vector: str, k_max: int = 10, seed: int = 42, restarts: int = 10) -> DataFrame:
    """(k, inertia, silhouette, davies_bouldin, calinski_harabasz, best) for k = 2..k_max; best marks the highest silhouette, first on ties."""
    spark, ks = df.sparkSession, list(range(2, k_max + 1))
    blocks = fits.Blocks(df, vector)
    models = fits.kmeans(blocks, ks, [seed + i for i in range(restarts)])
    scores = fits.validity(blocks, [models[k][1] for k in ks])
    blocks.drop()
    rows = [(k, models[k][0], *found) for k, found in zip(ks, scores) if found is not None]
    out = spark.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double")
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc("silhouette"), "k")) == 1)


def best_mixture(df: DataFrame, k: int, seed: int = 42, restarts: int = 5, iterations: int = 50):
    """The model with the greatest likelihood over several seeds; a start whose covariances break down counts for nothing, None if all do."""
    models = []
    for i in range(restarts):
        try:
            models.append(GaussianMixture(k=k, seed=seed + i, maxIter=iterations).fit(df))
        except Py4JJavaError as e:
            if "breeze.linalg" not in str(e.java_exception):
                raise
    return max(models, key=lambda m: m.summary.logLikelihood, default=None)


def mixture(df: DataFrame, vector: str, k: int, seed: int = 42, restarts: int = 5, iterations: int = 50):
    """(model, labelled rows): full-covariance Gaussian mixture; adds mode_id and the responsibilities."""
    base = vectors(df, vector).cache()
    model = best_mixture(base, k, seed, restarts, iterations)
    out = model.transform(base).withColumn("responsibility", vector_to_array("probability"))
    return model, out.withColumnRenamed("prediction", "mode_id").drop("features", "probability")


def n_parameters(k: int, d: int) -> int:
    return k * d + k * d * (d + 1) // 2 + k - 1


def mixture_scan(df: DataFrame, vector: str, k_max: int = 10, seed: int = 42, iterations: int = 30, restarts: int = 5) -> DataFrame:
    """(k, log_likelihood, bic, aic, best) for k = 2..k_max; best marks the lowest BIC."""
    n, d = df.count(), len(df.select(vector).first()[0])
    blocks = fits.Blocks(df, vector)
    rows = []
    for k, ll in sorted(fits.mixtures(blocks, list(range(2, k_max + 1)), [seed + i for i in range(restarts)], iterations).items()):
        p = n_parameters(k, d)
        rows.append((k, ll, p * math.log(n) - 2 * ll, 2 * p - 2 * ll))
    blocks.drop()
    out = df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double, aic double")
    return out.withColumn("best", F.row_number().over(Window.orderBy("bic", "k")) == 1)


def pca(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """df plus latent: array of k principal components."""
    base = vectors(df, vector, "_f")
    return PCA(k=k, inputCol="_f", outputCol="_p").fit(base).transform(base).withColumn("latent", vector_to_array("_p")).drop("_f", "_p")


def _nearest_centroid(rows: DataFrame, modes: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mode_id): the nearest of the given centroids, ties to the first id. Centroids are one small row set."""
    from ..functions.columns import distance

    listed = modes.groupBy().agg(F.array_sort(F.collect_list(F.struct("mode_id", "centroid"))).alias("all"))
    near = F.array_min(F.transform("all", lambda m: F.struct(distance(F.col(vector).cast("array<double>"), m["centroid"]).alias("d"), m["mode_id"].alias("m"))))
    return rows.crossJoin(F.broadcast(listed)).where(F.size("all") > 0).select(key, near["m"].alias("near"))  # one row


def refine(df: DataFrame, row_id: str, vector: str, mode: str, centroid: DataFrame, infeasible: list[int], strategy: str = "merge", seed: int = 42) -> DataFrame:
    """df with `refined`: modes that fail the rules are merged, split, reassigned point by point, or marked -2.

    centroid: (mode_id, centroid). merge: the whole mode goes to the nearest feasible centroid. split: two-means inside the
    mode, new ids from the highest on; fewer than four points stay. gradient: each point goes to its nearest feasible
    centroid. fault: -2. Without a feasible mode merge and gradient change nothing.
    """
    if strategy not in ("merge", "split", "gradient", "fault"):
        raise ValueError(f"unknown strategy {strategy}")
    bad = F.col(mode).isin([int(x) for x in infeasible]) if infeasible else F.lit(False)
    feasible = centroid.where(~F.col("mode_id").isin([int(x) for x in infeasible])) if infeasible else centroid
    if strategy == "fault":
        return df.withColumn("refined", F.when(bad, -2).otherwise(F.col(mode)))
    if strategy == "merge":
        moved = _nearest_centroid(centroid.where(F.col("mode_id").isin([int(x) for x in infeasible])) if infeasible else centroid.limit(0), feasible, "mode_id", "centroid")
        out = df.join(F.broadcast(moved.withColumnRenamed("mode_id", "_m")), F.col(mode) == F.col("_m"), "left")  # one row a mode
        return out.withColumn("refined", F.coalesce("near", mode)).drop("_m", "near")
    if strategy == "gradient":
        near = _nearest_centroid(df.where(bad).select(row_id, vector), feasible, row_id, vector)
        return df.join(near, row_id, "left").withColumn("refined", F.coalesce("near", mode)).drop("near")
    top = int(df.agg(F.max(mode)).first()[0] or 0)
    parts = [df.where(~bad).withColumn("refined", F.col(mode).cast("int"))]
    for m in infeasible:  # one fit a mode
        rows = df.where(F.col(mode) == int(m))
        if rows.limit(4).count() < 4:
            parts.append(rows.withColumn("refined", F.col(mode).cast("int")))
            continue
        cells = kmeans_labels(rows.select(F.col(row_id).alias("_id"), F.col(vector).alias("_v")), "_v", 2, seed).select("_id", F.col("label").alias("_cell"))
        parts.append(rows.join(cells, F.col(row_id) == F.col("_id")).withColumn("refined", (F.col("_cell") + top + 1).cast("int")).drop("_id", "_cell"))
        top += 2
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def neighbours(df: DataFrame, row_id: str, vector: str, k: int = 5) -> DataFrame:
    """(id, other, dist, rank) with rank 1 the row itself."""
    packed = pack(df, row_id, vector)
    return nearest(packed, packed, k)


def bounded_samples(df: DataFrame, row_id: str, vector: str, n: int, allowed, k: int = 5, attempts: int = 50, seed: int = 42) -> DataFrame:
    """n synthetic vectors between rows and their neighbours that meet allowed(vector array Column) -> boolean Column.

    Each sample tries `attempts` seeded draws of (row, neighbour, alpha) and takes the first allowed one; if none is, the
    last draw is shrunk by 0.99. Fewer than two rows give none.
    """
    spark = df.sparkSession
    base = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n_rows = base.count()
    if n_rows < 2:
        return spark.createDataFrame([], "sample_id long, v array<double>, accepted boolean")
    k = min(k, n_rows)
    edges = neighbours(base, "id", "v", k).where("rank > 1").select("id", "other", "rank")
    numbered = base.withColumn("pos", F.row_number().over(Window.orderBy("id")) - 1)  # one mode's rows
    u = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "sample_id", "attempt"), F.lit(1 << 30)) / float(1 << 30)
    draws = spark.range(n).withColumnRenamed("id", "sample_id").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    draws = draws.select("sample_id", "attempt", F.floor(u(1) * n_rows).alias("pos"), (F.floor(u(2) * (k - 1)) + 2).alias("rank"), u(3).alias("alpha"))
    made = draws.join(numbered, "pos").join(edges, ["id", "rank"]).join(base.select(F.col("id").alias("other"), F.col("v").alias("nv")), "other")
    point = F.zip_with(F.zip_with("v", "nv", lambda a, b: b - a), "v", lambda d, a: a + F.col("alpha") * d)
    made = made.select("sample_id", "attempt", point.alias("p")).withColumn("ok", F.coalesce(allowed(F.col("p")), F.lit(False)))
    best = made.groupBy("sample_id").agg(F.min_by("p", F.when(F.col("ok"), F.col("attempt"))).alias("good"), F.max_by("p", "attempt").alias("last"), F.max("ok").alias("accepted"))
    return best.select("sample_id", F.when(F.col("accepted"), F.col("good")).otherwise(F.transform("last", lambda x: x * 0.99)).alias("v"), "accepted")


def jitter(df: DataFrame, columns: list[str], scale: float = 0.01, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """df with normal noise on the columns, drawn from hashes of seed, column and row (its `key`, or all of it), so partitions do not matter."""
    named = key or df.columns

    def uniform(c: str, i: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.lit(i), *named), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)

    noise = lambda c: F.sqrt(-2 * F.log(uniform(c, 0))) * F.cos(2 * math.pi * uniform(c, 1)) * scale
    return df.select(*[(F.col(c) + noise(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


__all__ = ["best_kmeans", "bounded_samples", "centroids", "jitter", "kmeans_labels", "kmeans_scan", "mixture", "mixture_scan", "neighbours", "pca", "refine", "vectors", "Column"]
