"""Cluster validity, agreement of labelings, and distances between distributions."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import a_sum, distance
from .tiles import distances, meet, pack


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, n, centroid, spread): mean vector and population variance of each group."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    s = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), Summarizer.metrics("mean", "variance").summary(v).alias("s"))
    scale = F.col("n") - 1
    var = F.transform(vector_to_array("s.variance"), lambda x: F.when(F.col("n") > 1, x * scale / F.col("n")).otherwise(F.lit(0.0)))
    return s.select(label, "n", vector_to_array("s.mean").alias("centroid"), var.alias("spread"))


def silhouette(df: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """One row: the mean Euclidean silhouette over rows whose label is not -1; null below two clusters, 0 for a lone member."""
    kept = df.where(F.col(label) != -1)
    packed = pack(kept, row_id, vector, label)

    def kernel(ia, la, a, ib, lb, b):
        d = distances(a, b)
        kinds, place = np.unique(lb, return_inverse=True)
        sums = np.stack([d[:, place == j].sum(1) for j in range(len(kinds))], 1)
        counts = np.bincount(place, minlength=len(kinds))
        m = len(kinds)
        return np.repeat(ia, m), np.repeat(la, m), np.tile(kinds, len(ia)), sums.ravel(), np.tile(counts, len(ia))

    parts = meet(packed, packed, kernel, "id bigint, own bigint, other bigint, total double, n bigint")
    by = parts.groupBy("id", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    is_own = F.col("own") == F.col("other")
    row = by.groupBy("id").agg(
        F.max(F.when(is_own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~is_own, F.col("total") / F.col("n"))).alias("b")
    )
    s = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return row.agg(F.avg(F.when(F.col("b").isNotNull(), s)).alias("silhouette"))


def davies_bouldin(df: DataFrame, vector: str, label: str) -> DataFrame:
    kept = df.where(F.col(label) != -1)
    c = centroids(kept, label, vector)
    spread = kept.join(c.select(label, "centroid"), label).groupBy(label).agg(F.first("centroid").alias("c"), F.avg(distance(F.col(vector).cast("array<double>"), F.col("centroid"))).alias("s"))
    # Clusters are few; every pair of clusters is compared.
    x, y = spread.select(F.col(label).alias("i"), F.col("c").alias("ci"), F.col("s").alias("si")), spread.select(F.col(label).alias("j"), F.col("c").alias("cj"), F.col("s").alias("sj"))
    ratio = F.try_divide(F.col("si") + F.col("sj"), distance(F.col("ci"), F.col("cj")))
    worst = x.join(F.broadcast(y), F.col("i") != F.col("j")).groupBy("i").agg(F.max(ratio).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, vector: str, label: str) -> DataFrame:
    kept = df.where(F.col(label) != -1)
    c = centroids(kept, label, vector)
    whole = kept.agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("g"))
    square = lambda a, b: a_sum(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)))
    between = c.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("n") * square(F.col("centroid"), F.col("g"))).alias("b"), F.sum(F.col("n") * a_sum(F.col("spread"))).alias("w"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))  # one row
    return between.select(F.when(F.col("k") > 1, F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def _pairs(c: Column) -> Column:
    return c * (c - 1) / 2.0


def agreement_scores(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (nmi, ari) of two labelings over rows where neither is -1; at most one row gives 0 for both."""
    t = df.where((F.col(a) != -1) & (F.col(b) != -1)).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("ra", F.sum("n").over(Window.partitionBy("a"))).withColumn("rb", F.sum("n").over(Window.partitionBy("b"))).withColumn("t", F.sum("n").over(whole))
    p = F.col("n") / F.col("t")
    got = t.agg(
        F.max("t").alias("t"), F.sum(p * F.ln(F.col("n") * F.col("t") / (F.col("ra") * F.col("rb")))).alias("mi"), F.sum(_pairs(F.col("n"))).alias("both"),
        F.sum(F.col("n") / F.col("ra") * -(F.col("ra") / F.col("t")) * F.ln(F.col("ra") / F.col("t"))).alias("ha"),
        F.sum(F.col("n") / F.col("rb") * -(F.col("rb") / F.col("t")) * F.ln(F.col("rb") / F.col("t"))).alias("hb"),
        F.sum(F.col("n") / F.col("ra") * _pairs(F.col("ra"))).alias("pa"), F.sum(F.col("n") / F.col("rb") * _pairs(F.col("rb"))).alias("pb"),
    )
    expected = F.try_divide(F.col("pa") * F.col("pb"), _pairs(F.col("t")))
    top = 0.5 * (F.col("pa") + F.col("pb"))
    nmi = F.when(F.col("ha") + F.col("hb") < 1e-15, F.lit(1.0)).otherwise(F.try_divide(F.col("mi"), 0.5 * (F.col("ha") + F.col("hb"))))
    ari = F.when(F.abs(top - expected) < 1e-15, F.lit(1.0)).otherwise(F.try_divide(F.col("both") - expected, top - expected))
    few = F.coalesce(F.col("t"), F.lit(0.0)) <= 1
    return got.select(F.when(few, F.lit(0.0)).otherwise(nmi).alias("nmi"), F.when(few, F.lit(0.0)).otherwise(ari).alias("ari"))


def labeling_stability(df: DataFrame, labelings: list[str]) -> DataFrame:
    """One row: mean adjusted Rand index of consecutive labelings, null for fewer than two."""
    scores = [agreement_scores(df, x, y).select("ari") for x, y in zip(labelings, labelings[1:])]
    if not scores:
        return df.sparkSession.createDataFrame([(None,)], "stability double")
    out = scores[0]
    for s in scores[1:]:
        out = out.unionByName(s)
    return out.agg(F.avg("ari").alias("stability"))


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "v")).where("v is not null")


def distribution_shift(x: DataFrame, y: DataFrame, columns: list[str], ranges: int = 256) -> DataFrame:
    """(feature, wasserstein, ks): distance of two samples of each column, from their empirical distribution functions.

    Distribution functions are prefix sums in two levels, ranges of values and values in a range, so no task holds a
    whole column.
    """
    both = _long(x, columns).withColumn("s", F.lit(0)).unionByName(_long(y, columns).withColumn("s", F.lit(1)))
    values = both.groupBy("feature", "v").agg(F.sum(1 - F.col("s")).alias("a"), F.sum("s").alias("b"))
    span = values.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    r = F.least(F.lit(ranges - 1), F.coalesce(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * ranges), F.lit(0)))
    placed = values.join(span, "feature").withColumn("r", r)
    sums = placed.groupBy("feature", "r").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"), F.min("v").alias("first"))
    w = Window.partitionBy("feature").orderBy("r")
    ahead = sums.select("feature", "r", (F.sum("ra").over(w) - F.col("ra")).alias("pa"), (F.sum("rb").over(w) - F.col("rb")).alias("pb"), F.lead("first").over(w).alias("after"))
    inner = Window.partitionBy("feature", "r").orderBy("v")
    at = placed.join(ahead, ["feature", "r"])
    gap = F.abs((F.col("pa") + F.sum("a").over(inner)) / F.col("na") - (F.col("pb") + F.sum("b").over(inner)) / F.col("nb"))
    step = F.coalesce(F.lead("v").over(inner), F.col("after"), F.col("v")) - F.col("v")
    rows = at.select("feature", gap.alias("gap"), step.alias("step"))
    return rows.groupBy("feature").agg(F.sum(F.col("gap") * F.col("step")).alias("wasserstein"), F.max("gap").alias("ks"))


def _group_moments(df: DataFrame, mode: str, columns: list[str]) -> DataFrame:
    return df.groupBy(mode).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("m"), F.array(*[F.var_pop(c) for c in columns]).alias("v"))


def mode_shift(x: DataFrame, y: DataFrame, mode: str, columns: list[str]) -> DataFrame:
    """(mode, centroid_shift, diversity_gain, deformation) for the modes both samples have."""
    a = _group_moments(x, mode, columns).select(mode, F.col("m").alias("ma"), F.col("v").alias("va"))
    b = _group_moments(y, mode, columns).select(mode, F.col("m").alias("mb"), F.col("v").alias("vb"))
    k = len(columns)
    base = F.greatest(F.lit(1e-9), a_sum(F.col("va")) / k)
    ratio = a_sum(F.col("vb")) / k / base
    return a.join(b, mode).select(mode, distance(F.col("ma"), F.col("mb")).alias("centroid_shift"), ratio.alias("diversity_gain"), F.abs(1.0 - ratio).alias("deformation"))


def coverage_increase(x: DataFrame, y: DataFrame, columns: list[str]) -> DataFrame:
    """One row: volume of the box around both samples over that of the first, minus 1."""
    box = lambda d, p: d.agg(*[F.min(c).alias(f"{p}lo_{c}") for c in columns], *[F.max(c).alias(f"{p}hi_{c}") for c in columns])
    both = box(x, "x").crossJoin(box(y, "y"))  # one row each
    real, whole = F.lit(1.0), F.lit(1.0)
    for c in columns:
        real = real * (F.col(f"xhi_{c}") - F.col(f"xlo_{c}"))
        whole = whole * (F.greatest(f"xhi_{c}", f"yhi_{c}") - F.least(f"xlo_{c}", f"ylo_{c}"))
    return both.select((whole / F.greatest(F.lit(1e-9), real) - 1.0).alias("coverage_increase"))


def mode_kl(x: DataFrame, y: DataFrame, mode: str) -> DataFrame:
    """One row: KL divergence of mode shares over common modes, shares taken of all rows."""
    share = lambda d, n: d.groupBy(mode).agg(F.count(F.lit(1)).alias(n)).withColumn(n, F.col(n) / F.sum(n).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    both = share(x, "p").join(share(y, "q"), mode)
    return both.agg(F.sum(F.col("p") * F.ln((F.col("p") + 1e-9) / (F.col("q") + 1e-9))).alias("kl"))
