"""How modes evolve: transitions, run durations, sequence motifs, degradation index, remaining life."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.columns import a_moments, a_sum, fma
from .windows import adjacent_pairs, last_slope, ordered, run_lengths, run_ngrams


def transition_matrix(df: DataFrame, unit: list[str], order: list[str], mode: str, ignore_negative: bool = False) -> DataFrame:
    """(from_mode, to_mode, n, p): counts of adjacent pairs and row shares; pairs never seen are absent (p = 0)."""
    pairs = adjacent_pairs(df, unit, order, mode)
    if ignore_negative:
        pairs = pairs.where("from_mode >= 0 and to_mode >= 0")
    counts = pairs.groupBy("from_mode", "to_mode").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_mode")))


def mean_durations(df: DataFrame, unit: list[str], order: list[str], mode: str) -> DataFrame:
    """(mode, runs, mean_length)."""
    return run_lengths(df, unit, order, mode).groupBy(mode).agg(F.count(F.lit(1)).alias("runs"), F.avg("length").alias("mean_length"))


def transition_entropy(df: DataFrame, unit: list[str], order: list[str], mode: str) -> DataFrame:
    """One row: the occupancy-weighted entropy (bits) of the transition rows; a mode never left adds 0."""
    rows = transition_matrix(df, unit, order, mode).groupBy("from_mode").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"))
    occupancy = df.groupBy(F.col(mode).alias("from_mode")).agg(F.count(F.lit(1)).alias("c"))
    joined = occupancy.join(rows, "from_mode", "left")
    return joined.agg((F.sum(F.col("c") * F.coalesce("h", F.lit(0.0))) / F.sum("c")).alias("transition_entropy"))


def rare_transition_rate(df: DataFrame, unit: list[str], order: list[str], mode: str, below: float = 0.05) -> DataFrame:
    """One row: share of mode changes whose transition probability lies in (0, below)."""
    jumps = transition_matrix(df, unit, order, mode).where("from_mode <> to_mode")
    rare = F.sum(F.when((F.col("p") > 0) & (F.col("p") < below), F.col("n")).otherwise(0))
    return jumps.agg((F.coalesce(rare, F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0)))).alias("rare_transition_rate"))


def stability_index(df: DataFrame, unit: list[str], order: list[str], mode: str) -> DataFrame:
    same = F.sum(F.when(F.col("from_mode") == F.col("to_mode"), F.col("n")).otherwise(0))
    return transition_matrix(df, unit, order, mode).agg(F.coalesce(F.try_divide(same, F.sum("n")), F.lit(0.0)).alias("stability_index"))


def top_sequences(df: DataFrame, unit: list[str], order: list[str], mode: str, n: int = 3, top: int = 5) -> DataFrame:
    """The `top` most frequent n-grams of the collapsed mode sequences; ties in gram order."""
    grams = run_ngrams(run_lengths(df, unit, order, mode), unit, mode, n)
    keys = [f"g{i}" for i in range(n)]
    return grams.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(top)


def _entropy(modes: Column, known: list | None = None) -> Column:
    """Known modes are summed in the order given, others as they are met."""
    total = F.size(modes).cast("double")
    kinds = F.array_distinct(modes)
    if known:
        named = F.array(*[F.lit(k) for k in known])
        kinds = F.concat(F.array_intersect(named, modes), F.array_except(modes, named))
    shares = F.transform(kinds, lambda m: F.size(F.filter(modes, lambda x: x.eqNullSafe(m))) / total)
    return -a_sum(F.transform(shares, lambda p: p * F.ln(p + 1e-10)))


def _most_common(modes: Column) -> Column:
    """The most common element, ties to the one met first."""
    ranked = F.transform(F.array_distinct(modes), lambda m: F.struct(F.size(F.filter(modes, lambda x: x.eqNullSafe(m))).alias("n"), (-F.array_position(modes, m)).alias("at"), m.alias("m")))
    return F.array_max(ranked)["m"]


def degradation(df: DataFrame, unit: list[str], order: list[str], mode: str, risk: str, window: int, n_modes: int, clipped: bool = False, high: float = 0.5, known: list | None = None) -> DataFrame:
    """(unit, t, imdti, avg_risk, entropy, dwell, dominant_mode) from the `window` rows before each row (t counts from 0).

    imdti = 0.50 avg_risk + 0.25 entropy / ln(n_modes) + 0.25 dwell. dwell is the share of rows with risk > high; the
    clipped variant uses >= high and clips each part and the sum to [0, 1]. One known mode gives a normalised entropy of
    -1 unclipped, as ln(1 + 1e-10) divides its own negative. Risks held as decimals are averaged exactly; `known` gives the order in
    which the modes' parts of the entropy are added.
    """
    w = ordered(unit, order)
    frame = w.rowsBetween(-window, -1)
    hot = F.col(risk) >= high if clipped else F.col(risk) > high
    scale = math.log(max(n_modes, 1) + 1e-10)
    kind, mean = df.schema[risk].dataType, F.avg(risk).over(frame)
    if isinstance(kind, DecimalType):  # a quotient of whole numbers, rounded once
        mean = F.sum((F.col(risk) * 10**kind.scale).cast("long")).over(frame) / (F.count(risk).over(frame) * float(10**kind.scale))
    out = df.select(
        *unit, (F.row_number().over(w) - 1).cast("long").alias("t"),
        F.collect_list(mode).over(frame).alias("_modes"), mean.alias("avg_risk"),
        F.avg(hot.cast("double")).over(frame).alias("dwell"),
    ).where(F.col("t") >= window)
    out = out.withColumn("entropy", _entropy(F.col("_modes"), known)).withColumn("dominant_mode", _most_common(F.col("_modes")))
    clip = (lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))) if clipped else (lambda c: c)
    value = clip(0.50 * clip(F.col("avg_risk")) + 0.25 * clip(F.col("entropy") / scale) + 0.25 * F.col("dwell"))
    return out.select(*unit, "t", value.alias("imdti"), "avg_risk", "entropy", "dwell", "dominant_mode")


def remaining_life(trajectory: DataFrame, unit: list[str], failure: float = 0.85, least: int = 10, last: int = 50) -> DataFrame:
    """(unit, points, degradation_rate, rul): slope of the last points, and the cycles until the trend meets `failure`.

    rul is null below `least` points and infinite where the trend does not rise. It divides by a slope that may be next to nothing, so
    slope and intercept are taken step by step as the SQL engine does: from the last point to the first, moments rounded once a step, by n, and plain
    means. A unit's points are one array there.
    """
    w = Window.partitionBy(*unit).orderBy("t")
    x = trajectory.withColumn("_x", (F.row_number().over(w) - 1).cast("double"))
    some = F.col("imdti").isNotNull()
    fit = x.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("points"), F.sort_array(F.collect_list(F.when(some, F.struct(F.col("_x").alias("x"), F.col("imdti").alias("y")))), asc=False).alias("_p"), F.max("_x").alias("_last")
    ).withColumn("_c", a_moments(F.col("_p")))
    n = F.col("_c")["n"]
    fit = fit.withColumn("_m", (F.col("_c")["c"] / F.nullif(n, F.lit(0.0))) / F.nullif(F.col("_c")["s"] / F.nullif(n, F.lit(0.0)), F.lit(0.0)))
    mean = lambda k: a_sum(F.transform("_p", lambda p: p[k])) / F.nullif(n, F.lit(0.0))
    fit = fit.withColumn("_b", fma(-F.col("_m"), mean("x"), mean("y")))
    reach = F.try_divide(F.lit(failure) - F.col("_b"), F.col("_m")) - F.col("_last")
    rul = F.when(F.col("points") >= least, F.when(F.coalesce(F.col("_m"), F.lit(0.0)) <= 0, F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), reach)))
    slopes = last_slope(trajectory, unit, "t", "imdti", last).withColumnRenamed("slope", "degradation_rate")
    return fit.join(slopes, unit).select(*unit, "points", "degradation_rate", rul.alias("rul"))
