"""Rolling, cross-modal and preprocessing features of per-cycle tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TINY, a_spectral_features, a_time_features, corr0, iqr, slope0
from ..functions.spectrum import with_magnitudes
from ..sources.shared import settle
from .windows import forward_fill, full_windows, interpolate, ordered

WINDOW = 30
STATS = ("mean", "std", "slope", "range", "iqr")


def _stat(kind: str, x: Column, position: Column):
    return {
        "mean": lambda w: F.avg(x).over(w),
        "std": lambda w: F.stddev_pop(x).over(w),
        "slope": lambda w: slope0(x, position, w),
        "range": lambda w: F.max(x).over(w) - F.min(x).over(w),
        "iqr": lambda w: iqr(x, w),
    }[kind]


def rolling(df: DataFrame, unit: list[str], cycle: str, modalities: dict[str, list[str]], size: int = WINDOW, stride: int = 1) -> DataFrame:
    """All rolling statistics of all modalities in one pass: {modality}_{sensor}_{stat} and {modality}_avg_intra_correlation.

    The correlation is the mean over the modality's sensor pairs, present for two sensors or more. No joins: the
    modalities share the window.
    """
    features = {}
    position = F.col(cycle).cast("double")
    for name, sensors in modalities.items():
        for s in sensors:
            for stat in STATS:
                features[f"{name}_{s}_{stat}"] = _stat(stat, F.col(s), position)
        pairs = list(combinations(sensors, 2))
        if pairs:
            features[f"{name}_avg_intra_correlation"] = lambda w, pairs=pairs: sum((corr0(F.col(a), F.col(b), w) for a, b in pairs), F.lit(0.0)) / len(pairs)
    return full_windows(df, unit, cycle, size, stride, features)


def _row_mean(columns: list[str]) -> Column:
    """Mean of the columns that are not null."""
    present = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)) / F.nullif(present, F.lit(0))


def cross_modal(df: DataFrame, unit: list[str], cycle: str, modalities: list[str], across_units: bool = False) -> DataFrame:
    """cross_{a}_{b}_product and _diff_product of the row means of each modality's *_mean columns.

    Differences start anew in each unit; across_units=True lets them run on over all rows in (unit, cycle) order: a unit's first
    row follows the last row of the unit before, so one task sees a row for each unit.
    """
    means = {m: _row_mean([c for c in df.columns if c.startswith(f"{m}_") and "_mean" in c]) for m in modalities}
    w = ordered(unit, [cycle])
    out = df.select(*unit, cycle, *[v.alias(f"_{m}") for m, v in means.items()])
    before = lambda m: F.lag(f"_{m}").over(w)
    if across_units:
        ends = out.groupBy(*unit).agg(F.max_by(F.struct(*[f"_{m}" for m in means]), cycle).alias("_end"))
        ends = ends.select(*unit, F.lag("_end").over(Window.orderBy(*unit)).alias("_end"))
        out = out.join(ends, unit).withColumn("_first", F.row_number().over(w) == 1)
        before = lambda m: F.when(F.col("_first"), F.col("_end")[f"_{m}"]).otherwise(F.lag(f"_{m}").over(w))
    step = lambda m: F.coalesce(F.col(f"_{m}") - before(m), F.lit(0.0))
    cols = []
    for a, b in combinations(modalities, 2):
        x, y = F.col(f"_{a}"), F.col(f"_{b}")
        cols.append((x * y).alias(f"cross_{a}_{b}_product"))
        cols.append((step(a) * step(b)).alias(f"cross_{a}_{b}_diff_product"))
    return out.select(*unit, cycle, *cols)


def vibration(df: DataFrame, keys: list[str], channels: list[str], rate: float = 12000.0) -> DataFrame:
    """24 features for each channel's window of samples: {channel}_{feature}."""
    out = df.select(*keys, *[F.col(c).cast("array<double>").alias(c) for c in channels])
    for c in channels:
        out = with_magnitudes(out, c, f"{c}_mag")
    cols = []
    for c in channels:
        found = a_time_features(F.col(c)) | a_spectral_features(F.col(f"{c}_mag"), rate, F.size(c))
        cols += [v.alias(f"{c}_{k}") for k, v in found.items()]
    return out.select(*keys, *cols)


def impute(df: DataFrame, columns: list[str], order: list[str], unit: list[str] | None = None) -> DataFrame:
    """Forward fill, then interpolation (leading gaps take the first value), then the column mean, then 0.

    NaN counts as missing. With `unit` the fills stay inside units; without it they run over the whole table in `order`,
    as one sequence, which is one task's work.
    """
    w = ordered(unit, order) if unit else Window.orderBy(*order)
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
    means = clean.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_mean_{c}") for c in columns])
    position = F.row_number().over(w).cast("double")
    filled = clean.withColumn("_pos", position)
    filled = filled.select(*[forward_fill(F.col(c), w).alias(c) if c in columns else F.col(c) for c in filled.columns])
    filled = filled.select(*[interpolate(F.col(c), F.col("_pos"), w).alias(c) if c in columns else F.col(c) for c in filled.columns])
    joined = filled.crossJoin(F.broadcast(means))  # one row
    return joined.select(*[F.coalesce(c, f"_mean_{c}", F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean_{c} and std_{c} (sample standard deviation, 1 where below 1e-12) of each column."""
    stats = []
    for c in columns:
        std = F.coalesce(F.stddev_samp(c), F.lit(1.0))
        stats += [F.avg(c).alias(f"mean_{c}"), F.when(std < TINY, F.lit(1.0)).otherwise(std).alias(f"std_{c}")]
    return df.agg(*stats)


def zscore(df: DataFrame, columns: list[str], stats: DataFrame | None = None) -> DataFrame:
    joined = df.crossJoin(F.broadcast(stats if stats is not None else scaler(df, columns)))  # one row
    return joined.select(*[((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def denormalise(df: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    joined = df.crossJoin(F.broadcast(stats))  # one row
    return joined.select(*[(F.col(c) * F.col(f"std_{c}") + F.col(f"mean_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def quartiles(df: DataFrame, columns: list[str], parts: int = 256) -> DataFrame:
    """One row: _q_{c}, the exact 25th and 75th percentile of each column with linear interpolation; null for a column without values.

    Ranks come in two levels: counts of ranges of values, cut at approximate percentiles, then of the values in those
    ranges alone that hold a wanted rank. No task holds a whole column.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.inline(pairs)).where("v is not null")
    cuts = long.groupBy("feature").agg(F.percentile_approx("v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000)).alias("cuts"), F.count(F.lit(1)).alias("all"))
    values = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(cuts), "feature")  # a row for each column
    placed = values.select("feature", "v", "n", "all", F.size(F.filter("cuts", lambda x: x <= F.col("v"))).alias("r"))
    sums = placed.groupBy("feature", "r").agg(F.sum("n").alias("m"), F.max("all").alias("all"))
    ahead = sums.withColumn("from", F.sum("m").over(Window.partitionBy("feature").orderBy("r")) - F.col("m"))  # `parts` rows for each column
    place = [F.lit(q) * (F.col("all") - 1) for q in (0.25, 0.75)]
    ranks = [F.struct(F.lit(i).alias("q"), F.lit(up).alias("up"), (F.ceil(x) if up else F.floor(x)).alias("rank"), (x - F.floor(x)).alias("part")) for i, x in enumerate(place) for up in (0, 1)]
    wanted = ahead.select("feature", "r", "from", "m", F.inline(F.array(*ranks))).where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("from") + F.col("m")))
    upto = F.sum("n").over(Window.partitionBy("feature", "r").orderBy("v"))
    inside = placed.join(F.broadcast(wanted.select("feature", "r").distinct()), ["feature", "r"], "left_semi").select("feature", "r", "v", "n", upto.alias("upto"))  # four ranges a column
    hits = inside.join(F.broadcast(wanted), ["feature", "r"]).where((F.col("rank") < F.col("from") + F.col("upto")) & (F.col("rank") >= F.col("from") + F.col("upto") - F.col("n")))
    ends = hits.groupBy("feature", "q").agg(F.max("part").alias("part"), *[F.max(F.when(F.col("up") == i, F.col("v"))).alias(c) for i, c in enumerate(("low", "high"))])
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    at = lambda c, i: F.max(F.when((F.col("feature") == c) & (F.col("q") == i), value))
    return ends.groupBy().agg(*[F.array(at(c, 0), at(c, 1)).alias(f"_q_{c}") for c in columns])


def clip_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Clip to [max(q25 - 1.5 iqr, -3), min(q75 + 1.5 iqr, 3)] of each (standardised) column."""
    joined = df.crossJoin(F.broadcast(quartiles(df, columns)))  # one row

    def clipped(c: str) -> Column:
        lo, hi = F.get(f"_q_{c}", 0), F.get(f"_q_{c}", 1)
        return F.least(F.greatest(F.col(c), F.greatest(lo - 1.5 * (hi - lo), F.lit(-3.0))), F.least(hi + 1.5 * (hi - lo), F.lit(3.0)))

    return joined.select(*[clipped(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def preprocess(df: DataFrame, columns: list[str], order: list[str], unit: list[str] | None = None) -> DataFrame:
    """impute, zscore, clip_outliers with one pass for all statistics: quartiles of z follow from those of x.

    The filled table is written, as it is read for the statistics and again for the result.
    """
    filled = settle(impute(df, columns, order, unit), "preprocess-filled")
    stats = quartiles(filled, columns).crossJoin(scaler(filled, columns))  # one row each
    joined = filled.crossJoin(F.broadcast(stats))

    def done(c: str) -> Column:
        z = lambda x: (x - F.col(f"mean_{c}")) / F.col(f"std_{c}")
        lo, hi = z(F.get(f"_q_{c}", 0)), z(F.get(f"_q_{c}", 1))
        return F.least(F.greatest(z(F.col(c)), F.greatest(lo - 1.5 * (hi - lo), F.lit(-3.0))), F.least(hi + 1.5 * (hi - lo), F.lit(3.0)))

    return joined.select(*[done(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def outside(limits: dict[str, tuple[float | None, float | None]]) -> Column:
    """Whether any column is below its low or above its high limit; None is no limit, a null value is inside."""
    tests = [F.col(c) < lo for c, (lo, _) in limits.items() if lo is not None] + [F.col(c) > hi for c, (_, hi) in limits.items() if hi is not None]
    out = F.lit(False)
    for x in tests:
        out = out | F.coalesce(x, F.lit(False))
    return out


def regimes(df: DataFrame, settings: list[str], most: int = 6) -> DataFrame:
    """df plus `regime`: the rank of the settings rounded to two places where they take at most `most` values (else `most` k-means cells).

    A table of fewer than ten rows is regime 0 throughout.
    """
    combo = F.struct(*[F.bround(F.col(c), 2).alias(c) for c in settings])
    tagged = df.withColumn("_combo", combo)
    distinct = tagged.select("_combo").distinct().limit(most + 1)
    n_rows, n_combos = df.limit(10).count(), distinct.count()
    if n_rows < 10 or n_combos <= 1:
        return df.withColumn("regime", F.lit(0))
    if n_combos <= most:
        ranked = distinct.withColumn("regime", F.dense_rank().over(Window.orderBy("_combo")) - 1)
        return tagged.join(F.broadcast(ranked), "_combo").drop("_combo")  # at most `most` rows
    from .cluster import kmeans_labels

    return kmeans_labels(df, settings, most, seed=42).withColumnRenamed("label", "regime")
