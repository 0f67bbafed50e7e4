"""Count-based windows, run lengths, n-grams and fills. One exchange on the unit key serves all of them.

Units are partition keys: a run of windows needs its unit's rows in order, so a unit is the smallest unit of work; rows
of different units never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(unit: list[str], order: list[str]):
    return Window.partitionBy(*unit).orderBy(*order)


def array_windows(df: DataFrame, samples: str, size: int, overlap: float = 0.5) -> DataFrame:
    """Fixed overlapping windows of an array column: window_id from 0, step int(size * (1 - overlap)), the partial tail dropped."""
    step = int(size * (1 - overlap))
    last = F.size(samples) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rest = [c for c in df.columns if c != samples]
    out = df.select(*rest, samples, F.posexplode(starts).alias("window_id", "start"))
    return out.select(*rest, F.col("window_id").cast("long").alias("window_id"), "start", F.slice(samples, F.col("start") + 1, F.lit(size)).alias(samples))


def full_windows(df: DataFrame, unit: list[str], order: str, size: int, stride: int, features: dict[str, object]) -> DataFrame:
    """Trailing windows of `size` rows per unit, every stride-th full one, keyed by the row at start + size // 2.

    features: name -> function of the window (a WindowSpec) giving a Column.
    """
    w = ordered(unit, [order])
    frame = w.rowsBetween(-(size - 1), 0)
    named = df.withColumn("_n", F.row_number().over(w)).withColumn("_c", F.lag(order, size - 1 - size // 2).over(w) if size - 1 - size // 2 else F.col(order))
    made = named.select(*unit, "_n", "_c", *[f(frame).alias(k) for k, f in features.items()])
    full = made.where((F.col("_n") >= size) & ((F.col("_n") - size) % stride == 0))
    return full.select(*unit, F.col("_c").alias(order), *features)


def first_difference(c: Column, w) -> Column:
    """x - previous x, 0 in the first row."""
    return F.coalesce(c - F.lag(c).over(w), F.lit(0.0))


def adjacent_pairs(df: DataFrame, unit: list[str], order: list[str], value: str) -> DataFrame:
    """(unit, from_mode, to_mode) for each row and its successor."""
    w = ordered(unit, order)
    return df.select(*unit, F.col(value).alias("from_mode"), F.lead(value).over(w).alias("to_mode")).where("to_mode is not null")


def run_lengths(df: DataFrame, unit: list[str], order: list[str], value: str) -> DataFrame:
    """(unit, run_id, value, start_pos, length): maximal runs of equal values; an empty input has none."""
    w = ordered(unit, order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", changed).withColumn("_pos", F.row_number().over(w))
    marked = marked.withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*unit, "run_id").agg(
        F.first(value).alias(value), F.min("_pos").cast("long").alias("start_pos"), F.count(F.lit(1)).alias("length")
    )


def run_ngrams(runs: DataFrame, unit: list[str], value: str, n: int = 3) -> DataFrame:
    """n-grams over consecutive runs, for units with more than n runs: (unit, g0 .. g{n-1})."""
    w = Window.partitionBy(*unit).orderBy("run_id")
    whole = Window.partitionBy(*unit)
    grams = runs.select(*unit, F.count(F.lit(1)).over(whole).alias("_runs"), *[F.lead(value, i).over(w).alias(f"g{i}") if i else F.col(value).alias("g0") for i in range(n)])
    return grams.where((F.col("_runs") > n) & F.col(f"g{n - 1}").isNotNull()).drop("_runs")


def forward_fill(c: Column, w) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(c: Column, w) -> Column:
    return F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def interpolate(c: Column, position: Column, w) -> Column:
    """Linear interpolation between the known neighbours; ends take the nearest known value."""
    known = F.when(c.isNotNull(), position)
    lo, hi = forward_fill(c, w), backward_fill(c, w)
    lo_at, hi_at = forward_fill(known, w), backward_fill(known, w)
    between = lo + (hi - lo) * F.coalesce((position - lo_at) / F.nullif(hi_at - lo_at, F.lit(0)), F.lit(0.0))
    return F.coalesce(c, between, lo, hi)


def last_slope(df: DataFrame, unit: list[str], order: str, value: str, last: int = 50) -> DataFrame:
    """(unit, slope): least-squares slope of the last `last` values, 0.0 where a unit has fewer."""
    w = Window.partitionBy(*unit).orderBy(F.desc(order))
    recent = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    slope = F.when(F.count(F.lit(1)) >= last, F.coalesce(F.regr_slope(value, -F.col("_r")), F.lit(0.0))).otherwise(F.lit(0.0))
    return recent.groupBy(*unit).agg(slope.alias("slope"))
