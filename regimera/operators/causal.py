"""Which violation precedes which: first appearances, ordered pairs, supported edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_appearances(df: DataFrame, unit: str, cycle: str, violations: str) -> DataFrame:
    """(unit, event, first): the first cycle at which a unit shows each violation of an array column."""
    return df.select(unit, cycle, F.explode(violations).alias("event")).groupBy(unit, "event").agg(F.min(cycle).alias("first"))


def precedence_edges(df: DataFrame, unit: str, cycle: str, violations: str, min_support: float = 0.6) -> DataFrame:
    """(a, b, mean_lead, std_lead, support, p10_lead, text) for pairs that at least min_support of all units show in that order.

    Units without violations count. Events that appear together are ordered by name, with lead 0.
    """
    firsts = first_appearances(df, unit, cycle, violations)
    units = df.agg(F.count_distinct(unit).alias("units"))
    a, b = firsts.alias("a"), firsts.alias("b")
    earlier = (F.col("a.first") < F.col("b.first")) | ((F.col("a.first") == F.col("b.first")) & (F.col("a.event") < F.col("b.event")))
    pairs = a.join(b, (F.col(f"a.{unit}") == F.col(f"b.{unit}")) & earlier).select(F.col("a.event").alias("a"), F.col("b.event").alias("b"), (F.col("b.first") - F.col("a.first")).cast("double").alias("lead"))
    edges = pairs.groupBy("a", "b").agg(F.avg("lead").alias("mean_lead"), F.stddev_pop("lead").alias("std_lead"), F.count(F.lit(1)).alias("n"), F.percentile("lead", F.lit(0.1)).alias("p10_lead"))
    out = edges.crossJoin(F.broadcast(units))  # one row
    out = out.withColumn("support", F.col("n") / F.col("units")).where(F.col("support") >= min_support)
    text = F.format_string("%s precedes %s by %.1f cycles on average in %.0f%% of units", "a", "b", "mean_lead", F.col("support") * 100)
    return out.select("a", "b", "mean_lead", "std_lead", "support", "p10_lead", text.alias("text"))
