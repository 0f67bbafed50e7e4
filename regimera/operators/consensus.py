"""Confidence-weighted consensus over per-modality labels, kept in one long table (row_id, modality, label, prob)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOISE = -1


def arbitrate(votes: DataFrame, modalities: list[str], conflict_threshold: float = 0.3) -> DataFrame:
    """(row_id, winner, label, conflict, dominance): one aggregation by row.

    Noise has no vote. Every modality votes for its own label with its probability; the heaviest vote wins, ties to the
    modality listed first. A row conflicts if the winner's share is below 1 - conflict_threshold, or nobody votes.
    label is the dense rank of the winning key (stable, unlike a salted hash), -1 where nobody votes.
    """
    w = F.when(F.col("label") == NOISE, F.lit(0.0)).otherwise(F.col("prob").cast("double"))
    place = F.array_position(F.array(*[F.lit(m) for m in modalities]), F.col("modality"))
    key = F.concat_ws(":", "modality", F.col("label").cast("string"))
    long = votes.select("row_id", "modality", w.alias("w"), F.when(F.col("label") != NOISE, key).alias("key"), (-place).alias("rank"))
    agg = long.groupBy("row_id").agg(
        F.sum("w").alias("total"),
        F.max_by("key", F.when(F.col("key").isNotNull(), F.struct("w", "rank"))).alias("winner"),
        F.max(F.when(F.col("key").isNotNull(), F.col("w"))).alias("best"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "w")))).alias("weights"),
    )
    silent = F.col("total") < 1e-12
    safe = F.when(~silent, F.col("total"))
    out = agg.select(
        "row_id",
        F.when(~silent, F.col("winner")).alias("winner"),
        F.coalesce(F.col("best") / safe < 1.0 - conflict_threshold, F.lit(True)).alias("conflict"),
        F.transform_values("weights", lambda k, v: F.coalesce(v / safe, F.lit(0.0))).alias("dominance"),
    )
    # Winning keys are as many as modalities x clusters, so ranking them is one small task.
    ranks = out.where("winner is not null").select("winner").distinct().withColumn("label", F.dense_rank().over(Window.orderBy("winner")).cast("long") - 1)
    return out.join(ranks, "winner", "left").select("row_id", "winner", F.coalesce("label", F.lit(-1).cast("long")).alias("label"), "conflict", "dominance")


def dominance_by_mode(consensus: DataFrame, modes: DataFrame, modalities: list[str], mode: str = "mode_id") -> DataFrame:
    """(mode_id, modality, dominance): mean dominance of each mode's rows; a mode without rows is uniform.

    modes: (row_id, mode_id) for assigned rows, plus rows with a null row_id for modes that must be listed.
    """
    joined = modes.join(consensus.select("row_id", "dominance"), "row_id", "left")
    return joined.groupBy(mode).agg(*[F.avg(F.col("dominance")[m]).alias(m) for m in modalities]).select(
        mode, F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in modalities]), F.array(*[F.coalesce(m, F.lit(1.0 / len(modalities))) for m in modalities]))).alias("modality", "dominance")
    )


def agreement(df: DataFrame, labels: list[str], confidences: list[str]) -> DataFrame:
    """One row over three label columns: odd-one-out rates, complete disagreement, confidence of the strongest modality, dominance shares and their entropy in bits."""
    a, b, c = (F.col(x) for x in labels)
    rate = lambda cond: F.avg(cond.cast("double"))
    top = F.greatest(*confidences)
    first = F.coalesce(*[F.when(F.col(x) == top, F.lit(x)) for x in confidences])
    df = df.withColumn("_top", top).withColumn("_first", first)
    shares = [rate(F.col("_first") == x) for x in confidences]
    entropy = -sum((F.coalesce(s * F.log2(F.when(s > 0, s)), F.lit(0.0)) for s in shares), F.lit(0.0))
    return df.agg(
        rate((b == c) & (a != b)).alias("odd_0"), rate((a == c) & (b != c)).alias("odd_1"), rate((a == b) & (a != c)).alias("odd_2"),
        rate((a != b) & (a != c) & (b != c)).alias("disagreement"),
        F.avg("_top").alias("mean_confidence"), F.stddev_samp("_top").alias("std_confidence"),
        *[s.alias(f"dominance_{i}") for i, s in enumerate(shares)],
        entropy.alias("dominance_entropy"), F.lit(1.0).alias("voting_consistency"),
    )


def voted_label(labels: list[str], confidences: list[str]) -> Column:
    """The label of the most confident modality, ties to the first."""
    top = F.greatest(*confidences)
    return F.coalesce(*[F.when(F.col(c) == top, F.col(x)) for x, c in zip(labels, confidences)])


def noise_ratio(label: str = "label") -> Column:
    return F.avg((F.col(label) == NOISE).cast("double"))


def n_clusters(label: str = "label") -> Column:
    return F.count_distinct(F.when(F.col(label) != NOISE, F.col(label)))
