"""Pattern library queries and cross-dataset alignment of mode fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import a_sum, cosine_arrays, cosine_maps, normalise_map

ROLES = ("thermal", "electrical_pressure", "mechanical")
#: The role of each modality name; names not listed are mechanical.
ROLE_OF = {
    "temperature": "thermal", "T_group": "thermal", "thermal": "thermal",
    "current": "electrical_pressure", "P_group": "electrical_pressure", "pressure": "electrical_pressure",
    "vibration": "mechanical", "vibration_de": "mechanical", "vibration_fe": "mechanical", "M_group": "mechanical", "mechanical": "mechanical",
}
CONSTRAINTS = ("joule_heating", "vibration_bounds", "cross_modal_coherence", "speed_bounds", "egt_limit")


def library_entries(modes: DataFrame, source: str) -> DataFrame:
    """modes: (mode_id, dominance MAP, label, risk_score). Library rows; a conflict vector is what each modality lacks of 1."""
    vector = F.transform_values("dominance", lambda k, v: F.greatest(F.lit(0.0), 1.0 - v))
    out = modes.select(vector.alias("conflict_vector"), "label", "risk_score")
    return out.select(
        "conflict_vector", normalise_map(F.col("conflict_vector")).alias("vector_normalized"), F.col("label").alias("outcome_label"),
        F.lit(source).alias("dataset_source"), "risk_score", F.lit(False).alias("confirmed"),
    )


def matches(queries: DataFrame, library: DataFrame, top_k: int = 3, entry: str = "entry_id") -> DataFrame:
    """queries: (query_id, vector). The top_k library rows by cosine over the union of keys, ties to the higher entry id.

    The library is the large side and is scanned once; queries are few and joined to every row, then ranked per query with
    a partial top-k, so a row per query and partition at most top_k crosses the shuffle.
    """
    q = queries.select("query_id", normalise_map(F.col("vector")).alias("qv"))
    scored = library.join(F.broadcast(q)).select("query_id", entry, "outcome_label", "dataset_source", "risk_score", F.coalesce(cosine_maps(F.col("vector_normalized"), F.col("qv")), F.lit(0.0)).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc(entry))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def predict(found: DataFrame, label: str = "outcome_label") -> DataFrame:
    """(query_id, predicted, confidence): similarity-weighted vote, ties to the label of the best-ranked match."""
    by = found.groupBy("query_id", label).agg(F.sum("similarity").alias("s"), F.min("rank").alias("r"))
    return by.groupBy("query_id").agg(
        F.max_by(label, F.struct("s", -F.col("r"))).alias("predicted"), F.coalesce(F.try_divide(F.max("s"), F.sum("s")), F.lit(0.0)).alias("confidence")
    )


def role_shares(dominance: Column) -> Column:
    """Array of the three role shares of a modality -> dominance map, summing to 1 unless all are 0."""
    role = F.create_map(*[F.lit(x) for pair in ROLE_OF.items() for x in pair])
    entries = F.map_entries(dominance)

    def held(r: str) -> Column:
        mine = F.filter(entries, lambda e: F.coalesce(F.try_element_at(role, e["key"]), F.lit("mechanical")) == r)
        return a_sum(F.transform(mine, lambda e: e["value"]))

    sums = F.array(*[held(r) for r in ROLES])
    total = a_sum(sums)
    return F.transform(sums, lambda s: F.when(total > 0, s / total).otherwise(s))


def fingerprint(violations: Column, dominance: Column, risk: Column, vocabulary: tuple[str, ...] = CONSTRAINTS) -> Column:
    """Violation bits, role shares, risk. The vocabulary defaults to the names the rules emit."""
    bits = F.array(*[F.array_contains(violations, c).cast("double") for c in vocabulary])
    return F.concat(bits, role_shares(dominance), F.array(F.coalesce(risk, F.lit(0.0))))


def align(a: DataFrame, b: DataFrame, threshold: float = 0.75) -> DataFrame:
    """a, b: (mode_id, fp). The most similar b-mode of each a-mode, from `threshold` on; ties to the least mode id.

    Modes are few (tens to hundreds), so all pairs of modes are compared; zero fingerprints match nothing.
    """
    pairs = a.select(F.col("mode_id").alias("mode_a"), F.col("fp").alias("fa")).join(F.broadcast(b.select(F.col("mode_id").alias("mode_b"), F.col("fp").alias("fb"))))
    scored = pairs.withColumn("similarity", cosine_arrays(F.col("fa"), F.col("fb"))).where("similarity > 0")
    best = Window.partitionBy("mode_a").orderBy(F.desc("similarity"), "mode_b")
    top = scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").where(F.col("similarity") >= threshold)
    return top.select("mode_a", "mode_b", "similarity")
