"""Constraint rules as columns: feasibility, fault states, risk, labels and ranks of operating modes.

A rule is a pure function of (centroid, parameters) giving three Columns: applicable, passed, text. Nothing is decided by
searching explanation strings; texts are built only in the report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import corr0
from .windows import first_difference, ordered

RULES = ("joule_heating", "vibration_bounds", "thermal_rate", "efficiency", "cross_modal_coherence", "speed_bounds", "egt_limit")
#: Violations the taxonomy is asked about; the others are dropped before the lookup.
TAXONOMY_NAMES = ("joule_heating", "vibration_bounds", "cross_modal_coherence", "speed_bounds", "egt_limit")
#: Violation pattern, label, severity, action, interpretation.
TAXONOMY = (
    ((), "Normal Operation", "NOMINAL", "None", "Every rule holds"),
    (("joule_heating",), "Electrothermal Stress", "WARNING", "Check cooling and load current", "Hotter than the current explains"),
    (("vibration_bounds",), "Mechanical Imbalance / Bearing Wear", "WARNING", "Plan a bearing inspection", "Vibration beyond the limit at normal load"),
    (("cross_modal_coherence",), "Sensor Disagreement / Mixed-Regime Cluster", "DATA_QUALITY", "Check calibration or cluster more finely", "Channels that should move together do not"),
    (("joule_heating", "vibration_bounds"), "Coupled Electromechanical Fault", "CRITICAL", "Inspect at once", "Heat and vibration are both excessive"),
    (("cross_modal_coherence", "joule_heating"), "Thermal Runaway Onset", "CRITICAL", "Reduce the load now", "Heat builds up without its usual cause"),
    (("cross_modal_coherence", "vibration_bounds"), "Mechanical Fault with Sensor Artifact", "WARNING", "Check the vibration sensor and the mechanics", "Vibration alone, out of step with the rest"),
    (("cross_modal_coherence", "joule_heating", "vibration_bounds"), "Complete System Degradation", "CRITICAL", "Shut down", "Every rule family is violated"),
)
UNKNOWN = ("Unknown State", "UNCLASSIFIED", "Inspect by hand", "No taxonomy row for this pattern")


@dataclass(frozen=True)
class Rule:
    applicable: Column
    passed: Column
    text: Column


def _q(q: Column, key: str, default: float) -> Column:
    return F.coalesce(F.try_element_at(q, F.lit(key)), F.lit(float(default)))


def rules(q: Column, p: dict) -> dict[str, Rule]:
    """All seven rules over a MAP<STRING, DOUBLE> centroid; which apply follows from the parameter set's domain."""
    motor, engine = p["domain"] == "electromechanical", p["domain"] == "turbofan"
    yes, no = F.lit(True), F.lit(False)
    none = Rule(no, yes, F.lit("not applicable"))
    out = dict.fromkeys(RULES, none)

    def bound(value: Column, limit: Column, unit: str) -> Rule:
        ok = value <= limit
        return Rule(yes, ok, F.format_string(f"%.3f {unit} against %.3f: %s", value, limit, F.when(ok, "pass").otherwise("fail")))

    if motor:
        t, i = _q(q, "temperature", p["T_ambient_celsius"]), _q(q, "current", p["rated_current_A"])
        heat = i * i * p["R_stator_ohm"] / (p["h_conv_W_m2K"] * p["A_surface_m2"])
        out["joule_heating"] = bound(t, F.lit(float(p["T_ambient_celsius"])) + heat + p["epsilon_joule"], "C")
        out["vibration_bounds"] = bound(_q(q, "vibration_rms", 0), F.lit(float(p["a_max_g_ISO10816"])), "g")
        out["thermal_rate"] = bound(F.abs(_q(q, "thermal_rate", 0)), F.lit(float(p["max_dT_per_sec"])), "C/s")
        out["efficiency"] = bound(_q(q, "efficiency", p["eta_nominal"]), F.lit(float(p["eta_nominal"] + p["epsilon_efficiency"])), "")
    if motor or engine:
        key, least = ("correlation_I_T", p.get("min_correlation_I_T")) if motor else ("correlation_fuel_T50", p.get("min_correlation_fuel_T50", 0.5))
        c = _q(q, key, 0)
        ok = c >= float(least)
        out["cross_modal_coherence"] = Rule(yes, ok, F.format_string(f"correlation %.3f against {least}: %s", c, F.when(ok, "pass").otherwise("fail")))
    if engine:
        b = p.get("speed_bounds", {})
        nf, nc = _q(q, "Nf", 0), _q(q, "Nc", 0)
        nf_max, nc_max = float(b.get("Nf_max_rpm", 99999)), float(b.get("Nc_max_rpm", 99999))
        over = F.concat_ws(", ", F.when(nf > nf_max, F.format_string(f"Nf %.0f > {nf_max:.0f}", nf)), F.when(nc > nc_max, F.format_string(f"Nc %.0f > {nc_max:.0f}", nc)))
        out["speed_bounds"] = Rule(yes, (nf <= nf_max) & (nc <= nc_max), F.when(over == "", F.lit("within bounds: pass")).otherwise(over))
        out["egt_limit"] = bound(_q(q, "T50", 0), F.lit(float(p.get("EGT_limit_R", 99999))), "R")
    return out


def severities(q: Column, p: dict) -> list[tuple[str, Column, float]]:
    """(rule, severity, weight) of the risk score; the heating limit is taken without its tolerance."""

    def excess(value: Column, limit: Column) -> Column:
        return F.when(limit > 0, F.greatest(F.lit(0.0), F.try_divide(value - limit, limit))).otherwise(F.lit(0.0))

    def shortfall(c: Column, least: float) -> Column:
        return F.when(c < least, (F.lit(float(least)) - c) / float(least)).otherwise(F.lit(0.0))

    if p["domain"] == "electromechanical":
        i = _q(q, "current", p["rated_current_A"])
        limit = F.lit(float(p["T_ambient_celsius"])) + i * i * p["R_stator_ohm"] / (p["h_conv_W_m2K"] * p["A_surface_m2"])
        return [
            ("joule_heating", excess(_q(q, "temperature", p["T_ambient_celsius"]), limit), 0.35),
            ("vibration_bounds", excess(_q(q, "vibration_rms", 0), F.lit(float(p["a_max_g_ISO10816"]))), 0.30),
            ("cross_modal_coherence", shortfall(_q(q, "correlation_I_T", 0), p["min_correlation_I_T"]), 0.35),
        ]
    if p["domain"] == "turbofan":
        b = p.get("speed_bounds", {})
        return [
            ("speed_bounds", excess(_q(q, "Nf", 0), F.lit(float(b.get("Nf_max_rpm", 99999)))), 0.4),
            ("egt_limit", excess(_q(q, "T50", 0), F.lit(float(p.get("EGT_limit_R", 99999)))), 0.4),
            ("cross_modal_coherence", shortfall(_q(q, "correlation_fuel_T50", 0), p.get("min_correlation_fuel_T50", 0.5)), 0.2),
        ]
    return []


def taxonomy(spark: SparkSession) -> DataFrame:
    """The eight taxonomy rows, keyed by the sorted violation pattern."""
    rows = [(",".join(sorted(k)), *rest) for k, *rest in TAXONOMY]
    return spark.createDataFrame(rows, "pattern string, label string, severity string, action string, interpretation string")


def filter_modes(centroids: DataFrame, p: dict, dominance: DataFrame | None = None) -> DataFrame:
    """centroids: (mode_id, q). Feasibility, fault state, violations, risk, dominant factor, label and rank of each mode.

    A vibration violation marks a fault state, which stays feasible whatever else is violated. Ranks fall by risk, ties by
    mode_id; they are over modes, a small table. dominance: (mode_id, signature MAP) adds the leading modality to the label.
    """
    spark, q = centroids.sparkSession, F.col("q")
    found = rules(q, p)
    violated = F.filter(F.array(*[F.when(r.applicable & ~r.passed, F.lit(n)) for n, r in found.items()]), lambda x: x.isNotNull())
    parts = severities(q, p)
    total = sum(w for _, _, w in parts)
    risk = F.least(F.lit(1.0), sum((s * w for _, s, w in parts), F.lit(0.0)) / total) if parts else F.lit(0.0)
    top = F.greatest(*[s for _, s, _ in parts]) if parts else F.lit(0.0)
    dominant = F.coalesce(*[F.when(s == top, F.lit(n)) for n, s, _ in parts]) if parts else F.lit(None).cast("string")
    known = F.array_sort(F.array_intersect("violated", F.array(*[F.lit(n) for n in TAXONOMY_NAMES])))
    details = F.array(*[F.struct(F.lit(n).alias("name"), r.applicable.alias("applicable"), r.passed.alias("passed"), r.text.alias("text")) for n, r in found.items()])
    out = centroids.select("*", violated.alias("violated"), risk.alias("risk_score"), dominant.alias("dominant_risk"), details.alias("details"))
    fault = F.array_contains("violated", "vibration_bounds")
    out = out.withColumn("is_fault_state", fault).withColumn("feasible", fault | (F.size("violated") == 0)).withColumn("pattern", F.array_join(known, ","))
    out = out.join(F.broadcast(taxonomy(spark)), "pattern", "left")  # eight rows
    for name, default in zip(("label", "severity", "action", "interpretation"), UNKNOWN):
        out = out.withColumn(name, F.coalesce(name, F.lit(default)))
    if dominance is not None:
        out = out.join(dominance, "mode_id", "left")
        best = F.array_max(F.transform(F.map_entries("signature"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]
        out = out.withColumn("label", F.when(F.size("signature") > 0, F.format_string("%s [%s-dominant]", F.col("label"), F.upper(best))).otherwise(F.col("label"))).drop("signature")
    return out.withColumn("risk_rank", F.row_number().over(Window.orderBy(F.desc("risk_score"), "mode_id")).cast("long")).drop("pattern")


def coherence_rate(filtered: DataFrame) -> DataFrame:
    return filtered.agg(F.coalesce(F.avg(F.col("feasible").cast("double")), F.lit(0.0)).alias("coherence_rate"))


def synthesis_modes(filtered: DataFrame) -> DataFrame:
    """(mode_id, kind): the fault and the infeasible modes, which synthetic samples are drawn for."""
    kind = F.when(F.col("is_fault_state"), "fault").when(~F.col("feasible"), "infeasible")
    return filtered.select("mode_id", kind.alias("kind")).where("kind is not null")


def motor_proxies(z: DataFrame, p: dict, rms: str | None, mean: str | None, kurtosis: str | None) -> DataFrame:
    """(mode_id, q): physical proxies from standardised centroid columns; a missing column takes the default."""
    pick = lambda c, f, d: f(F.col(c)) if c else F.lit(float(d))
    q = {
        "vibration_rms": pick(rms, F.abs, 0.1),
        "temperature": pick(mean, lambda x: x * 10 + 40, 35.0),
        "current": pick(mean, lambda x: F.abs(x) * 2 + 1, p["rated_current_A"]),
        "thermal_rate": pick(kurtosis, lambda x: F.abs(x) * 0.5, 0.5),
        "efficiency": F.lit(float(p["eta_nominal"])),
        "correlation_I_T": F.lit(0.6),
    }
    return z.select("mode_id", F.create_map(*[x for k, v in q.items() for x in (F.lit(k), v.cast("double"))]).alias("q"))


def engine_proxies(z: DataFrame, nf: str | None, nc: str | None, t50: str | None) -> DataFrame:
    pick = lambda c, a, b, d: F.abs(F.col(c)) * a + b if c else F.lit(float(d))
    q = {"Nf": pick(nf, 500, 2000, 2100), "Nc": pick(nc, 1000, 8000, 8500), "T50": pick(t50, 200, 1200, 1350), "correlation_fuel_T50": F.lit(0.55)}
    return z.select("mode_id", F.create_map(*[x for k, v in q.items() for x in (F.lit(k), v.cast("double"))]).alias("q"))


def sample_allowed(q: Column, p: dict) -> Column:
    """The predicate a synthetic candidate must meet; keys it lacks pass."""
    below = lambda key, limit: F.coalesce(F.try_element_at(q, F.lit(key)) <= limit, F.lit(True))
    if p["domain"] == "turbofan":
        b = p.get("speed_bounds", {})
        return below("Nf", float(b.get("Nf_max_rpm", 99999))) & below("Nc", float(b.get("Nc_max_rpm", 99999))) & below("T50", float(p.get("EGT_limit_R", 99999)))
    i, t = F.try_element_at(q, F.lit("current")), F.try_element_at(q, F.lit("temperature"))
    limit = p["T_ambient_celsius"] + i * i * p["R_stator_ohm"] / (p["h_conv_W_m2K"] * p["A_surface_m2"]) + p["epsilon_joule"]
    return F.coalesce(t <= limit, F.lit(True)) & below("vibration", float(p["a_max_g_ISO10816"]))


def row_metrics(df: DataFrame, unit: list[str], order: str, time_step: float = 1.0, active: bool = True) -> DataFrame:
    """df (temperature, current, vibration) plus row violations; with active=False only the vibration rule is evaluated."""
    w = ordered(unit, [order])
    t, i = F.col("temperature"), F.col("current")
    out = df.withColumn("dT", first_difference(t, w) / time_step)
    error = F.abs(F.col("dT") - (0.05 * i * i - 0.05 * (t - 25.0)))
    out = out.withColumn("energy_error", error if active else F.lit(None).cast("double"))
    out = out.withColumn("thermal_violation", F.abs("dT") > 5.0 if active else F.lit(False)).withColumn("energy_violation", F.coalesce(F.col("energy_error") > 10.0, F.lit(False)))
    out = out.withColumn("vibration_violation", F.col("vibration") > 1.5)
    return out.withColumn("violation", F.col("thermal_violation") | F.col("energy_violation") | F.col("vibration_violation"))


def violation_summary(rows: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_rate")
    return rows.agg(F.avg("energy_error").alias("mean_energy_error"), *[rate(c) for c in ("thermal_violation", "energy_violation", "vibration_violation", "violation")])


def coupling(df: DataFrame, unit: list[str], order: str, a: str, b: str) -> DataFrame:
    """Correlation of the first differences of two channels, the first difference of a unit being 0."""
    w = ordered(unit, [order])
    d = df.select(first_difference(F.col(a), w).alias("x"), first_difference(F.col(b), w).alias("y"))
    return d.agg(corr0(F.col("x"), F.col("y")).alias("coupling"))


def feasibility_by_mode(rows: DataFrame, mode: str) -> DataFrame:
    return rows.groupBy(mode).agg(F.avg((~F.col("violation")).cast("double")).alias("feasibility"))


def rejected_share(by_mode: DataFrame, least: float = 0.95) -> DataFrame:
    return by_mode.agg(F.coalesce(F.avg((F.col("feasibility") < least).cast("double")), F.lit(0.0)).alias("rejected_share"))
