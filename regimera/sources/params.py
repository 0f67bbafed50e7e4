"""Constraint parameters: fixed values of the two shipped domains, and a JSON reader for others."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

#: Fixed values of the electromechanical domain.
MOTOR = {
    "motor_hp": 2, "R_stator_ohm": 2.1, "rated_current_A": 3.8, "T_ambient_celsius": 25, "T_max_insulation_celsius": 120,
    "h_conv_W_m2K": 15, "A_surface_m2": 0.18, "eta_nominal": 0.84, "a_max_g_ISO10816": 0.46, "thermal_time_constant_sec": 360,
    "shaft_freq_hz": 29.95, "ball_pass_outer_hz": 107.36, "ball_pass_inner_hz": 162.18, "min_correlation_I_T": 0.5,
    "epsilon_joule": 5.0, "epsilon_efficiency": 0.05, "max_dT_per_sec": 2.0, "domain": "electromechanical",
    "constraint_activation": {
        "joule_heating": False, "power_balance": False, "vibration_bounds": True, "thermal_inertia": False,
        "cross_modal_coupling": {"active": True, "mode": "vibration_coherence", "channels": ["vibration_de", "vibration_fe"], "min_correlation": 0.60},
    },
}
#: Fixed values of the turbofan domain.
TURBOFAN = {
    "speed_bounds": {"Nf_max_rpm": 2500, "Nc_max_rpm": 9100}, "EGT_limit_R": 1600, "min_correlation_fuel_T50": 0.5, "domain": "turbofan",
    "thermal_indices": [0, 1, 2, 3], "pressure_indices": [4, 5, 6], "mechanical_indices": [7, 8, 14],
    "sensor_names": {
        "s1": "T2", "s2": "T24", "s3": "T30", "s4": "T50", "s5": "P2", "s6": "P15", "s7": "P30", "s8": "Nf", "s9": "Nc", "s10": "epr", "s11": "Ps30",
        "s12": "phi", "s13": "NRf", "s14": "NRc", "s15": "BPR", "s16": "farB", "s17": "htBleed", "s18": "Nf_dmd", "s19": "PCNfR_dmd", "s20": "W31", "s21": "W32",
    },
    "constraint_activation": {
        "joule_heating": False, "power_balance": True, "vibration_bounds": False, "thermal_inertia": True,
        "cross_modal_coupling": {"active": True, "mode": "current_temperature", "channels": ["T_group", "P_group"], "min_correlation": 0.50},
    },
}
REQUIRED = {
    "electromechanical": ("R_stator_ohm", "rated_current_A", "T_ambient_celsius", "h_conv_W_m2K", "A_surface_m2", "eta_nominal", "a_max_g_ISO10816", "min_correlation_I_T", "epsilon_joule", "epsilon_efficiency", "max_dT_per_sec"),
    "turbofan": (),
}


def validate(params: dict) -> dict:
    """Rejects parameter sets of unknown domain or with missing keys, at load time rather than in a rule."""
    domain = params.get("domain")
    if domain not in REQUIRED:
        raise ValueError(f"unknown domain {domain!r}")
    missing = [k for k in REQUIRED[domain] if k not in params]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    return params


def load(spark: SparkSession, path: str) -> dict:
    """A parameter file in JSON from any store Spark reads."""
    return validate(json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())))


def active(params: dict, rule: str) -> bool:
    """Whether constraint_activation switches a rule on; a rule it does not name is on."""
    value = params.get("constraint_activation", {}).get(rule, True)
    return bool(value.get("active", True)) if isinstance(value, dict) else bool(value)


def modality_columns(params: dict) -> dict[str, list[str]]:
    """Sensor column names by modality, renamed by the sensor map."""
    names = params.get("sensor_names", {})
    pick = lambda key: [names.get(f"s{i + 1}", f"s{i + 1}") for i in params.get(key, [])]
    return {m: pick(f"{m}_indices") for m in ("thermal", "pressure", "mechanical")}
