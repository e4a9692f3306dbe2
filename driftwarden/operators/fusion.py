"""Evidence and its fusion, first and second version, as row-local expressions over the features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.functions.columns import bounded, case, clip, first_greatest, flag, zero
from driftwarden.schema import SENSORS

# Weights and limits of the fusion.
WEIGHTS = {"temporal": 0.20, "statistical": 0.20, "multivariate": 0.25, "stability": 0.10, "missing": 0.15, "model": 0.10}
COHERENT = 2.0
SUPPRESSION = 0.5
SCALES_V2 = {"temporal": 25.0, "statistical": 30.0, "multivariate": 30.0, "stability": 6.0, "drift": 3.5}
Z_CAP = 50.0
DRIFT_LEAST = 0.3
LOST, LOST_LEAST = (1.0, 0.6), 0.5
MODEL_CAP = 0.20
AGREEMENT = 0.30
BONUS = 0.10
SEVERITY = ((0.50, "NORMAL"), (0.70, "LOW"), (0.85, "MEDIUM"), (0.95, "HIGH"))
SUDDEN, PERSISTENT, COMMUNICATION, NORMAL = "SUDDEN_EVENT", "PERSISTENT_SENSOR_FAULT", "DATA_LOSS_COMMUNICATION", "NORMAL"

# Texts of the result contract.
V1_TEXTS = {
    "temporal": "Unusual rate of change or temporal deviation",
    "statistical": "Large statistical deviation",
    "multivariate": "High multivariate disagreement indicating isolated sensor fault",
    "stability": "Persistent unchanged value increased stability anomaly evidence",
    "suppressed": "High raw deviation but strong multivariate consistency reduced sensor-fault suspicion",
    "any_missing": "Sensor missing; communication/data-loss event",
    "all_missing": "All sensors missing; probable communication/data-loss event",
    "none": "No strong evidence",
}
V2_TEXTS = {
    "all_missing": "All three sensor values are missing at this timestamp.",
    "any_missing": "Partial telemetry loss detected.",
    "FROZEN": "Sensor values remained unchanged for an extended period.",
    "DRIFT": "Sensors exhibit sustained drift from the expected baseline.",
    "UNKNOWN": "Persistent sensor fault detected.",
    "MULTIVARIATE_INCONSISTENCY": "Sensor disagrees strongly with the recent multivariate pattern.",
    "SPIKE": "Sensor reading changed abruptly within a short time window.",
    "OFFSET": "Sensor reading deviation is unusually high relative to its baseline.",
    "suffix": " (Anomaly likelihood reduced because sensor movement is consistent with recent multivariate behavior.)",
}


def largest(suffix: str) -> Column:
    return zero(F.greatest(*(F.abs(f"{s}_{suffix}") for s in SENSORS)))


def disagreement() -> Column:
    return zero(F.abs("multivariate_z_disagreement"))


def coherent(no_missing: Column) -> Column:
    return (disagreement() < COHERENT) & no_missing


def evidence_v1(df: DataFrame) -> DataFrame:
    """Adds ``e1_*``; the model's evidence (``model_evidence``) is expected or taken as 0."""
    any_missing, all_missing = F.col("any_sensor_missing") == 1, F.col("all_sensors_missing") == 1
    return df.withColumns(
        {
            "e1_temporal": bounded(largest("rate_per_hour"), 10.0),
            "e1_statistical": bounded(F.least(largest("roll_z_60m"), F.lit(100.0)), 4.0),
            "e1_multivariate": bounded(disagreement(), 4.0),
            "e1_stability": bounded(F.greatest(*(F.col(f"{s}_consec_unchanged") for s in SENSORS)).cast("double"), 80.0),
            "e1_missing": F.when(all_missing, 1.0).when(any_missing, 0.5).otherwise(0.0),
            "e1_model": F.col("model_evidence") if "model_evidence" in df.columns else F.lit(0.0),
        }
    )


def fuse_v1(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Adds base score, context, final score, confidence and, with a threshold, prediction and explanation."""
    e = {k: F.col(f"e1_{k}") for k in WEIGHTS}
    base = sum((e[k] * w for k, w in list(WEIGHTS.items())[1:]), e["temporal"] * WEIGHTS["temporal"])
    out = df.withColumn("base_score", base).withColumn("contextual_consistency", 1.0 - e["multivariate"])
    out = out.withColumn("suppression_factor", F.when(coherent(e["missing"] == 0), SUPPRESSION).otherwise(1.0))
    score = F.col("base_score") * F.col("suppression_factor")
    score = clip(F.when(F.col("all_sensors_missing") == 1, clip(score + 0.8, 0.0, 1.0)).otherwise(score), 0.0, 1.0)
    active = sum((flag(x > 0.2) for x in list(e.values())[1:]), flag(e["temporal"] > 0.2))
    out = out.withColumns({"hybrid_anomaly_score": score, "v1_confidence": F.least(active / 3.0, F.lit(1.0))})
    if threshold is None:
        return out
    four = [(k, e[k]) for k in ("temporal", "statistical", "multivariate", "stability")]
    strong = F.greatest(*(c for _, c in four)) >= 0.2
    text = case(
        [
            (F.col("all_sensors_missing") == 1, V1_TEXTS["all_missing"]),
            (F.col("any_sensor_missing") == 1, V1_TEXTS["any_missing"]),
            (~strong & (F.col("suppression_factor") < 1.0), V1_TEXTS["suppressed"]),
            (strong, first_greatest([(V1_TEXTS[k], c) for k, c in four])),
        ],
        V1_TEXTS["none"],
    )
    return out.withColumns({"hybrid_prediction": (F.col("hybrid_anomaly_score") > threshold).cast("int"), "v1_primary_evidence": text})


def evidence_v2(df: DataFrame) -> DataFrame:
    """Adds ``e2_*``; needs rolling means over 60 and 360 minutes."""
    apart = [zero(F.abs(F.col(f"{s}_roll_mean_60m") - F.col(f"{s}_roll_mean_360m"))) for s in SENSORS]
    return df.withColumns(
        {
            "e2_temporal": bounded(largest("rate_per_hour"), SCALES_V2["temporal"]),
            "e2_statistical": bounded(F.greatest(*(F.least(zero(F.abs(f"{s}_roll_z_60m")), F.lit(Z_CAP)) for s in SENSORS)), SCALES_V2["statistical"]),
            "e2_multivariate": bounded(disagreement(), SCALES_V2["multivariate"]),
            "e2_stability": bounded(F.greatest(*(F.col(f"{s}_consec_unchanged") for s in SENSORS)).cast("double"), SCALES_V2["stability"]),
            "e2_drift": bounded(F.greatest(*apart), SCALES_V2["drift"]),
            "e2_model": F.least(F.col("model_evidence") if "model_evidence" in df.columns else F.lit(0.0), F.lit(MODEL_CAP)),
        }
    )


def fuse_v2(df: DataFrame, sudden_threshold: float | None = None, persistent_threshold: float | None = None) -> DataFrame:
    """Adds family scores, final score and confidence; with thresholds also flag, family, hint, severity and text.

    Scores are clipped before they are compared: thresholds may be exactly 1.
    """
    tem, sta, mul, stb, drf, mod = (F.col(f"e2_{k}") for k in ("temporal", "statistical", "multivariate", "stability", "drift", "model"))
    any_missing, all_missing = F.col("any_sensor_missing") == 1, F.col("all_sensors_missing") == 1
    count = lambda *xs: sum((flag(x >= AGREEMENT) for x in xs[1:]), flag(xs[0] >= AGREEMENT))
    out = df.withColumns({"sudden_active": count(tem, sta, mul), "persistent_active": count(stb, drf), "context_factor": F.when(coherent(~any_missing), SUPPRESSION).otherwise(1.0)})
    out = out.withColumns(
        {
            "sudden_event_score": clip(F.greatest(tem, sta, mul) + F.col("sudden_active") * BONUS + mod, 0.0, 1.0) * F.col("context_factor"),
            "persistent_fault_score": clip(F.greatest(stb, drf) + F.col("persistent_active") * BONUS + mod, 0.0, 1.0),
            "communication_score": F.when(all_missing, LOST[0]).when(any_missing, LOST[1]).otherwise(0.0),
            "multivariate_score": mul,
        }
    )
    sud, per, com = F.col("sudden_event_score"), F.col("persistent_fault_score"), F.col("communication_score")
    out = out.withColumns({"final_anomaly_score": F.greatest(sud, per, com), "_winner": first_greatest([(COMMUNICATION, com), (SUDDEN, sud), (PERSISTENT, per)])})
    final, winner = F.col("final_anomaly_score"), F.col("_winner")
    active = F.when(winner == SUDDEN, F.col("sudden_active")).otherwise(F.col("persistent_active"))
    agreement = F.when(active >= 2, 1.0).when(active == 1, 0.5).otherwise(0.0)
    confidence = F.when((final == 0) | (winner == COMMUNICATION), 1.0).otherwise(clip(0.5 * final + 0.5 * agreement, 0.0, 1.0))
    out = out.withColumn("anomaly_confidence", confidence)
    if sudden_threshold is None or persistent_threshold is None:
        return out.drop("_winner")
    flagged = (sud >= sudden_threshold) | (per >= persistent_threshold) | (com > LOST_LEAST)
    hint = case(
        [
            (~flagged, "NORMAL"),
            (winner == COMMUNICATION, "MISSING"),
            ((winner == PERSISTENT) & (stb > drf), "FROZEN"),
            ((winner == PERSISTENT) & (drf > DRIFT_LEAST), "DRIFT"),
            (winner == PERSISTENT, "UNKNOWN"),
            ((mul > tem) & (mul > sta), "MULTIVARIATE_INCONSISTENCY"),
            (tem > sta, "SPIKE"),
        ],
        "OFFSET",
    )
    out = out.withColumns({"anomaly_flag": flagged, "candidate_fault_family": F.when(flagged, winner).otherwise(NORMAL), "fault_type_hint": hint})
    lost = (winner == COMMUNICATION) & (com == 1.0)
    band = case([(final < top, name) for top, name in SEVERITY], "CRITICAL")
    text = case([(~flagged, ""), (lost, V2_TEXTS["all_missing"]), (winner == COMMUNICATION, V2_TEXTS["any_missing"]), *((F.col("fault_type_hint") == k, V2_TEXTS[k]) for k in ("FROZEN", "DRIFT", "UNKNOWN", "MULTIVARIATE_INCONSISTENCY", "SPIKE"))], V2_TEXTS["OFFSET"])
    reduced = flagged & (winner == SUDDEN) & (F.col("context_factor") < 1.0)
    return out.withColumns({"severity": case([(~flagged, "NORMAL"), (lost, "CRITICAL")], band), "primary_evidence": F.concat(text, F.when(reduced, V2_TEXTS["suffix"]).otherwise("")), "supporting_evidence": F.lit("")}).drop("_winner")
