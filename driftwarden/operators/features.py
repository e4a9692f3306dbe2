"""The 147 causal features of an observation.

``semantics='batch'`` follows the rules thresholds are fitted with; ``'stream'`` those of the online path, which
differ where values are missing: a single value in a window gives no z-score instead of a huge one, stored
deviations are never below 1e-6, disagreement uses the pairs that are there, and a missing rate counts as 0 in ratios.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.functions.columns import case, flag, greatest_or_null, safe_divisor, zero
from driftwarden.operators.timeline import rolling, run_counts, with_chunk, with_previous
from driftwarden.schema import FEATURES, FIRST_ORDER, LABELS, MINUTE_US, MISSING, RATIO, SENSORS, TIME, WINDOWS_MIN


#: Statistics of every frame: a quantile or one of ``timeline.moments``.
FRAME = {"mean": "mean", "std": "std", "min": 0, "max": 1, "median": 0.5}


def add_missing(df: DataFrame) -> DataFrame:
    out = df.select("*", *(F.col(s).isNull().cast("int").alias(f"{s}_missing") for s in SENSORS))
    each = [F.col(f"{s}_missing") for s in SENSORS]
    return out.withColumns({"any_sensor_missing": F.greatest(*each), "all_sensors_missing": F.least(*each)})


def add_time(df: DataFrame) -> DataFrame:
    """Calendar columns and the gap to the row before (10 minutes for the first); needs ``prev_us``."""
    gap = F.coalesce((F.col("us") - F.col("prev_us")) / 1e6, F.lit(600.0))
    hour, month = F.hour("ts"), F.month("ts")
    turn = lambda f, x, n: f(F.lit(2 * math.pi) * x / float(n))
    out = df.withColumns({"hour": hour, "minute": F.minute("ts"), "day_of_week": F.weekday("ts"), "day_of_year": F.dayofyear("ts"), "month": month, "is_weekend": (F.weekday("ts") >= 5).cast("int"), "time_gap_seconds": gap})
    out = out.withColumns({"hour_sin": turn(F.sin, hour, 24), "hour_cos": turn(F.cos, hour, 24), "month_sin": turn(F.sin, month - 1, 12), "month_cos": turn(F.cos, month - 1, 12), "sampling_interval_mins": F.col("time_gap_seconds") / 60.0})
    return out.withColumn("time_gap_flag", (F.col("sampling_interval_mins") > 15.0).cast("int"))


def add_first_order(df: DataFrame) -> DataFrame:
    out = df.select("*", *((F.col(s) - F.col(f"prev_{s}")).alias(f"{s}_delta_1") for s in SENSORS))
    hours = F.greatest("sampling_interval_mins", F.lit(1.0))
    return out.select("*", *(x for s in SENSORS for x in (F.abs(f"{s}_delta_1").alias(f"{s}_abs_delta_1"), (F.col(f"{s}_delta_1") / hours * 60.0).alias(f"{s}_rate_per_hour"))))


def add_unchanged(df: DataFrame) -> DataFrame:
    """Rows in a row, up to this one, whose value moved by less than 1e-4."""
    still = {s: F.coalesce(F.col(f"{s}_abs_delta_1") < 1e-4, F.lit(False)) for s in SENSORS}
    return run_counts(df, {f"{s}_consec_unchanged": (~still[s], still[s]) for s in SENSORS})


def add_rolling(df: DataFrame, windows: tuple[int, ...] = WINDOWS_MIN, semantics: str = "batch", sensors: tuple[str, ...] = SENSORS, needed: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """Adds what frames of ``windows`` minutes give.

    ``needed`` names by window the statistics that are read later (``FRAME``; for 60 minutes also var and iqr); by default all. What follows from
    statistics that are not there is left out.
    """
    needed = needed or {w: (*FRAME, *(("var", "iqr") if w == 60 else ())) for w in windows}
    wanted = {f"{s}_roll_{name}_{w}m": (s, w * MINUTE_US, q) for w in windows for s in sensors for name, q in (FRAME | {"var": "var"}).items() if name in needed[w]}
    wanted |= {f"_{s}_q{q}": (s, w * MINUTE_US, q / 100) for w in windows if "iqr" in needed[w] for s in sensors for q in (25, 75)}
    out = rolling(df, max(windows) * MINUTE_US, {}, ordered=wanted)
    out = out.withColumns({f"{s}_dev_{short}_{w}m": F.col(s) - F.col(f"{s}_roll_{a}_{w}m") for w in windows for s in sensors for short, a in (("mean", "mean"), ("med", "median")) if a in needed[w]})
    names = [(s, w) for w in windows for s in sensors if {"mean", "std"} <= {*needed[w]}]
    std = lambda s, w: F.col(f"{s}_roll_std_{w}m")
    if semantics == "stream":
        out = out.withColumns({f"{s}_roll_std_{w}m": F.when(std(s, w).isNotNull(), safe_divisor(std(s, w))) for s, w in names})
        out = out.withColumns({f"{s}_roll_z_{w}m": F.col(f"{s}_dev_mean_{w}m") / std(s, w) for s, w in names})
    else:
        out = out.withColumns({f"{s}_roll_z_{w}m": F.col(f"{s}_dev_mean_{w}m") / safe_divisor(std(s, w)) for s, w in names})
    if {"min", "max"} <= {*needed.get(60, ())}:
        out = out.withColumns({f"{s}_roll_range_60m": F.col(f"{s}_roll_max_60m") - F.col(f"{s}_roll_min_60m") for s in sensors})
    if {"median", "iqr"} <= {*needed.get(60, ())}:
        out = out.withColumns({f"{s}_roll_iqr_60m": F.col(f"_{s}_q75") - F.col(f"_{s}_q25") for s in sensors})
        out = out.withColumns({f"{s}_robust_z_60m": F.col(f"{s}_dev_med_60m") / safe_divisor(f"{s}_roll_iqr_60m") for s in sensors}).drop(*(f"_{s}_q{q}" for s in sensors for q in (25, 75)))
    return out


def add_multivariate(df: DataFrame, semantics: str = "batch") -> DataFrame:
    z = [F.col(f"{s}_roll_z_60m") for s in SENSORS]
    apart = [F.abs(z[0] - z[1]), F.abs(z[0] - z[2]), F.abs(z[1] - z[2])]
    size = [F.abs(x) for x in z]
    top = F.greatest(*size)
    return df.withColumns(
        {
            "multivariate_z_disagreement": F.greatest(*apart) if semantics == "stream" else greatest_or_null(apart),
            "num_sensors_large_dev": sum((flag(x > 2) for x in size[1:]), flag(size[0] > 2)),
            "dominant_sensor_z": case([(size[k] == top, k) for k in range(3)], -1),
        }
    )


def add_ratios(df: DataFrame, semantics: str = "batch") -> DataFrame:
    rates = [F.abs(f"{s}_rate_per_hour") for s in SENSORS]
    rates = [zero(r) for r in rates] if semantics == "stream" else rates
    total = rates[0] + rates[1] + rates[2] + 1e-6
    return df.withColumns({name: r / total for name, r in zip(RATIO, rates, strict=True)})


def base_features(obs: DataFrame) -> DataFrame:
    """Everything that needs no rolling frame."""
    return add_unchanged(add_first_order(add_time(add_missing(with_previous(with_chunk(obs), list(SENSORS))))))


def features(obs: DataFrame, semantics: str = "batch", windows: tuple[int, ...] = WINDOWS_MIN) -> DataFrame:
    """(station_id, ts, the 147 features in model order, then labels if there are any).

    Only what needs other rows is made before the frames: all that a row has then is shuffled, sorted and sent to Python and back.
    """
    base = base_features(obs)
    again = {*MISSING, *TIME, *FIRST_ORDER}
    out = add_first_order(add_time(add_missing(add_rolling(base.drop(*again), windows, semantics))))
    out = add_ratios(add_multivariate(out, semantics), semantics)
    return out.select("station_id", "ts", *(c for c in FEATURES if c in out.columns), *(c for c in LABELS if c in out.columns))


def model_columns(df: DataFrame) -> list[str]:
    """Features that take more than one value (a missing one counts), found in one pass."""
    names = [c for c in df.columns if c in FEATURES]
    row = df.agg(*(x for c in names for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"), F.count_if(F.col(c).isNull()).alias(f"n_{c}"))), F.count("*").alias("rows")).first()
    return [c for c in names if row[f"a_{c}"] != row[f"b_{c}"] or 0 < row[f"n_{c}"] < row["rows"]]
