"""Column names, types and orders that all modules share."""

from __future__ import annotations

from pyspark.sql import types as T

SENSORS = ("temperature", "pressure", "humidity")
SHORT = {"temperature": "temp", "pressure": "press", "humidity": "humid"}
WINDOWS_MIN = (30, 60, 180, 360)
KEYS = ("station_id", "ts")
LABELS = ("is_anomaly", "anomaly_type", "affected_sensor", "anomaly_id")
MINUTE_US = 60_000_000
CHUNK_US = 24 * 60 * MINUTE_US

OBSERVATION = T.StructType([T.StructField("station_id", T.IntegerType(), False), T.StructField("ts", T.TimestampNTZType(), False), *(T.StructField(s, T.DoubleType()) for s in SENSORS)])

# Columns of the raw source and the names they get.
RAW_COLUMNS = {"Date Time": "ts", "T (degC)": "temperature", "p (mbar)": "pressure", "rh (%)": "humidity"}
RAW_TIME_FORMAT = "dd.MM.yyyy HH:mm:ss"

MISSING = (*(f"{s}_missing" for s in SENSORS), "any_sensor_missing", "all_sensors_missing")
TIME = ("hour", "minute", "day_of_week", "day_of_year", "month", "is_weekend", "hour_sin", "hour_cos", "month_sin", "month_cos", "time_gap_seconds", "sampling_interval_mins", "time_gap_flag")
FIRST_ORDER = tuple(f"{s}_{c}" for s in SENSORS for c in ("delta_1", "abs_delta_1", "rate_per_hour"))
ROLLING = tuple(f"{s}_{c}_{w}m" for w in WINDOWS_MIN for s in SENSORS for c in ("roll_mean", "roll_std", "roll_min", "roll_max", "roll_median", "dev_mean", "dev_med", "roll_z"))
STABILITY = tuple(f"{s}_{c}" for s in SENSORS for c in ("consec_unchanged", "roll_var_60m", "roll_range_60m"))
MULTIVARIATE = ("multivariate_z_disagreement", "num_sensors_large_dev", "dominant_sensor_z")
RATIO = tuple(f"{SHORT[s]}_rate_ratio" for s in SENSORS)
ROBUST = tuple(f"{s}_{c}_60m" for s in SENSORS for c in ("roll_iqr", "robust_z"))
#: The 147 features in the order that models see them.
FEATURES = (*SENSORS, *MISSING, *TIME, *FIRST_ORDER, *ROLLING, *STABILITY, *MULTIVARIATE, *RATIO, *ROBUST)
