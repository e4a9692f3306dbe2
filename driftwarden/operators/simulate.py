"""Fault injection: a plan table of intervals is drawn first, then applied to all rows in one interval join."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.operators.joins import interval_join
from driftwarden.operators.quality import safe_starts
from driftwarden.schema import SENSORS

PLAN = T.StructType(
    [
        T.StructField("station_id", T.IntegerType()),
        T.StructField("anomaly_id", T.StringType()),
        T.StructField("start_ts", T.TimestampNTZType()),
        T.StructField("end_ts", T.TimestampNTZType()),
        T.StructField("anomaly_type", T.StringType()),
        T.StructField("affected_sensor", T.StringType()),
        T.StructField("magnitude", T.DoubleType()),
        T.StructField("seed", T.LongType()),
    ]
)

# Rows a fault lasts (least, most) and, by sensor, the range of its size.
DURATION = {"spike": (1, 3), "drift": (36, 144), "frozen": (36, 144), "offset": (18, 72), "noise": (18, 72), "missing": (3, 36), "multivariate_inconsistency": (12, 48)}
MAGNITUDE = {
    "spike": {"temperature": (3.0, 6.0), "pressure": (10.0, 30.0), "humidity": (15.0, 30.0)},
    "drift": {"temperature": (4.0, 10.0), "pressure": (15.0, 40.0), "humidity": (20.0, 40.0)},
    "offset": {"temperature": (3.0, 8.0), "pressure": (10.0, 25.0), "humidity": (15.0, 35.0)},
    "noise": {"temperature": (1.5, 1.5), "pressure": (4.0, 4.0), "humidity": (10.0, 10.0)},
    "multivariate_inconsistency": {"temperature": (5.0, 10.0), "pressure": (20.0, 40.0), "humidity": (30.0, 50.0)},
}


ATTEMPTS = 100_000


def draw_share(obs: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """A plan whose faults cover about ``share`` of all rows, from at most ``ATTEMPTS`` drawn starts."""
    rows = obs.count()
    mean = float(np.mean([(low + high) / 2 for low, high in DURATION.values()]))
    faults = min(max(1, round(share * rows / mean / len(DURATION))), ATTEMPTS // (50 * len(DURATION)))
    return draw_plan(obs, faults, seed, most_rows=round(share * rows))


def draw_plan(obs: DataFrame, faults_per_type: int = 5, seed: int = 42, most_rows: int | None = None) -> DataFrame:
    """A plan of non-overlapping faults at safe starts; sizes, signs and ids depend only on the seed and their number.

    Candidate starts are the smallest seeded hashes of each fault type: a bounded number of rows reaches the driver.
    With ``most_rows`` placing ends once the faults cover so many rows.
    """
    spark = obs.sparkSession
    rng = np.random.default_rng(seed)
    taken: dict[int, list[tuple[dt.datetime, dt.datetime]]] = {}
    rows, covered = [], 0
    for number, (kind, (low, high)) in enumerate(DURATION.items()):
        starts = safe_starts(obs, high).orderBy(F.xxhash64(F.lit(seed + number), "station_id", "ts"), "station_id", "ts").limit(50 * faults_per_type).collect()
        placed = 0
        for start in starts:
            n = int(rng.integers(low, high + 1))
            begin, end = start.ts, start.ts + dt.timedelta(minutes=10 * (n - 1))
            if placed == faults_per_type or (most_rows is not None and covered >= most_rows):
                break
            if any(begin <= e and end >= s for s, e in taken.get(start.station_id, [])):
                continue
            sensor = "all" if kind == "missing" else SENSORS[int(rng.integers(3))]
            size = float(rng.uniform(*MAGNITUDE[kind][sensor])) if kind in MAGNITUDE else 0.0
            sign = 1.0 if kind == "noise" else float(rng.choice([1.0, -1.0]))
            taken.setdefault(start.station_id, []).append((begin, end))
            rows.append((start.station_id, f"a{seed}-{len(rows):06d}", begin, end, kind, sensor, sign * size, int(rng.integers(1 << 31))))
            placed += 1
            covered += n
    return spark.createDataFrame(rows, PLAN)


def fixed_plan(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PLAN)


def inject(obs: DataFrame, plan: DataFrame) -> DataFrame:
    """Observations with the plan's faults and row labels; a row lies in at most one fault.

    drift adds a line from 0 to the magnitude, frozen repeats the first row's value, missing clears all sensors,
    noise adds normal draws with the magnitude as deviation (a seeded hash, the same for a row in every run). A plan comes from the driver
    (``draw_plan``), so it is small enough for every task; rows stay where they are.
    """
    marked = interval_join(obs, F.broadcast(plan), "start_ts", "end_ts", how="left")
    w = Window.partitionBy("anomaly_id").orderBy("ts")
    every = Window.partitionBy("anomaly_id")
    inside = marked.where("anomaly_id IS NOT NULL")
    place, last = F.row_number().over(w) - 1, F.count("*").over(every) - 1
    drawn = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("us").cast("string"), F.lit(str(k)))), 1, 12), 16, 10).cast("long")
    uniform = lambda k: (drawn(k) + 1) / float((1 << 48) + 1)
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * np.pi * uniform(2))
    inside = inside.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("*", place.alias("place"), last.alias("last"), *(F.first(s).over(w).alias(f"start_{s}") for s in SENSORS))
    kind = F.col("anomaly_type")

    def value(s: str):
        hit = (F.col("affected_sensor") == s) | (F.col("affected_sensor") == "all")
        added = (
            F.when(kind.isin("spike", "offset", "multivariate_inconsistency"), F.col("magnitude"))
            .when(kind == "drift", F.when(F.col("last") > 0, F.col("magnitude") * F.col("place") / F.col("last")).otherwise(0.0))
            .when(kind == "noise", F.col("magnitude") * normal)
        )
        return F.when(~hit, F.col(s)).when(kind == "missing", None).when(kind == "frozen", F.col(f"start_{s}")).otherwise(F.col(s) + added).alias(s)

    labels = [F.lit(1).alias("is_anomaly"), "anomaly_type", "affected_sensor", "anomaly_id"]
    other = [c for c in obs.columns if c not in SENSORS]
    changed = inside.select(*other, *(value(s) for s in SENSORS), *labels)
    calm = marked.where("anomaly_id IS NULL").select(*other, *SENSORS, F.lit(0).alias("is_anomaly"), F.lit("normal").alias("anomaly_type"), F.lit("none").alias("affected_sensor"), F.lit("none").alias("anomaly_id"))
    return calm.unionByName(changed)


def fault_labels(plan: DataFrame, labelled: DataFrame) -> DataFrame:
    """Interval labels with the number of rows each fault covers."""
    n = labelled.where("is_anomaly = 1").groupBy("anomaly_id").agg(F.count("*").alias("duration_obs"))
    return plan.join(n, "anomaly_id", "left").select("station_id", "anomaly_id", "start_ts", "end_ts", "anomaly_type", "affected_sensor", F.lit("moderate").alias("severity"), F.coalesce("duration_obs", F.lit(0)).alias("duration_obs"))


def label_alignment(labelled: DataFrame, plan: DataFrame) -> DataFrame:
    """Per fault: rows in its interval, and those that lack its label or have another type."""
    spans = plan.select("station_id", F.col("anomaly_id").alias("fault_id"), "start_ts", "end_ts", F.col("anomaly_type").alias("fault_type"))
    both = interval_join(labelled, spans, "start_ts", "end_ts")
    return both.groupBy("fault_id").agg(F.count("*").alias("rows"), F.count_if(F.col("is_anomaly") != 1).alias("unlabelled"), F.count_if(F.col("anomaly_type") != F.col("fault_type")).alias("mistyped"))
