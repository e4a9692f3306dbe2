"""Scans and sinks: observations from raw CSV or the ``events`` table, replay with scripted faults, manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.functions.columns import known
from driftwarden.schema import OBSERVATION, RAW_COLUMNS, RAW_TIME_FORMAT, SENSORS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_csv(spark: SparkSession, path: str, station_id: int = 0) -> DataFrame:
    """Raw station file to observations: named columns only, typed, text times parsed, NaN as NULL.

    The header decides the order, so only the needed columns are parsed. Fails if one is absent.
    """
    raw = spark.read.option("header", True).csv(path)
    absent = [c for c in RAW_COLUMNS if c not in raw.columns]
    if absent:
        raise ValueError(f"{path} lacks the columns {absent}")
    ts = F.to_timestamp_ntz(F.col("Date Time"), F.lit(RAW_TIME_FORMAT)).alias("ts")
    values = [known(F.expr(f"try_cast(`{c}` AS DOUBLE)")).alias(v) for c, v in RAW_COLUMNS.items() if v != "ts"]
    return raw.select(F.lit(station_id).alias("station_id"), ts, *values)


def processed_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBSERVATION).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The earliest ``n`` rows; files have no row order of their own."""
    return df.orderBy("ts", "station_id").limit(n)


def observations(events: DataFrame) -> DataFrame:
    """Four stations at ten minutes from ``events``, with gaps, missing values and frozen stretches."""
    seq = F.expr("event_id DIV 4")
    lost = (seq % 100).between(70, 74)
    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST((event_id DIV 4) * 600 + ((event_id DIV 4) DIV 60) * 2400 AS DECIMAL(18, 6)))")
    return events.select(
        "event_id",
        F.expr("CAST(event_id % 4 AS INT)").alias("station_id"),
        ts.alias("ts"),
        F.when((F.col("event_id") % 50 == 7) | lost, None).otherwise(15.0 + F.col("value") / 50.0).alias("temperature"),
        F.when(lost, None).otherwise(980.0 + F.get_json_object("props", "$.k").cast("double") / 10.0).alias("pressure"),
        F.when(lost, None).when((seq % 150).between(25, 56), 55.0).otherwise(40.0 + ((F.col("event_id") * 37) % 41).cast("double")).alias("humidity"),
    )


def micros(ts: str | Column = "ts") -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Request records (station_id, timestamp text, sensors) to observations, and those with no valid time."""
    parsed = df.withColumn("ts", F.expr("CAST(try_to_timestamp(timestamp) AS TIMESTAMP_NTZ)"))
    good = parsed.where("ts IS NOT NULL").select("station_id", "ts", *(known(F.col(s)).alias(s) for s in SENSORS))
    return good, parsed.where("ts IS NULL").select(*df.columns)


def replay(df: DataFrame, rows: int = 50) -> DataFrame:
    """The first ``rows`` observations of each station with scripted faults.

    Row 38 is 25 degrees warmer, rows 42 to 46 hold the values of row 41, row 48 is lost.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("station_id").orderBy("ts")
    # Rows beyond the limit end before the shuffle: a plain comparison of the row number.
    numbered = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= rows).withColumn("row", F.col("place") - 1)
    held = {s: F.first(F.when(F.col("row") == 41, F.col(s)), ignorenulls=True).over(w) for s in SENSORS}
    numbered = numbered.select("*", *(held[s].alias(f"held_{s}") for s in SENSORS))
    value = lambda s: F.when(F.col("row") == 48, None).when(F.col("row").between(42, 46), F.col(f"held_{s}")).when((F.col("row") == 38) & F.lit(s == "temperature"), F.col(s) + 25.0).otherwise(F.col(s))
    return numbered.select("station_id", "ts", "row", *(value(s).alias(s) for s in SENSORS))


def save_manifest(spark: SparkSession, path: str, values: dict) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], T.StructType([T.StructField("value", T.StringType())])).coalesce(1).write.mode("overwrite").text(path)


def load_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
