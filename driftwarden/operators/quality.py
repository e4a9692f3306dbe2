"""Audit and cleaning of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.operators.selection import with_quantiles
from driftwarden.operators.timeline import DAY, islands, row_numbers, with_chunk, with_following, with_previous
from driftwarden.schema import MINUTE_US, SENSORS

KEY = ["station_id", "ts"]
STRETCH = 1_000_000


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Rows, exact duplicates, rows beyond the first of a key, and those of them whose values differ.

    Rows are counted by value first, so a row repeated any number of times is one group for the second step.
    """
    values = df.groupBy(*KEY, *SENSORS).agg(F.count("*").alias("n"))
    keys = values.groupBy(*KEY).agg(F.sum("n").alias("rows"), F.count("*").alias("kinds"))
    return keys.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("rows") - F.col("kinds")), F.lit(0)).alias("exact_duplicates"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("kinds") - 1), F.lit(0)).alias("conflicting"),
    )


def conflicts(df: DataFrame) -> DataFrame:
    """Rows of keys that carry different values."""
    kinds = df.groupBy(*KEY, *SENSORS).agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("*").alias("kinds")).where("kinds > 1")
    return df.join(kinds.select(*KEY), KEY, "left_semi")


def clean(df: DataFrame) -> DataFrame:
    """Observations without exact duplicates and without rows that have no time."""
    return drop_exact_duplicates(df.where("ts IS NOT NULL").select(*KEY, *SENSORS))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(s).isNull()).alias(f"{s}_nulls") for s in SENSORS))


def basic_audit(df: DataFrame) -> DataFrame:
    """One row a sensor: count, minimum, maximum, mean and standard deviation."""
    parts = F.array(*(F.struct(F.lit(s).alias("sensor"), F.col(s).alias("x")) for s in SENSORS))
    long = df.select(F.explode(parts).alias("p")).select("p.sensor", "p.x")
    return long.groupBy("sensor").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def describe(df: DataFrame) -> DataFrame:
    """``basic_audit`` with exact quartiles."""
    parts = F.array(*(F.struct(F.lit(s).alias("sensor"), F.col(s).alias("x")) for s in SENSORS))
    long = df.select(F.explode(parts).alias("p")).select("p.sensor", "p.x")
    out = long.groupBy("sensor").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return with_quantiles(out, long, "x", ["sensor"], {"p25": 0.25, "p50": 0.5, "p75": 0.75}).select("sensor", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def physical_range(df: DataFrame) -> DataFrame:
    """How many values lie outside what a sensor can measure, and infinite ones."""
    t, p, h = (F.col(s) for s in SENSORS)
    infinite = [F.count_if(F.abs(F.col(s)) == float("inf")).alias(f"{s}_infinite") for s in SENSORS]
    return df.agg(F.count_if((t < -50) | (t > 60)).alias("temperature_out"), F.count_if(p <= 0).alias("pressure_out"), F.count_if((h < 0) | (h > 100)).alias("humidity_out"), *infinite)


def gaps(df: DataFrame) -> DataFrame:
    """Stretches longer than the ten-minute cadence: end, start, minutes and how many rows are missing."""
    out = with_previous(with_chunk(df), [])
    gap = (F.col("us") - F.col("prev_us")) / 1e6
    return out.where(F.col("us") - F.col("prev_us") > 10 * MINUTE_US).select(
        "station_id", "ts", F.timestamp_micros("prev_us").cast("timestamp_ntz").alias("gap_start"), (gap / 60.0).alias("gap_minutes"), (F.floor(gap / 600.0) - 1).alias("missing_slots")
    )


def largest_gaps(df: DataFrame, k: int = 10) -> DataFrame:
    return gaps(df).orderBy(F.desc("gap_minutes"), "station_id", "ts").limit(k)


def interval_statistics(df: DataFrame) -> DataFrame:
    """Median, mode, minimum and maximum of the seconds between rows of a station; non-positive steps.

    Steps are counted by value first, with partial sums.
    """
    seconds = (F.col("us") - F.col("prev_us")) / 1e6
    out = with_previous(with_chunk(df), []).select("station_id", seconds.alias("d"))
    kinds = out.groupBy("station_id", "d").agg(F.count("*").alias("n"))
    most = F.max_by("d", F.when(F.col("d").isNotNull(), F.struct("n", (-F.col("d")).alias("least"))))
    total = kinds.groupBy("station_id").agg(
        most.alias("mode_s"), F.min("d").alias("min_s"), F.max("d").alias("max_s"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("n"))), F.lit(0)).alias("negative"), F.coalesce(F.sum(F.when(F.col("d") == 0, F.col("n"))), F.lit(0)).alias("zero")
    )
    return with_quantiles(total, out, "d", ["station_id"], {"median_s": 0.5})


def arrival_order(df: DataFrame, arrival: str) -> DataFrame:
    """Per station how many rows arrived (by the number ``arrival``) with a time before that of the row before.

    Arrivals are cut into stretches of ``STRETCH``; each knows the time of the last arrival before it.
    """
    own = Window.partitionBy("station_id", "_part").orderBy(arrival)
    rows = df.withColumn("_part", F.floor(F.col(arrival) / STRETCH))
    ends = rows.groupBy("station_id", "_part").agg(F.max_by("ts", arrival).alias("end"))
    before = ends.select("station_id", "_part", F.lag("end").over(Window.partitionBy("station_id").orderBy("_part")).alias("_end"))
    joined = rows.withColumn("_lag", F.lag("ts").over(own)).join(before, ["station_id", "_part"])
    return joined.groupBy("station_id").agg(F.count("*").alias("rows"), F.count_if(F.col("ts") < F.coalesce("_lag", "_end")).alias("backward"))


def constant_runs(df: DataFrame, sensor: str, k: int = 5) -> DataFrame:
    """The ``k`` longest runs of equal values of a sensor; a missing value is equal to nothing."""
    rows = with_previous(with_chunk(df), [sensor])
    change = ~F.coalesce(F.col(sensor) == F.col(f"prev_{sensor}"), F.lit(False))
    runs = islands(rows, change).groupBy("station_id", "island").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("size"), F.min(sensor).alias("value"), ((F.max("us") - F.min("us")) / (60.0 * 1e6)).alias("duration_minutes")
    )
    return runs.drop("island").orderBy(F.desc("size"), "station_id", "first_ts").limit(k)


def clean_segments(df: DataFrame, n: int) -> DataFrame:
    """Stretches of at least ``n`` rows exactly ten minutes apart with all sensors present."""
    rows = with_previous(with_chunk(df.dropna(subset=list(SENSORS))), [])
    change = ~F.coalesce(F.col("us") - F.col("prev_us") == 10 * MINUTE_US, F.lit(False))
    out = islands(rows, change).groupBy("station_id", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("size"))
    return out.drop("island").where(F.col("size") >= n)


def safe_starts(df: DataFrame, n: int) -> DataFrame:
    """Rows where a fault of ``n`` rows may begin: the span is within 30 minutes of n - 1 steps, nothing is missing.

    The last row of such a span lies at most that far ahead, so a day needs no more of the next one.
    """
    span, slack = (n - 1) * 10 * MINUTE_US, 30 * MINUTE_US
    w = Window.partitionBy(*DAY).orderBy("us")
    any_missing = F.greatest(*(F.col(s).isNull().cast("int") for s in SENSORS))
    rows = with_following(with_chunk(df), span + slack)
    rows = rows.select("*", F.lead("us", n - 1).over(w).alias("end_us"), F.sum(any_missing).over(w.rowsBetween(0, n - 1)).alias("missing"))
    return rows.where(~F.col("_halo") & (F.col("missing") == 0) & (F.abs(F.col("end_us") - F.col("us") - span) <= slack)).select("station_id", "ts")


def correlations(df: DataFrame) -> DataFrame:
    """Pearson correlation of each pair of sensors over the rows that have both."""
    pairs = [(a, b) for i, a in enumerate(SENSORS) for b in SENSORS[i + 1 :]]
    return df.agg(*(F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs))


def first_days(df: DataFrame, days: int = 7) -> DataFrame:
    start = df.groupBy("station_id").agg(F.min("ts").alias("start"))
    return df.join(start, "station_id").where(f"ts <= start + INTERVAL {int(days)} DAYS").drop("start")


def around(df: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """Rows at most ``k`` places from a marked row (station_id, ts), with their distance."""
    numbered = row_numbers(with_chunk(df)).drop("us", "chunk")
    at = numbered.join(marks, KEY, "left_semi").select("station_id", F.col("ts").alias("mark_ts"), F.explode(F.sequence(F.col("row") - k, F.col("row") + k)).alias("row"), F.col("row").alias("mark_row"))
    return numbered.join(at, ["station_id", "row"]).withColumn("distance", F.col("row") - F.col("mark_row")).drop("mark_row", "row")


def key_hash(seed: int, *columns: str):
    """The md5 of seed and columns as text: the same in any run and any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def continuous_subset(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` consecutive rows of each station from a start that the seed chooses (all rows of a shorter station)."""
    numbered = row_numbers(with_chunk(df))
    sizes = numbered.groupBy("station_id").agg(F.max("row").alias("size"))
    drawn = F.conv(F.substring(key_hash(seed, "station_id"), 1, 12), 16, 10).cast("long")
    start = drawn % F.greatest(F.col("size") - n + 1, F.lit(1)) + 1
    return numbered.join(sizes.select("station_id", start.alias("start")), "station_id").where((F.col("row") >= F.col("start")) & (F.col("row") < F.col("start") + n)).select(*df.columns)


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows by a seeded hash of their key: the same ones in any run."""
    rows = df.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.orderBy(key_hash(seed, "station_id", "_us"), "station_id", "ts").limit(n).drop("_us")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal steps from ``low`` to ``high``; outer bins (0 and bins + 1) hold the rest."""
    bin = F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins))
    return df.where(F.col(column).isNotNull()).groupBy(bin.alias("bin")).agg(F.count("*").alias("n"))


def null_accounting(df: DataFrame, columns: list[str], warm_up_minutes: int = 360) -> DataFrame:
    """Per column: missing values, those with a missing sensor in the row, of the rest those in a station's first hours."""
    start = df.groupBy("station_id").agg(F.min("ts").alias("_start"))
    rows = df.join(start, "station_id")
    raw = F.greatest(*(F.col(s).isNull().cast("int") for s in SENSORS)) == 1
    warm = F.col("ts") <= F.col("_start") + F.expr(f"INTERVAL {int(warm_up_minutes)} MINUTES")
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("gone")) for c in columns))).alias("x"), raw.alias("raw"), warm.alias("warm"))
    gone = F.col("x.gone")
    return long.groupBy(F.col("x.column").alias("column")).agg(F.count_if(gone).alias("missing"), F.count_if(gone & F.col("raw")).alias("expected"), F.count_if(gone & ~F.col("raw") & F.col("warm")).alias("warm_up"), F.count_if(gone & ~F.col("raw") & ~F.col("warm")).alias("unexpected"))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column its deviation and whether it never varies.

    The extremes decide that: merged partial deviations of equal values need not be 0, as a partition's mean is merged as (x / n) * n.
    """
    row = df.agg(*(F.struct(F.when(F.min(c) == F.max(c), F.stddev_samp(c) * 0.0).otherwise(F.stddev_samp(c)).alias("std"), F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("constant")).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}.std").alias("std"), F.col(f"{c}.constant").alias("constant")) for c in columns))).alias("x")).select("x.*")


def integrity(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, repeated keys, missing and infinite values among ``columns``."""
    keys = df.groupBy(*KEY).agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in columns), *(F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"i_{c}") for c in columns))
    total = lambda prefix: sum((F.sum(f"{prefix}_{c}") for c in columns[1:]), F.sum(f"{prefix}_{columns[0]}"))
    return keys.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated_keys"), total("m").alias("missing"), total("i").alias("infinite"))
