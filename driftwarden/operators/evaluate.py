"""Evaluation: confusion counts, curves and areas, event recall, distributions by fault type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.operators.selection import with_quantiles
from driftwarden.session import materialize


def confusion(df: DataFrame, label: str = "is_anomaly", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")]
    return df.groupBy(*by).agg(*counts) if by else df.agg(*counts)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy and false-positive rate of confusion counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(fp, fp + tn).alias("fpr"))


def compared(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """False-positive reduction in percent and change of recall between two ``rates`` rows."""
    a = baseline.select(F.col("fp").alias("a_fp"), F.col("recall").alias("a_recall"))
    b = other.select(F.col("fp").alias("b_fp"), F.col("recall").alias("b_recall"))
    return a.join(b, F.lit(True)).select((ratio(F.col("a_fp") - F.col("b_fp"), F.col("a_fp")) * 100.0).alias("fp_reduction_pct"), (F.col("b_recall") - F.col("a_recall")).alias("recall_change"))


def curve(df: DataFrame, score: str, label: str = "is_anomaly") -> DataFrame:
    """(score, pos, neg, tp, fp): rows at and above each distinct score, from the highest down.

    Cumulated in two steps, within ranges of the distinct scores and over them: ranges hold about as many scores each
    whatever their scale, and there are as many as shuffle partitions, so neither step orders all scores. Rows without a
    score are left out. ``_part`` is the range, numbered from the highest scores down; it is written, as a range
    that is sampled again may differ.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg"))
    sums = materialize(sums.repartitionByRange(ranges, F.desc("score")).withColumn("_part", F.spark_partition_id()), "curve")
    parts = sums.groupBy("_part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_n"))
    w = Window.partitionBy("_part").orderBy(F.desc("score"))
    inner = sums.select("*", F.sum("pos").over(w).alias("_tp"), F.sum("neg").over(w).alias("_fp"))
    return inner.join(parts, "_part").select("score", "pos", "neg", (F.col("_tp") + F.col("_p")).alias("tp"), (F.col("_fp") + F.col("_n")).alias("fp"), "_part")


def areas(points: DataFrame) -> DataFrame:
    """ROC area (ties half), average precision (steps) and trapezoid area under precision over recall."""
    total = points.agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    w = Window.partitionBy("_part").orderBy(F.desc("score"))
    v = Window.orderBy("_part")
    ends = points.groupBy("_part").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp"))
    before = ends.select("_part", F.lag("tp", 1, 0).over(v).alias("_t"), F.lag("fp", 1, 0).over(v).alias("_f"))
    steps = points.withColumns({"_lt": F.lag("tp").over(w), "_lf": F.lag("fp").over(w)}).join(before, "_part")
    steps = steps.withColumns({"t0": F.coalesce("_lt", "_t"), "f0": F.coalesce("_lf", "_f")})
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    earlier = F.when(F.col("t0") + F.col("f0") == 0, 1.0).otherwise(F.col("t0") / F.nullif(F.col("t0") + F.col("f0"), F.lit(0)))
    sums = steps.agg(
        F.sum(F.col("neg") * F.col("t0") + F.col("neg") * F.col("pos") / 2.0).alias("roc"),
        F.sum(F.col("pos") * precision).alias("ap"),
        F.sum(F.col("pos") * (precision + earlier) / 2.0).alias("tr"),
    )
    return sums.join(total, F.lit(True)).select(ratio(F.col("roc"), F.col("P") * F.col("N").cast("double")).alias("roc_auc"), ratio(F.col("ap"), F.col("P")).alias("average_precision"), ratio(F.col("tr"), F.col("P")).alias("pr_auc_trapezoid"))


def event_recall(df: DataFrame, predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Share of faults with at least one flagged row."""
    events = df.where("is_anomaly = 1").groupBy("anomaly_id", *(by or [])).agg(F.max(F.col(predicted)).alias("hit"))
    out = [F.count("*").alias("events"), F.sum("hit").alias("detected"), F.avg(F.col("hit").cast("double")).alias("event_recall")]
    return events.groupBy(*by).agg(*out) if by else events.agg(*out)


def type_recall(df: DataFrame, predicted: str = "predicted") -> DataFrame:
    return df.where("is_anomaly = 1").groupBy("anomaly_type").agg(F.count("*").alias("rows"), F.sum(predicted).alias("flagged"), F.avg(F.col(predicted).cast("double")).alias("recall"))


def type_distribution(df: DataFrame, score: str) -> DataFrame:
    """Per fault type: rows, mean, median, 5th, 95th and 99th percentile and maximum of a score."""
    out = df.groupBy("anomaly_type").agg(F.count("*").alias("rows"), F.avg(score).alias("mean"), F.max(score).alias("max"))
    return with_quantiles(out, df, score, ["anomaly_type"], {"p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99})


def type_means(df: DataFrame, columns: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Mean of many columns by fault type, each times its weight."""
    return df.groupBy("anomaly_type").agg(*(F.avg(F.col(c) * (weights or {}).get(c, 1.0)).alias(c) for c in columns))


def share_above(df: DataFrame, score: str, limits: list[float]) -> DataFrame:
    return df.groupBy("anomaly_type").agg(*(F.avg((F.col(score) >= t).cast("double")).alias(f"at_{t:g}".replace(".", "_")) for t in limits))


def reduction_bins(df: DataFrame, before: str, after: str) -> DataFrame:
    """How much suppression took, in five bins of its share of the score."""
    share = F.when(F.col(before) == 0, 0.0).otherwise((F.col(before) - F.col(after)) / F.nullif(F.col(before), F.lit(0.0)))
    names = ("none", "to_25", "to_50", "to_75", "to_100")
    bin = F.when(share <= 0, 0).when(share <= 0.25, 1).when(share <= 0.5, 2).when(share <= 0.75, 3).otherwise(4)
    return df.groupBy("anomaly_type").agg(*(F.count_if(bin == k).alias(n) for k, n in enumerate(names)))


def pivot_family(df: DataFrame, families: list[str], predicted: str = "predicted") -> DataFrame:
    """True positives by fault type (rows) and winning family (columns)."""
    return df.where((F.col("is_anomaly") == 1) & (F.col(predicted) == 1)).groupBy("anomaly_type").pivot("candidate_fault_family", families).count().fillna(0)


def saturation(df: DataFrame, score: str, label: str = "is_anomaly") -> DataFrame:
    """Minimum, upper percentiles, maximum and share of exact ones, by label."""
    out = df.groupBy(label).agg(F.min(score).alias("min"), F.max(score).alias("max"), F.avg((F.col(score) == 1.0).cast("double")).alias("share_one"))
    return with_quantiles(out, df, score, [label], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p995": 0.995})


def confidence_summary(df: DataFrame, label: str = "is_anomaly", predicted: str = "predicted") -> DataFrame:
    """Mean and median confidence by label and prediction."""
    out = df.groupBy(label, predicted).agg(F.count("*").alias("rows"), F.avg("anomaly_confidence").alias("mean_confidence"))
    return with_quantiles(out, df, "anomaly_confidence", [label, predicted], {"median_confidence": 0.5})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of each value; the total is one row, joined by broadcast."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(df.agg(F.count("*").alias("total"))), F.lit(True)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def first_per_type(df: DataFrame) -> DataFrame:
    """The earliest row of each fault type (the smallest station on ties), by an aggregate and a join back."""
    first = df.groupBy("anomaly_type").agg(F.min(F.struct("ts", "station_id")).alias("first")).select("anomaly_type", "first.*")
    return df.join(first, ["anomaly_type", "station_id", "ts"])


def flag_share(df: DataFrame, part: Column, predicted: list[str]) -> DataFrame:
    """Percent of flagged rows of each part (such as development and the rest), a column a predictor."""
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), *((F.avg(F.col(c).cast("double")) * 100.0).alias(f"{c}_pct") for c in predicted))
