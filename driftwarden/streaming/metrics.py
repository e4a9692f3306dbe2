"""Progress of streams as a table: a listener writes every micro-batch's figures, so none is forgotten, and reports read the table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from driftwarden.session import scratch_path
from driftwarden.streaming.records import write_json

#: Fixed value: watts that a core of 15 W takes at half load.
WATTS = 15.0 * 0.5
PROGRESS = "run_id string, batch long, rows long, ms double, planned_ms double, state_rows long, state_bytes long, peak_mb double"


class ProgressTable(StreamingQueryListener):
    """Writes a file of figures under ``path`` for every micro-batch with rows; a repeated event overwrites its own."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "progress")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        if not p["numInputRows"]:
            return
        state = p.get("stateOperators") or []
        took = p["durationMs"]
        write_json(
            f"{self.path}/{p['runId']}-{p['batchId']:012d}.json",
            {"run_id": p["runId"], "batch": p["batchId"], "rows": p["numInputRows"], "ms": float(took["triggerExecution"]), "planned_ms": float(took.get("queryPlanning", 0)),
             "state_rows": sum(s["numRowsTotal"] for s in state), "state_bytes": sum(s["memoryUsedBytes"] for s in state), "peak_mb": peak_memory_mb(self.spark)},
        )

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).json(f"{self.path}/*.json")


def peak_memory_mb(spark: SparkSession) -> float:
    """The largest peak of heap and other memory of the JVM among executors (the driver in local mode), from the status store."""
    store = spark.sparkContext._jsc.sc().statusStore()
    listed, most = store.executorList(False), 0.0
    for k in range(listed.size()):
        peaks = listed.apply(k).peakMemoryMetrics()
        if peaks.isDefined():
            held = peaks.get()
            most = max(most, held.getMetricValue("JVMHeapMemory") + held.getMetricValue("JVMOffHeapMemory"))
    return most / (1 << 20)


def latency_summary(progress: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Milliseconds a row over all micro-batches, weighted as they came; throughput, peak memory and energy (``WATTS`` over the time)."""
    each = progress.withColumn("each", F.col("ms") / F.col("rows"))
    mean = F.sum("ms") / F.sum("rows")
    at = lambda q: F.percentile("each", q)
    return each.groupBy(*(by or [])).agg(
        F.count("*").alias("batches"), F.sum("rows").alias("rows"), mean.alias("mean_ms"), at(0.5).alias("median_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"),
        F.max("each").alias("max_ms"), F.min("each").alias("min_ms"), (1000.0 / mean).alias("per_second"), F.max("peak_mb").alias("peak_mb"),
        (mean * WATTS).alias("energy_mj_per_row"), (F.sum("ms") / 1000.0 * WATTS).alias("energy_j"),
    )
