"""Reports: latency of a stream, a benchmark as Markdown, and results fanned out by station."""

from __future__ import annotations

import statistics
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def latency(query: StreamingQuery) -> dict[str, float]:
    """Milliseconds a row over the query's recent micro-batches with rows, and rows a second."""
    held = [(p["durationMs"]["triggerExecution"], p["numInputRows"]) for p in query.recentProgress if p["numInputRows"]]
    return summary([ms / rows for ms, rows in held]) | {"rows": float(sum(n for _, n in held))}


def summary(ms: Iterable[float]) -> dict[str, float]:
    """Mean, median, 95th and 99th percentile, extremes and throughput of latencies in milliseconds."""
    values = sorted(ms)
    if not values:
        return {}
    at = lambda p: values[min(len(values) - 1, int(p * len(values)))]
    mean = statistics.fmean(values)
    return {"mean_ms": mean, "median_ms": statistics.median(values), "p95_ms": at(0.95), "p99_ms": at(0.99), "max_ms": values[-1], "min_ms": values[0], "per_second": 1000 / mean if mean else 0.0}


def markdown(title: str, sections: dict[str, dict[str, float | str]]) -> str:
    lines = [f"# {title}", ""]
    for name, values in sections.items():
        lines += [f"## {name}", "", "| Metric | Value |", "|-|-|"]
        lines += [f"| {k} | {v:.2f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in values.items()]
        lines.append("")
    return "\n".join(lines)


def fan_out(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stream results to one folder a station; a micro-batch that is repeated overwrites its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("station_id").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
