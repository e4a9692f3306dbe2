from __future__ import annotations

from driftwarden.plans import reports
from driftwarden.schema import OBSERVATION
from driftwarden.streaming.stations import RESULT, process_stream


def test_summary_and_markdown():
    values = reports.summary(range(1, 101))
    assert (values["mean_ms"], values["median_ms"], values["p95_ms"], values["max_ms"]) == (50.5, 50.5, 96, 100)
    assert reports.summary([]) == {}
    assert "| mean_ms | 50.50 |" in reports.markdown("Run", {"Latency": values})


def test_fan_out_and_latency(spark, tmp_path):
    schema = "station_id int, seq long, ts timestamp_ntz, temperature double, pressure double, humidity double"
    rows = spark.range(20).selectExpr("CAST(id % 2 AS INT) station_id", "id seq", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id * 10 AS INT)) ts", "20.0D temperature", "1000.0D pressure", "50.0D humidity")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    results = process_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = reports.fan_out(results, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out" / "batch=0"))
    assert out.count() == 20 and set(out.columns) == set(RESULT.names)
    assert (tmp_path / "out" / "batch=0" / "station_id=1").exists()
    figures = reports.latency(query)
    assert figures["rows"] == 20 and figures["mean_ms"] > 0


def test_observation_schema_is_explicit():
    assert [f.name for f in OBSERVATION.fields] == ["station_id", "ts", "temperature", "pressure", "humidity"]
