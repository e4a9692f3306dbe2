from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftwarden.plans import queries
from driftwarden.schema import FEATURES, SENSORS
from driftwarden.session import scratch_path
from driftwarden.sources.tables import observations
from driftwarden.streaming import stations
from driftwarden.streaming.records import RecordLogReader, record_stream


def series(n: int = 600):
    draw = np.random.default_rng(11)
    us = np.cumsum(draw.choice([600, 600, 600, 1200, 4000], n)).astype(np.int64) * 1_000_000
    values = np.stack([15 + draw.integers(0, 9999, n) / 50, 980 + draw.integers(0, 100, n) / 10, np.where(np.arange(n) % 90 < 40, 55.0, draw.integers(40, 81, n))], 1)
    values[draw.random(values.shape) < 0.05] = np.nan
    return us, values


def test_results_do_not_hang_on_the_micro_batch():
    """Sums that slide carried what earlier rows of a micro-batch had left; one row of 6,000,000 then went over a step of the evidence."""
    us, values = series()
    whole = stations.features_of(us, values, 0, dict.fromkeys(SENSORS, 0))
    for first in (200, 333):
        part = stations.features_of(us[first - 150 :], values[first - 150 :], 150, {s: int(whole[f"{s}_consec_unchanged"][first - 1]) for s in SENSORS})
        for c in FEATURES:
            assert np.array_equal(part[c], whole[c][first:], equal_nan=True), c
    one = stations.Station().process(us, values, stations.stored())
    station, parts = stations.Station(), []
    for k in range(0, len(us), 37):
        parts += station.process(us[k : k + 37], values[k : k + 37], stations.stored())
    assert one == parts


def test_frames_are_the_batch_plans(spark, sf):
    rows = observations(spark.read.parquet(f"{sf}/events.parquet")).where("station_id = 1").drop("event_id")
    names = [f"{s}_{c}" for s in SENSORS for c in ("roll_z_60m", "roll_mean_60m", "roll_mean_360m", "roll_range_60m")] + ["multivariate_z_disagreement"]
    want = queries.scored_features(rows, "stream").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).orderBy("_us").select("_us", *SENSORS, *names).toPandas().astype(float)
    found = stations.features_of(want["_us"].to_numpy(np.int64), want[list(SENSORS)].to_numpy(), 0, dict.fromkeys(SENSORS, 0), names)
    for c in names:
        assert np.array_equal(found[c], want[c], equal_nan=True), c


def test_parity_compares_what_was_computed(spark, sf, monkeypatch):
    """Both sides were rounded first, so that two values a digit apart on a half of the sixth digit differed."""
    held = {}
    monkeypatch.setattr(queries, "apart", lambda found, other, keys: held.update(found=found, other=other) or found)
    queries.stream_parity(spark, sf)
    for side in held.values():
        assert side.where(F.abs(F.col("anomaly_score") * 1e6 - F.round(F.col("anomaly_score") * 1e6)) > 1e-3).count() > 0


def test_a_micro_batch_is_one_job(spark, sf):
    """Results and dead letters were written by a job each, from a cached micro-batch."""
    path, root = f"{sf}/events.parquet", scratch_path(spark, "stream")
    log = record_stream(spark, path, queries.record_schema(spark, path), 300, f"{root}/position.json")
    query = stations.sink(stations.process_stream(stations.with_seq(queries.interrupted(log))), root, processingTime="0 seconds")
    try:
        query.processAllAvailable()
        batches = sum(p.numInputRows > 0 for p in query.recentProgress)
    finally:
        query.stop()
    assert batches > 2 and len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))) <= batches + 1
    letters = stations.dead_letters(spark, root).collect()
    rows = spark.read.parquet(path)
    assert len(letters) == rows.where(f"event_id % {queries.POISON_EVERY} = 5").count() > 0 and all("OutOfBounds" in r.error for r in letters)
    assert stations.results_of(spark, root).count() == rows.count()


def test_times_that_no_clock_can_hold_cost_no_second_try(monkeypatch):
    """Each had the records around it halved and processed again."""
    us, values = series(400)
    late = np.zeros(400, bool)
    late[9::20] = True
    calls, own = [], stations.features_of
    monkeypatch.setattr(stations, "features_of", lambda *a: calls.append(1) or own(*a))
    found = stations.Station().taken(np.where(late, 19_880_899_200_000_000, us), values, stations.stored())
    assert len(calls) == 1
    assert [r["processing_state"] == "FAILED" for r in found] == late.tolist()
    assert [r for r, x in zip(found, late) if not x] == stations.Station().taken(us[~late], values[~late], stations.stored())
    early = stations.Station().taken(np.array([-(1 << 62), us[0], -(1 << 62)]), values[:3], stations.stored())
    assert [r and r["processing_state"] for r in early] == ["FAILED", "WARMUP", None]


def test_known_stations_are_spread_over_the_state(spark):
    n = stations.spread(spark, queries.STATIONS)
    fullest = lambda k: spark.range(4).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(k)).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert fullest(n) == min(fullest(k) for k in range(1, spark.sparkContext.defaultParallelism + 1))


def test_streams_run_side_by_side(spark, sf, monkeypatch):
    started, own = [], stations.sink
    monkeypatch.setattr(stations, "sink", lambda *a, **k: started.append((own(*a, **k), [q for q, _ in started if q.isActive])) or started[-1][0])
    queries.causal_stream(spark, sf)
    assert len(started) == 2 and len(started[1][1]) == 1


def test_a_row_group_is_not_decoded_to_its_end(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import types as T

    from driftwarden.streaming import records

    pq.write_table(pa.table({"seq": np.arange(400_000)}), tmp_path / "a.parquet", row_group_size=400_000)
    seen, own = [], pq.ParquetFile.iter_batches
    monkeypatch.setattr(records.pq.ParquetFile, "iter_batches", lambda self, *a, **k: (seen.append(b.num_rows) or b for b in own(self, *a, **k)))
    reader = RecordLogReader({"path": str(tmp_path)}, T.StructType([T.StructField("seq", T.LongType())]))
    found = [v for b in reader.read(records.Stretch(str(tmp_path / "a.parquet"), 70_000, 70_003)) for v in b["seq"].to_pylist()]
    assert found == [70_000, 70_001, 70_002] and sum(seen) < 300_000
