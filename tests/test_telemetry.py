from __future__ import annotations

import collections
import datetime as dt
import functools
import itertools
import json
import math
import shutil
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.operators import detectors, evaluate, features, health, joins, quality, simulate, stages
from driftwarden.operators.timeline import with_chunk
from driftwarden.plans import batch
from driftwarden.plans.fitted import stored
from driftwarden.plans.queries import plan, scored_features
from driftwarden.schema import FEATURES, OBSERVATION, SENSORS
from driftwarden.sources import tables
from driftwarden.streaming import subscribers
from driftwarden.streaming.metrics import ProgressTable, latency_summary
from driftwarden.streaming.records import RecordLogReader, record_stream
from driftwarden.streaming.stations import Station, dead_letters, features_of, process_stream, results_of, run_records, sink

START = dt.datetime(2024, 1, 1)
TRACKED = "station_id int, ts timestamp_ntz, temperature double, pressure double, humidity double, temperature_rate_per_hour double, pressure_rate_per_hour double, humidity_rate_per_hour double, temperature_roll_z_60m double, pressure_roll_z_60m double, humidity_roll_z_60m double, anomaly_flag boolean, final_anomaly_score double, anomaly_confidence double, fault_type_hint string, candidate_fault_family string"


def minutes(m: float) -> dt.datetime:
    return START + dt.timedelta(minutes=m)


def tracked(spark, rows):
    """Rows of (minute, flag, hint, temperature's rate and z, optional sensors) through the tracker, in order."""
    data = []
    for m, flag, hint, rate, z, *sensors in rows:
        t, p, h = sensors[0] if sensors else (20.0, 1000.0, 50.0)
        data.append((0, minutes(m), t, p, h, rate, 0.0, 0.0, z, 0.0, 0.0, flag, 1.0, 1.0, hint, "x"))
    return health.track(spark.createDataFrame(data, TRACKED)).orderBy("ts").collect()


def observed(spark, values, step: float = 10, station: int = 0):
    rows = [(station, minutes(step * i), *v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, OBSERVATION)


class TestHealth:
    def test_isolated_spike(self, spark):
        (r,) = tracked(spark, [(0, True, "SPIKE", 15.0, 0.0)])
        assert (r.classified_fault_type, r.affected_sensor, r.temperature_health, r.pressure_health, r.data_quality_status, r.anomaly_streak) == ("SPIKE", "TEMPERATURE", 95.0, 100.0, "GOOD", 1)
        assert r.fault_explanation == "Probable temperature spike: reading changed abruptly relative to its recent baseline. Confidence: 1.00."

    def test_five_spikes(self, spark):
        r = tracked(spark, [(10 * i, True, "SPIKE", 15.0, 0.0) for i in range(5)])[-1]
        assert (r.anomaly_streak, r.temperature_health, r.maintenance_status) == (5, 50.0, "MONITOR / INSPECT")

    def test_frozen(self, spark):
        r = tracked(spark, [(10 * i, True, "FROZEN", 0.0, 4.0) for i in range(6)])[-1]
        assert (r.frozen_streak, r.maintenance_status) == (6, "MAINTENANCE_RECOMMENDED") and r.temperature_health < 90

    def test_drift(self, spark):
        r = tracked(spark, [(10 * i, True, "DRIFT", 0.0, 2.5) for i in range(10)])[-1]
        assert (r.classified_fault_type, r.maintenance_status) == ("DRIFT", "INSPECT")

    def test_missing(self, spark):
        (r,) = tracked(spark, [(0, True, "MISSING", None, None, (None, None, None))])
        assert (r.classified_fault_type, r.data_quality_status, r.affected_sensor, r.temperature_health) == ("MISSING", "DATA_LOSS", "ALL_SENSORS", 100.0)
        (r,) = tracked(spark, [(0, True, "MISSING", None, None, (None, 1000.0, 50.0))])
        assert (r.data_quality_status, r.affected_sensor) == ("DEGRADED", "TEMPERATURE")
        (r,) = tracked(spark, [(0, False, "NORMAL", None, None, (None, 1000.0, 50.0))])
        assert r.classified_fault_type == "MISSING" and r.maintenance_status == "NO_ACTION"

    def test_recovery_and_gap(self, spark):
        rows = tracked(spark, [(0, False, "NORMAL", 0.0, 0.0), (10, True, "SPIKE", 15.0, 0.0), (70, False, "NORMAL", 0.0, 0.0), (80, False, "NORMAL", 0.0, 0.0)])
        assert [round(r.temperature_health, 6) for r in rows] == [100.0, 95.0, 95.2, 95.4]
        assert [r.anomaly_streak for r in rows] == [0, 1, 0, 0]

    def test_days_join_up(self, spark):
        """Streaks and health across days equal the plain fold."""
        rng = np.random.default_rng(3)
        rows = [(10 * i + (200 if i > 300 else 0), bool(rng.random() < 0.4), "SPIKE", float(rng.uniform(0, 20)), 0.0) for i in range(600)]
        state, streak, last = 100.0, 0, None
        want = []
        for m, flag, _, rate, _ in rows:
            if last is not None and m - last > 30:
                streak = 0
            last = m
            e = min(1, rate / 10)
            streak = (streak + (e > 0.5)) if flag else 0
            state = max(0, min(100, state + (0.2 if not flag and streak == 0 else -5 * e * min(5, 1 + 0.5 * max(0, streak - 1)) if flag and e > 0.5 else 0)))
            want.append(round(state, 9))
        assert [round(r.temperature_health, 9) for r in tracked(spark, rows)] == want


class TestFeatures:
    @pytest.fixture(scope="class")
    def noisy(self):
        rng = np.random.default_rng(1)
        values = [[float(20 + rng.normal()), float(1000 + rng.normal()), 55.0 if 40 <= i < 60 else float(rng.integers(40, 70))] for i in range(400)]
        for i in range(0, 400, 17):
            values[i][i % 3] = None
        return [tuple(v) for v in values]

    def test_names_and_order(self, spark, noisy):
        out = features.features(observed(spark, noisy[:50]))
        assert len(FEATURES) == 147 and out.columns == ["station_id", "ts", *FEATURES]

    def test_against_pandas(self, spark, noisy):
        got = features.features(observed(spark, noisy)).orderBy("ts").toPandas().set_index("ts")
        pdf = pd.DataFrame(noisy, columns=SENSORS, index=[minutes(10 * i) for i in range(400)], dtype=float)
        for s in SENSORS:
            for w in (30, 60, 180, 360):
                r = pdf[s].rolling(f"{w}min", closed="left")
                for name, want in (("mean", r.mean()), ("std", r.std()), ("min", r.min()), ("max", r.max()), ("median", r.median())):
                    assert np.allclose(got[f"{s}_roll_{name}_{w}m"].astype(float), want, equal_nan=True, atol=1e-7), (s, name, w)
            near = (pdf[s].diff().abs() < 1e-4).astype(int)
            assert (got[f"{s}_consec_unchanged"].to_numpy() == near.groupby((near == 0).cumsum()).cumsum().to_numpy()).all()
            iqr = pdf[s].rolling("60min", closed="left").quantile(0.75) - pdf[s].rolling("60min", closed="left").quantile(0.25)
            assert np.allclose(got[f"{s}_roll_iqr_60m"].astype(float), iqr, equal_nan=True)

    def test_causal(self, spark, noisy):
        """Rows to come change nothing that was."""
        short, long = (features.features(observed(spark, noisy[:n])) for n in (200, 400))
        first = long.where(f"ts < timestamp_ntz'{minutes(2000)}'")
        diff = joins.table_difference(short, first, ["station_id", "ts"]).first().asDict()
        assert all(v == 0 for v in diff.values())

    def test_stream_rules_differ_where_stated(self, spark):
        obs = observed(spark, [(20.0, 1000.0, 50.0), (21.0, None, 50.0), (22.0, 1001.0, None)])
        one, two = (features.features(obs, s).orderBy("ts").collect() for s in ("batch", "stream"))
        assert one[1].temperature_roll_z_60m == pytest.approx(1e6) and two[1].temperature_roll_z_60m is None
        assert one[1].temp_rate_ratio is None and two[1].temp_rate_ratio == pytest.approx(1.0)
        assert one[2].multivariate_z_disagreement is None

    def test_one_hot_station_is_split(self, spark, noisy):
        assert with_chunk(observed(spark, noisy)).select("chunk").distinct().count() == 3


class TestQuality:
    def test_raw_csv(self, spark, tmp_path):
        path = tmp_path / "raw.csv"
        path.write_text('"Date Time","p (mbar)","T (degC)","extra","rh (%)"\n01.02.2024 03:40:00,996.5,-8.02,1,93.3\n01.02.2024 03:50:00,nan,x,2,\n')
        rows = tables.raw_csv(spark, str(path)).collect()
        assert rows[0][1:] == (dt.datetime(2024, 2, 1, 3, 40), -8.02, 996.5, 93.3) and rows[1][2:] == (None, None, None)
        bad = tmp_path / "bad.csv"
        bad.write_text("a,b\n1,2\n")
        with pytest.raises(ValueError):
            tables.raw_csv(spark, str(bad))

    def test_duplicates(self, spark):
        rows = [(0, START, 1.0, 2.0, None)] * 3 + [(0, START, 9.0, 2.0, None), (1, START, 1.0, 2.0, 3.0)]
        df = spark.createDataFrame(rows, OBSERVATION)
        assert quality.duplicate_counts(df).first() == (5, 2, 3, 1)
        assert quality.conflicts(df).count() == 4 and quality.clean(df).count() == 3

    def test_empty(self, spark):
        df = spark.createDataFrame([], OBSERVATION)
        assert quality.duplicate_counts(df).first() == (0, 0, 0, 0)
        assert features.features(df).count() == 0 and quality.largest_gaps(df).count() == 0

    def test_requests(self, spark):
        df = spark.createDataFrame([("s", "2024-01-01T00:00:00", 1.0, float("nan"), None), ("s", "no time", 1.0, 2.0, 3.0)], "station_id string, timestamp string, temperature double, pressure double, humidity double")
        good, bad = tables.requests(df)
        assert good.first().pressure is None and good.count() == 1 and bad.first().timestamp == "no time"

    def test_manifest(self, spark, tmp_path):
        tables.save_manifest(spark, str(tmp_path / "m"), {"a": [1, 2.5], "b": "x"})
        assert tables.load_manifest(spark, str(tmp_path / "m")) == {"a": [1, 2.5], "b": "x"}


class TestSimulation:
    def test_labels_and_values(self, spark, sf):
        obs = tables.observations(tables.table(spark, sf, "events")).drop("event_id")
        drawn = simulate.draw_plan(obs, 2)
        out = simulate.inject(obs, drawn).cache()
        assert out.count() == obs.count()
        align = simulate.label_alignment(out, drawn).collect()
        assert all(r.unlabelled == 0 and r.mistyped == 0 for r in align) and len(align) == drawn.count()
        again = [tuple(r) for r in simulate.draw_plan(obs, 2).collect()]
        assert again == [tuple(r) for r in drawn.collect()]

    def test_share_of_rows(self, spark, sf):
        obs = tables.observations(tables.table(spark, sf, "events")).drop("event_id")
        drawn = simulate.draw_share(obs, 0.05)
        marked = simulate.inject(obs, drawn).where("is_anomaly = 1").count()
        assert 0.02 * 1000 <= marked <= 0.05 * 1000 + 144

    def test_no_overlap(self, spark):
        old, new = plan(spark), plan(spark).limit(3)
        assert joins.without_overlap(new, old).count() == 0 and joins.without_overlap(new, old.where("false")).count() == 3


class TestModels:
    @pytest.fixture(scope="class")
    def table(self, spark, sf):
        obs = tables.observations(tables.table(spark, sf, "events")).drop("event_id")
        return batch.feature_table(simulate.inject(obs, plan(spark)).select("station_id", "ts", *SENSORS))

    @pytest.fixture(scope="class")
    def artifacts(self, table):
        return batch.fit(table, rows=600, trees=20)

    def test_reconstruction_against_numpy(self, table, artifacts):
        scaler = artifacts.components.scaler
        x = table.select(*scaler.columns).toPandas().astype(float).to_numpy()
        x = np.where(np.isnan(x), scaler.median, x)
        dev = detectors.development(table, 600).select(*scaler.columns).toPandas().astype(float).to_numpy()
        dev = np.where(np.isnan(dev), scaler.median, dev)
        sd = dev.std(axis=0)
        z = lambda m: (m - dev.mean(axis=0)) / np.where(sd == 0, 1, sd)
        _, s, v = np.linalg.svd(z(dev) - z(dev).mean(axis=0), full_matrices=False)
        k = int(np.searchsorted(np.cumsum(s**2) / np.sum(s**2), 0.95, side="right")) + 1
        want = np.mean((z(x) - z(x) @ v[:k].T @ v[:k]) ** 2, axis=1)
        got = artifacts.components.score(table).select("pca_score").toPandas()["pca_score"].to_numpy()
        assert len(artifacts.components.components) == k and np.allclose(np.sort(got), np.sort(want), rtol=1e-6, atol=1e-9)

    def test_round_trip(self, spark, table, artifacts, tmp_path):
        artifacts.save(spark, str(tmp_path / "a"))
        loaded = batch.Artifacts.load(spark, str(tmp_path / "a"))
        one, two = (a.fused(table).select("station_id", "ts", "pca_score", "isolation_forest_score", "final_anomaly_score", "fault_type_hint") for a in (artifacts, loaded))
        assert all(v == 0 for v in joins.table_difference(one, two, ["station_id", "ts"]).first().asDict().values())

    def test_forest_finds_outliers(self, spark):
        rng = np.random.default_rng(0)
        rows = [(0, minutes(i), *map(float, rng.normal(size=3))) for i in range(500)] + [(0, minutes(600 + i), 9.0, -9.0, 9.0) for i in range(3)]
        df = spark.createDataFrame(rows, OBSERVATION)
        scaler = detectors.Scaler.fit(df)
        forest = detectors.IsolationForest.fit(df, scaler, trees=50)
        scores = forest.score(df).toPandas().sort_values("ts")["isolation_forest_score"].to_numpy()
        assert scores[-3:].min() > np.quantile(scores[:-3], 0.99)

    def test_forest_is_the_same_for_any_partitioning(self, spark):
        rng = np.random.default_rng(2)
        rows = [(k % 3, minutes(k), *map(float, rng.normal(size=3))) for k in range(400)]
        df = spark.createDataFrame(rows, OBSERVATION)
        scaler = detectors.Scaler.fit(df)
        one, two = (detectors.IsolationForest.fit(d, scaler, trees=7, size=64) for d in (df.coalesce(1), df.repartition(5, "pressure")))
        assert len(one.trees) == 7 and all(np.array_equal(a, b) for x, y in zip(one.trees, two.trees, strict=True) for a, b in zip(x, y, strict=True))
        assert all(tree[4][0] == 64 for tree in one.trees)

    def test_pipeline_of_stages_round_trip(self, spark, table, tmp_path):
        stages_ = [stages.StatisticalDetector(rows=300), stages.ComponentsDetector(rows=300), stages.ForestDetector(rows=300, trees=5, size=32)]
        Pipeline(stages=stages_).save(str(tmp_path / "unfitted"))
        model = Pipeline.load(str(tmp_path / "unfitted")).fit(table)
        model.save(str(tmp_path / "fitted"))
        names = [f"{k}_{c}" for k in ("statistical", "pca", "isolation_forest") for c in ("score", "prediction")]
        one, two = (m.transform(table).select("station_id", "ts", *names) for m in (model, PipelineModel.load(str(tmp_path / "fitted"))))
        assert all(v == 0 for v in joins.table_difference(one, two, ["station_id", "ts"]).first().asDict().values())
        forest = model.stages[2].detector()
        assert len(forest.trees) == 5 and forest.size == 32

    def test_path_normaliser(self):
        assert detectors.path_normaliser(1) == 0 and detectors.path_normaliser(2) == 1
        assert detectors.path_normaliser(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


class TestEvaluation:
    def test_areas_against_definition(self, spark):
        rng = np.random.default_rng(5)
        y = rng.random(300) < 0.3
        s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, is_anomaly int")
        got = evaluate.areas(evaluate.curve(df, "score")).first()
        pos, neg = s[y], s[~y]
        roc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
        cuts = np.unique(s)[::-1]
        tp = np.array([(pos >= c).sum() for c in cuts])
        fp = np.array([(neg >= c).sum() for c in cuts])
        precision, recall = tp / (tp + fp), tp / y.sum()
        ap = np.sum(np.diff(np.concatenate([[0], recall])) * precision)
        trap = np.trapezoid(np.concatenate([[1.0], precision]), np.concatenate([[0.0], recall]))
        assert (got.roc_auc, got.average_precision, got.pr_auc_trapezoid) == pytest.approx((roc, ap, trap))

    def test_zero_division(self, spark):
        df = spark.createDataFrame([(0, 0)], "is_anomaly int, predicted int")
        assert evaluate.rates(evaluate.confusion(df)).first().asDict() == {"tp": 0, "fp": 0, "tn": 1, "fn": 0, "precision": 0.0, "recall": 0.0, "f1": 0.0, "accuracy": 1.0, "fpr": 0.0}


class TestStream:
    def run(self, spark, rows, tmp_path):
        """(station, minute, sensors) records in arrival order, two micro-batches."""
        schema = "station_id int, seq long, ts timestamp_ntz, temperature double, pressure double, humidity double"
        data = [(st, i, minutes(m), *v) for i, (st, m, v) in enumerate(rows)]
        half = len(data) // 2
        for k, part in enumerate((data[:half], data[half:])):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            process_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
            assert k < 2
        return {r.seq: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    def test_order_isolation_and_warm_up(self, spark, tmp_path):
        flat = (20.0, 1012.0, 55.0)
        rows = [(0, 10 * i, (flat[0] + 0.1 * (i % 3), flat[1], flat[2])) for i in range(14)]
        rows += [(0, 100, flat), (0, 130, flat), (1, 0, flat), (0, 140, (None, None, None))]
        got = self.run(spark, rows, tmp_path)
        assert [got[i].processing_state for i in (0, 10, 11, 13)] == ["WARMUP", "WARMUP", "PROCESSED", "PROCESSED"]
        assert got[14].processing_state == got[15].processing_state == "REJECTED" and got[14].anomaly_score is None
        assert got[16].processing_state == "WARMUP" and got[16].sensor_health_temperature == 100.0
        assert (got[17].fault_type, got[17].severity, got[17].affected_sensor) == ("MISSING", "CRITICAL", "ALL_SENSORS")

    def test_step_after_flat(self):
        us = np.arange(41, dtype=np.int64) * 600_000_000
        values = np.array([(20.0 + 0.01 * (i % 2), 1012.0, 55.0 + i % 2) for i in range(40)] + [(45.0, 1012.0, 55.0)])
        out = Station().process(us, values, stored())[-1]
        assert out["anomaly_flag"] and out["suggested_corrections"] and out["top_features"] != "[]"

    def series(self, n: int = 500):
        rng = np.random.default_rng(7)
        us = np.cumsum(rng.choice([600, 600, 600, 1200, 4000], n)).astype(np.int64) * 1_000_000
        values = np.stack([20 + rng.normal(size=n).round(2), 1000 + rng.normal(size=n).round(1), np.where(np.arange(n) % 90 < 40, 55.0, rng.integers(40, 60, n))], 1)
        values[rng.random(values.shape) < 0.05] = np.nan
        return us, values

    def test_features_equal_the_batch_plan(self, spark):
        """All 147, whatever the micro-batches are."""
        us, values = self.series(300)
        rows = [(0, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(t)), *(None if math.isnan(x) else float(x) for x in v)) for t, v in zip(us, values, strict=True)]
        want = features.features(spark.createDataFrame(rows, OBSERVATION), "stream").orderBy("ts").select(*FEATURES).toPandas().astype(float)
        whole = features_of(us, values, 0, dict.fromkeys(SENSORS, 0))
        assert list(whole.columns) == list(FEATURES)
        for c in FEATURES:
            assert np.allclose(whole[c], want[c], equal_nan=True, rtol=1e-6, atol=1e-6), c
        # The same from the state: three micro-batches.
        station, held, start = Station(), [], 0
        for stop in (7, 150, 300):
            before = len(station.history)
            times = np.concatenate([[h[0] for h in station.history], us[start:stop]]).astype(np.int64)
            data = np.concatenate([np.array([h[1:] for h in station.history], float).reshape(-1, 3), values[start:stop]])
            held.append(features_of(times, data, before, station.unchanged))
            station.process(us[start:stop], values[start:stop], stored())
            start = stop
        got = pd.concat(held, ignore_index=True)
        for c in FEATURES:
            assert np.allclose(got[c], whole[c], equal_nan=True, rtol=1e-6, atol=1e-6), c

    def test_micro_batches_and_the_future_change_nothing(self):
        us, values = self.series()
        one = Station().process(us, values, stored())
        station, parts = Station(), []
        for k in range(0, len(us), 37):
            station = Station(**json.loads(json.dumps(station.__dict__)))
            parts += station.process(us[k : k + 37], values[k : k + 37], stored())
        short = Station().process(us[:200], values[:200], stored())
        for a, b in (*zip(one, parts, strict=True), *zip(one[:200], short, strict=True)):
            assert {k: v for k, v in a.items() if isinstance(v, str)} == {k: v for k, v in b.items() if isinstance(v, str)}
            assert all(v == pytest.approx(b[k], abs=1e-9) for k, v in a.items() if isinstance(v, float))

    def test_equals_batch_under_stream_rules(self, spark, sf):
        """Scores of the online path and of the batch plan, row by row, with three fitted detectors over all features."""
        obs = tables.observations(tables.table(spark, sf, "events")).where("station_id = 2").drop("event_id")
        rows = batch.feature_table(obs, "stream")
        fitted = batch.fit(rows, rows=150, trees=20)
        fused = fitted.fused(rows).orderBy("ts").collect()
        us = np.array([int((r.ts - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000) for r in fused], np.int64)
        values = np.array([[np.nan if v is None else v for v in (r.temperature, r.pressure, r.humidity)] for r in fused], float)
        found = Station().process(us, values, fitted)
        for r, out in zip(fused, found, strict=True):
            assert out["anomaly_score"] == pytest.approx(r.final_anomaly_score, abs=1e-6)
            assert out["confidence"] == pytest.approx(r.anomaly_confidence, abs=1e-6)
        top = [json.loads(x["top_features"]) for x in found if x["top_features"] != "[]"]
        assert top and all(t["feature"] in FEATURES for x in top for t in x)
        assert all([abs(t["contribution"]) for t in x] == sorted((abs(t["contribution"]) for t in x), reverse=True) for x in top)

    def test_reset_clears_a_station(self, spark, tmp_path):
        schema = "station_id int, seq long, ts timestamp_ntz, temperature double, pressure double, humidity double, reset boolean"
        rows = [(0, i, minutes(10 * i), 20.0 + i % 3, 1000.0, 50.0, False) for i in range(13)]
        rows += [(0, 13, minutes(0), None, None, None, True), (0, 14, minutes(5), 20.0, 1000.0, 50.0, False)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
        process_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        got = {r.seq: r.processing_state for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == {**{i: "WARMUP" for i in range(11)}, 11: "PROCESSED", 12: "PROCESSED", 14: "WARMUP"}

    def test_shapley_values_by_all_subsets(self):
        """Against the definition, on stored trees and on random ones of up to 10 features."""
        rng = np.random.default_rng(3)
        for forest in (stored().forest, self.random_forest(rng, 10), self.random_forest(rng, 4)):
            x = rng.normal(size=(12, len(forest.scaler.columns)))
            got = forest.shapley(x, at_once=64)
            for i, row in enumerate(x):
                want = np.mean([self.by_definition(tree, row) for tree in forest.trees], axis=0)
                assert np.allclose(got[i], want, atol=1e-9)
            depth = -np.log2(forest.isolation(x)) * detectors.path_normaliser(forest.size)
            assert np.allclose(got.sum(axis=1), depth - forest.expected_depth())

    @staticmethod
    def random_forest(rng, features: int) -> detectors.IsolationForest:
        names = [f"f{k}" for k in range(features)]
        trees = [detectors.IsolationForest._tree(rng.normal(size=(40, features)), rng) for _ in range(3)]
        return detectors.IsolationForest(detectors.Scaler(names, [0.0] * features, [0.0] * features, [1.0] * features), trees, 40)

    @staticmethod
    def by_definition(tree, row: np.ndarray) -> np.ndarray:
        feature, cut, left, depth, held = tree

        @functools.cache
        def value(known: frozenset, node: int = 0) -> float:
            k = int(feature[node])
            if k < 0:
                return float(depth[node])
            below = [int(left[node]), int(left[node]) + 1]
            if k in known:
                return value(known, below[int(row[k] > cut[node])])
            return sum(held[c] / held[node] * value(known, c) for c in below)

        n, out = len(row), np.zeros(len(row))
        for k in range(n):
            others = [f for f in range(n) if f != k]
            for size in range(n):
                weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                out[k] += weight * sum(value(frozenset({*c, k})) - value(frozenset(c)) for c in itertools.combinations(others, size))
        return out

    SCHEMA = "station_id int, seq long, ts timestamp_ntz, temperature double, pressure double, humidity double"

    def records(self, n: int, stations: int = 2) -> list[tuple]:
        us, values = self.series(n)
        return [(i % stations, i, minutes(0) + dt.timedelta(microseconds=int(us[i // stations])), *(None if math.isnan(v) else float(v) for v in values[i])) for i in range(n)]

    def through(self, spark, rows, root: str, **options) -> dict:
        """Records as a log in one file, through the record source into ``root``."""
        spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{root}/log")
        run_records(spark, f"{root}/log", T._parse_datatype_string(self.SCHEMA), f"{root}/o", lambda d: d, **options)
        return {r.seq: r for r in results_of(spark, f"{root}/o").collect()}

    def test_a_poisoned_record_fails_alone(self, spark, tmp_path):
        rows = self.records(60)
        late = dt.datetime(2600, 1, 1)
        poisoned = [*rows[:30], (0, 1000, late, 1.0, 2.0, 3.0), *rows[30:50], (1, 1001, late, 1.0, None, 3.0), (1, 1002, late, 1.0, None, 3.0), *rows[50:]]
        poisoned = [(r[0], i, *r[2:]) for i, r in enumerate(poisoned)]
        clean = self.through(spark, rows, str(tmp_path / "a"))
        found = self.through(spark, poisoned, str(tmp_path / "b"), rows_per_trigger=37)
        letters = dead_letters(spark, str(tmp_path / "b" / "o")).orderBy("seq").collect()
        assert [(r.station_id, r.seq, r.temperature) for r in letters] == [(0, 30, 1.0), (1, 51, 1.0), (1, 52, 1.0)] and all("OutOfBounds" in r.error for r in letters)
        kept = sorted(found)
        assert len(kept) == 60
        for want, seq in zip((clean[k] for k in sorted(clean)), kept, strict=True):
            assert want.asDict() | {"seq": 0} == found[seq].asDict() | {"seq": 0}

    def test_restart_loses_and_repeats_nothing(self, spark, tmp_path):
        rows = self.records(90)
        whole = self.through(spark, rows, str(tmp_path / "a"))
        root, schema = str(tmp_path / "b"), T._parse_datatype_string(self.SCHEMA)
        first, second = (spark.createDataFrame(part, self.SCHEMA).coalesce(1) for part in (rows[:60], rows[60:]))
        first.write.parquet(f"{root}/1")
        (tmp_path / "b" / "log").mkdir()
        shutil.copy(next((tmp_path / "b" / "1").glob("*.parquet")), tmp_path / "b" / "log" / "a.parquet")
        run = lambda **k: run_records(spark, f"{root}/log", schema, f"{root}/o", lambda d: d, rows_per_trigger=7, **k)
        run(most_batches=3)
        second.write.parquet(f"{root}/2")
        shutil.copy(next((tmp_path / "b" / "2").glob("*.parquet")), tmp_path / "b" / "log" / "b.parquet")
        for _ in range(2):
            run()
        found = spark.read.parquet(f"{root}/o/out").collect()
        assert sorted(r.seq for r in found) == list(range(90))
        assert max(collections.Counter(r.batch for r in found).values()) <= 7
        assert {r.seq: r.anomaly_score for r in found} == {q: r.anomaly_score for q, r in whole.items()}

    def test_files_that_sort_too_early_are_refused(self, spark, tmp_path):
        table = pa.table({"seq": [1, 2, 3]})
        pq.write_table(table, tmp_path / "b.parquet")
        reader = RecordLogReader({"path": str(tmp_path), "rowsPerTrigger": "2"}, T._parse_datatype_string("seq long"))
        assert reader.latestOffset()["row"] == 2
        end = reader.latestOffset()
        assert end["row"] == 3 and reader.latestOffset() == end
        parts = reader.partitions({"file": "", "row": 0}, end)
        assert [v for p in parts for b in reader.read(p) for v in b["seq"].to_pylist()] == [1, 2, 3]
        pq.write_table(table, tmp_path / "a.parquet")
        with pytest.raises(ValueError, match="sorts before"):
            reader.latestOffset()

    def test_state_is_typed_and_read_back(self, spark, tmp_path):
        rows = self.records(80)
        self.through(spark, rows, str(tmp_path), rows_per_trigger=9)
        state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "o" / "state"))
        counters = {r.key.station_id: r.value for r in state("station").collect()}
        for station in (0, 1):
            own = [r for r in rows if r[0] == station]
            one = Station()
            one.process(np.array([(r[2] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for r in own]), np.array([r[3:] for r in own], float), stored())
            held = counters[station]
            assert held.last_us == one.history[-1][0] and held.listed <= 2 * len(one.history) + 64
            assert all(held[f"unchanged_{s}"] == one.unchanged[s] and held[f"health_{s}"] == pytest.approx(one.health[s]) for s in SENSORS)
            assert all(held[f"streak_{k}"] == v for k, v in one.streaks.items())
        listed = state("history").groupBy("key.station_id").count().collect()
        assert {r.station_id: r["count"] for r in listed} == {k: v.listed for k, v in counters.items()}

    def test_a_silent_station_is_forgotten(self, spark, tmp_path):
        rows = self.records(40, 1)
        root, schema = str(tmp_path), T._parse_datatype_string(self.SCHEMA)
        for k, part in enumerate((rows[:30], [(7, 0, *rows[0][2:])], rows[30:])):
            if k:
                time.sleep(3)
            spark.createDataFrame(part, self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
            source = spark.readStream.schema(schema).parquet(f"{root}/in")
            sink(process_stream(source, silent_ms=2000), f"{root}/o", once=True).awaitTermination(60)
        found = {r.seq: r for r in results_of(spark, f"{root}/o").where("station_id = 0").collect()}
        assert found[29].processing_state == "PROCESSED" and found[30].processing_state == "WARMUP"

    def test_every_subscriber_for_itself(self, spark, tmp_path):
        rows = self.records(40)
        spark.createDataFrame(rows, self.SCHEMA).repartition(4).write.parquet(str(tmp_path / "in"))
        registry = str(tmp_path / "registry")
        (tmp_path / "file").write_text("not a folder")
        for name, folder in (("a", tmp_path / "a"), ("bad", tmp_path / "file" / "x"), ("c", tmp_path / "c")):
            subscribers.subscribe(registry, name, str(folder))
        source = spark.readStream.schema(self.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        subscribers.serve(source, registry, str(tmp_path / "staging"), str(tmp_path / "state")).awaitTermination()
        schema = T._parse_datatype_string(self.SCHEMA)
        for name in ("a", "c"):
            assert sorted(r.seq for r in subscribers.received(spark, str(tmp_path / name), schema).collect()) == list(range(40))
        assert [x["name"] for x in subscribers.active(registry)] == ["a", "c"]
        assert [(x["name"], x["batch"]) for x in subscribers.dropped(registry)] == [("bad", 0)]
        # A micro-batch that is committed again delivers nothing again.
        writer = subscribers.SubscriberWriter({"registry": registry, "staging": str(tmp_path / "staging")})
        batch = pa.RecordBatch.from_pydict({"seq": [99]})
        writer.commit([writer.write(iter([batch]))], 0)
        assert len(subscribers.received(spark, str(tmp_path / "a"), schema).collect()) == 40

    def test_progress_of_every_batch(self, spark, tmp_path):
        listener = ProgressTable(spark, str(tmp_path / "progress"))
        spark.streams.addListener(listener)
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")
        try:
            (tmp_path / "log").mkdir()
            pq.write_table(pa.table({"seq": list(range(12))}), tmp_path / "log" / "a.parquet")
            query = record_stream(spark, str(tmp_path / "log"), T._parse_datatype_string("seq long"), 1).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
            query.processAllAvailable()
            query.stop()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            time.sleep(2)
        finally:
            spark.streams.removeListener(listener)
            spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        held = listener.table().where(F.col("run_id") == str(query.runId))
        assert held.count() == 12 > len(query.recentProgress)
        out = latency_summary(held).first()
        each = sorted(r.ms for r in held.collect())
        assert (out.batches, out.rows, out.max_ms, out.min_ms) == (12, 12, each[-1], each[0])
        assert out.energy_mj_per_row == pytest.approx(7.5 * out.mean_ms) and out.energy_j == pytest.approx(7.5 * sum(each) / 1000)


def test_scored_features_have_what_evidence_needs(spark, sf):
    obs = tables.observations(tables.table(spark, sf, "events")).drop("event_id")
    assert {"multivariate_z_disagreement", "humidity_roll_mean_360m"} <= set(scored_features(obs).columns)
