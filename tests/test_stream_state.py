from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from driftwarden.plans.queries import record_schema
from driftwarden.session import scratch_path
from driftwarden.streaming.stations import corrections, results_of, run_records


def test_state_has_no_more_partitions_than_cores(spark, sf):
    """Each micro-batch opens and commits every partition, so empty ones cost time."""
    path, root, name = f"{sf}/events.parquet", scratch_path(spark, "stream"), "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "40")
    try:
        run_records(spark, path, record_schema(spark, path), root)
        assert spark.conf.get(name) == "40"
    finally:
        spark.conf.set(name, before)
    state = Path(root.removeprefix("file://")) / "state" / "state" / "0"
    assert len([p for p in state.iterdir() if p.name.isdigit()]) == spark.sparkContext.defaultParallelism
    assert results_of(spark, root).count() == spark.read.parquet(path).count()


def test_corrections_are_medians_of_the_history_and_the_row():
    draw = np.random.default_rng(3)
    us = np.cumsum(draw.integers(1, 90, 300)) * 60_000_000
    values = np.where(draw.random((300, 3)) < 0.3, np.nan, draw.integers(0, 999, (300, 3)) / 10)
    found = corrections(us, values, 40)
    for i in range(40, 300):
        rows = values[(us >= us[i] - 360 * 60_000_000) & (us <= us[i])]
        for k, s in enumerate(("temperature", "pressure", "humidity")):
            x = rows[~np.isnan(rows[:, k]), k]
            assert np.isnan(found[s][i - 40]) if not len(x) else found[s][i - 40] == np.floor(np.median(x) * 100 + 0.5) / 100


def test_counts_of_a_micro_batch_follow_the_rows():
    from driftwarden.streaming.stations import counted

    draw = np.random.default_rng(5)
    for before in (0, 4):
        grown, reset = draw.random(500) < 0.7, draw.random(500) < 0.1
        count, want = before, []
        for g, r in zip(grown, reset):
            count = (0 if r else count) + int(g)
            want.append(count)
        assert counted(grown, reset, before).tolist() == want


def test_a_micro_batch_is_taken_by_column(monkeypatch):
    """Attribution, texts and JSON a row at a time took most of a micro-batch's time; now nothing but health goes by rows."""
    from driftwarden.streaming import stations

    calls, own = [], stations.attribute
    monkeypatch.setattr(stations, "attribute", lambda *a: calls.append(1) or own(*a))
    us = np.arange(400) * 600_000_000
    values = np.random.default_rng(2).normal(20, 9, (400, 3))
    values[::37] = np.nan
    whole, single, a = stations.Station(), stations.Station(), stations.stored()
    found = whole.taken(us, values, a)
    assert len(calls) == 1
    for i, r in enumerate(found):
        (one,) = single.taken(us[i : i + 1], values[i : i + 1], a)
        assert {k: v for k, v in r.items() if not isinstance(v, float)} == {k: v for k, v in one.items() if not isinstance(v, float)}
        assert [v for v in r.values() if isinstance(v, float)] == pytest.approx([v for v in one.values() if isinstance(v, float)])
    assert whole.streaks == single.streaks


def test_workers_do_not_import_spark_ml():
    """A micro-batch starts a worker for each partition of the state."""
    code = "import sys, driftwarden.streaming.stations; print('pyspark.ml.feature' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True).stdout.split()[-1] == "False"
