from __future__ import annotations

import numpy as np
import pandas as pd

from driftwarden.operators import detectors, quality, timeline
from driftwarden.plans import queries


def test_a_constant_in_any_partitions(spark):
    """A partition of 49 equal rows is merged with the mean (1 / 49) * 49, which is not 1."""
    rows = spark.range(98, numPartitions=2).selectExpr("1.0D AS fixed", "IF(id = 3, 1.0D, NULL) AS once", "CAST(NULL AS DOUBLE) AS never", "CAST(id AS DOUBLE) AS id")
    found = {r.column: (r.std, r.constant) for r in quality.constant_columns(rows, ["fixed", "once", "never", "id"]).collect()}
    assert found["fixed"] == (0.0, True) and found["once"] == found["never"] == (None, True) and not found["id"][1]


def test_sorted_frames_give_the_sliding_quantiles(rows: int = 500):
    draw = np.random.default_rng(3)
    x = np.where(draw.random(rows) < 0.1, np.nan, draw.integers(0, 100, rows) / 10)
    end = np.arange(rows)
    for width in (0, 1, 6, 36):
        start = np.maximum(end - width, 0)
        slid = pd.Series(x).rolling(timeline.Frames(start, end), min_periods=1)
        held = timeline.sorted_frames(x, start, end)
        for q in (0, 0.25, 0.5, 0.75, 1):
            np.testing.assert_array_equal(timeline.quantile_of(*held, q), timeline.quantile(slid, q))


def test_blocks_go_down_all_trees(rows: int = 700):
    """Depths by a walk down each tree, with the same sums."""
    x = np.random.default_rng(5).normal(size=(rows, 9))
    trees = [detectors.IsolationForest._tree(x[k * 30 : k * 30 + 64], np.random.default_rng(k)) for k in range(20)]
    forest = detectors.IsolationForest(None, [*trees, tuple(np.array([v]) for v in (-1, 0.0, 0, 3.0, 1))], 64)
    want = np.zeros(rows)
    for feature, cut, left, depth, _ in forest.trees:
        for i, row in enumerate(x):
            node = 0
            while feature[node] >= 0:
                node = left[node] + (row[feature[node]] > cut[node])
            want[i] += depth[node]
    np.testing.assert_array_equal(forest.isolation(x, 128), np.exp2(-want / 21 / detectors.path_normaliser(64)))


def test_no_feature_travels_that_a_row_gives_alone(spark, sf, monkeypatch):
    seen, written = [], []
    own, write = timeline.with_frame_statistics, queries.materialize
    monkeypatch.setattr(timeline, "with_frame_statistics", lambda df, *a: seen.append(df.columns) or own(df, *a))
    monkeypatch.setattr(queries, "materialize", lambda df, name="step": written.append((name, len(df.columns))) or write(df, name))
    rows, dev = queries.whole_and_development(spark, sf)
    assert seen and not any({"hour_sin", "humidity_missing", "pressure_rate_per_hour"} & {*c} for c in seen)
    assert written[0] == ("rows", 5) and [n for n, _ in written] == ["rows", "dev"], "features of all rows are not written"
    assert dev.count() == min(rows.count(), detectors.DEVELOPMENT_ROWS)


def test_differences_by_digest(spark):
    """Counts as by values, whether a digest differs or not; a value and NULL that change places differ."""
    table = lambda *rows: spark.createDataFrame(rows, "station_id int, ts long, a double, b double, c int")
    left = table((0, 1, 1.0, None, 3), (0, 2, 2.0, 2.0, 3), (1, 1, 5.0, None, 1))
    near = table((0, 1, 1.0, None, 3), (0, 3, 2.0, 2.0, 3), (1, 1, 5.0, None, 1))
    for right in (near, near.unionByName(table((1, 2, 0.0, 0.0, 0))), table((0, 1, None, 1.0, 3), (0, 2, 2.0 + 1e-12, 2.0, 4), (1, 1, 5.0, None, 1))):
        by_value, by_digest = (sorted(map(tuple, f(left, right, ["station_id", "ts"]).collect())) for f in (queries.apart, queries.apart_by_digest))
        assert by_value == by_digest


def test_the_plan_of_faults_needs_no_python_worker(spark):
    tree = queries.plan(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in tree and "ExistingRDD" not in tree and "LogicalRDD" not in tree
