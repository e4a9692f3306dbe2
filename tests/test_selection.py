from __future__ import annotations

import numpy as np
import pytest

from driftwarden.operators.selection import exact_quantiles, with_quantiles

LEVELS = (0.0, 0.05, 0.5, 0.995, 1.0)


def values(rng) -> dict:
    """Groups by key: one of most rows, few distinct values, powers far apart, one row, none but nulls."""
    return {
        "hot": rng.normal(size=4000).round(3),
        "flat": rng.integers(0, 3, 900).astype(float),
        "wide": np.concatenate([10.0 ** rng.integers(-300, 300, 500), -(10.0 ** rng.integers(-300, 300, 300))]),
        "one": np.array([7.5]),
        None: rng.normal(size=700) * 1e-9,
    }


@pytest.mark.parametrize(("kept", "points"), [(20_000, 1_000), (150, 20)])
def test_equals_sorting(spark, kept, points):
    held = values(np.random.default_rng(4))
    rows = [(k, float(v)) for k, x in held.items() for v in x] + [("hot", None), ("void", None)]
    found = {r.k: r.q for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), "v", ["k"], LEVELS, kept, points).collect()}
    assert set(found) == set(held)
    for k, x in held.items():
        x = np.sort(x)
        place = np.array(LEVELS) * (len(x) - 1)
        low, high = x[np.floor(place).astype(int)], x[np.ceil(place).astype(int)]
        assert np.allclose(found[k], low + (place - np.floor(place)) * (high - low), rtol=1e-12)


def test_without_groups_and_beside_other_figures(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert exact_quantiles(df, "v", [], (0.25, 0.5), 10, 5).first().q == [25.0, 50.0]
    assert exact_quantiles(df.limit(0), "v", [], (0.5,)).count() == 0
    grouped = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 2), ("b", None, 1), (None, 5.0, 1)], "k string, v double, n int")
    counted = grouped.groupBy("k").count()
    assert {(r.k, r["count"], r.m) for r in with_quantiles(counted, grouped, "v", ["k"], {"m": 0.5}).collect()} == {("a", 2, 2.0), ("b", 1, None), (None, 1, 5.0)}
