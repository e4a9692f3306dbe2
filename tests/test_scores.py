"""Scores of the stored detectors where the rounding is decided by the last digits, against the SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from driftwarden.operators import detectors
from driftwarden.plans.fitted import stored
from driftwarden.plans.oracle import ORACLE
from driftwarden.plans.queries import QUERIES


@pytest.fixture(scope="module")
def halves(tmp_path_factory, n: int = 4000) -> str:
    """Events with z-scores on halves of the fourth digit.

    After each gap of 50 minutes come three equal pressures and one 64 steps away, so the deviation is 32 steps; the next reading lies an
    odd number of steps off the mean, so its z-score is an odd number of 32nds.
    """
    draw, i = np.random.default_rng(1), np.arange(n)
    place, station_gap = i // 4 % 60, i // 240 * 4 + i % 4
    apart, low = draw.integers(0, 4, n)[station_gap], draw.integers(0, 10, n)[i // 240]
    k = np.where(place < 4, low + np.where(place == apart, 64, 0), np.where(place == 4, low + draw.integers(33, 50, n) * 2 + 1, draw.integers(0, 100, n)))
    path = tmp_path_factory.mktemp("halves")
    pd.DataFrame({"event_id": i, "value": np.zeros(n), "props": [f'{{"k": {v}}}' for v in k]}).to_parquet(path / "events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["model_scores", "pipeline_scores"])
def test_halves_are_rounded_as_by_sql(spark, halves, name):
    found = QUERIES[name](spark, halves).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{halves}/events.parquet'")
    expected = con.execute(ORACLE[name]).df()
    keys = ["station_id", "ts"]
    found, expected = (df[list(expected.columns)].sort_values(keys, ignore_index=True) for df in (found, expected))
    assert len(found) == len(expected) == 4000
    for c in expected.columns.drop(keys):
        np.testing.assert_array_equal(found[c].to_numpy(float), expected[c].to_numpy(float), err_msg=c)


def test_errors_whatever_the_batch(rows: int = 600):
    draw = np.random.default_rng(2)
    wide = detectors.PrincipalComponents(None, (draw.normal(size=(50, 147)) / 147).tolist())
    x = draw.normal(size=(rows, 147))
    whole = wide.errors(x)
    np.testing.assert_array_equal(np.concatenate([wide.errors(x[s : s + 7]) for s in range(0, rows, 7)]), whole)
    c = np.array(wide.components)
    np.testing.assert_allclose(whole, np.mean(np.square(x - (x @ c.T) @ c), axis=1), rtol=1e-12)
    assert wide.errors(x[:0]).shape == (0,)


def test_errors_are_summed_as_in_the_sql(rows: int = 2000):
    model = stored().components
    x = np.random.default_rng(3).normal(size=(rows, 6))
    frame, c = pd.DataFrame(x, columns=[f"x{j}" for j in range(6)]).reset_index(names="i"), model.components  # noqa: F841
    y = ", ".join(" + ".join(f"x{j} * {v}::DOUBLE" for j, v in enumerate(row)) + f" AS y{i}" for i, row in enumerate(c))
    left = " + ".join(f"pow(x{j} - ({' + '.join(f'y{i} * {row[j]}::DOUBLE' for i, row in enumerate(c))}), 2)" for j in range(6))
    expected = duckdb.sql(f"SELECT ({left}) / 6.0::DOUBLE AS e FROM (SELECT *, {y} FROM frame) ORDER BY i").df()["e"]
    np.testing.assert_array_almost_equal_nulp(model.errors(x), expected.to_numpy(), 2)  # its pow is not always the nearest square
