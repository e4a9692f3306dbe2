"""Statistics of rolling frames, bit by bit against DuckDB's: what decides ties and halves further on."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from driftwarden.operators.features import add_rolling
from driftwarden.operators.timeline import with_chunk


@pytest.fixture(scope="module")
def both(spark):
    """Ten-minute readings of one decimal over three days, some missing, and DuckDB's windows over them."""
    draw = np.random.default_rng(5)
    rows = pd.DataFrame({"station_id": np.repeat([0, 1], 432), "us": 1_704_067_200_000_000 + np.tile(np.arange(432), 2) * 600_000_000})
    for s, low in (("temperature", 15), ("pressure", 980), ("humidity", 40)):
        rows[s] = np.where(draw.random(len(rows)) < 0.1, np.nan, low + draw.integers(0, 100, len(rows)) / 10)
    df = spark.createDataFrame(rows).selectExpr("CAST(station_id AS INT) AS station_id", "CAST(timestamp_micros(us) AS TIMESTAMP_NTZ) AS ts", *(f"nullif({s}, double('NaN')) AS {s}" for s in ("temperature", "pressure", "humidity")))
    found = add_rolling(with_chunk(df), (60,)).toPandas().sort_values(["station_id", "us"], ignore_index=True)
    s, w = "pressure", "(PARTITION BY station_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)"
    names = {"mean": f"avg({s})", "std": f"stddev_samp({s})", "var": f"var_samp({s})", "median": f"quantile_cont({s}, 0.5)", "low": f"quantile_cont({s}, 0.25)", "high": f"quantile_cont({s}, 0.75)"}
    expected = duckdb.sql(f"SELECT {', '.join(f'{x} OVER {w} AS {n}' for n, x in names.items())} FROM (SELECT station_id, us, CASE WHEN NOT isnan({s}) THEN {s} END AS {s} FROM rows) ORDER BY station_id, us").df()
    return found, expected


@pytest.mark.parametrize("name", ["mean", "std", "var", "median"])
def test_moments(both, name):
    found, expected = both
    np.testing.assert_array_equal(found[f"pressure_roll_{name}_60m"].to_numpy(float), expected[name].to_numpy(float))


def test_quartile_distance(both):
    found, expected = both
    np.testing.assert_array_equal(found["pressure_roll_iqr_60m"].to_numpy(float), (expected["high"] - expected["low"]).to_numpy(float))
