from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from driftwarden.plans.oracle import ORACLE
from driftwarden.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]
TABLES = "events documents".split()


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"station_id", "ts", "statistical_score", "dominant_sensor"} == set(rows[0].asDict())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_others_run(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows and all(x is not None for x in rows[0][:2])


def test_stands_without_the_corpus_operators(tmp_path):
    """The rest imports and registers its queries with the corpus folders gone."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fusion_v2' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    env = os.environ | {"PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)
