from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def documents(spark, texts, first: int = 0, lang: str | None = "en", extra: dict | None = None):
    rows = [(first + i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    from pyspark.sql import functions as F

    for name, value in (extra or {}).items():
        df = df.withColumn(name, F.lit(value))
    return df


def same(df, con, sql: str) -> None:
    """Equal rows whatever their order, columns by name."""
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=str)
    assert sorted(names) == columns
    assert got == want


def prose(seed: int, n: int, words: int = 3000) -> str:
    """Invented words, seeded."""
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))
