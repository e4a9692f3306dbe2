from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.helpers import duck, same

from driftwarden.llm import vectorcodes as V
from driftwarden.llm.queries import OP13_SQL, op13_vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Codes by the definition, in Python integers."""
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cuts = V.cuts(len(kept[0][1]), parts)
    books = [[v[a:b] for _, v in kept[:entries]] for a, b in cuts]

    def nearest(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            groups = {}
            for _, v in kept:
                groups.setdefault(nearest(v[a:b], books[p])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else old for k, old in enumerate(books[p])]
    out = []
    for i, v in kept:
        found = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{k:02x}" for _, k in found), error if error < 1 << 63 else None))
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def coded(spark, rows, slices: int = 3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(slices)
    books = V.fit(df)
    found = V.encode(df, books, keep=["vec_id"])
    return sorted(((r.vec_id, r.vc_code, r.vc_error) for r in found.collect()), key=str), books.sha256()


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 20), st.sampled_from([1, 3, 50, 8000]), st.integers(1, 16))
def test_bounds_never_lose_the_nearest(seed, width, reach, entries):
    r = np.random.default_rng(seed)
    x, book = r.integers(-reach, reach + 1, (40, width)), r.integers(-reach, reach + 1, (entries, width))
    x[:entries] = book
    best, distance = V.Entries(book).nearest(x)
    exact = ((x[:, None] - book[None]) ** 2).sum(-1)
    assert best.tolist() == exact.argmin(1).tolist() and distance.tolist() == exact.min(1).tolist()


def test_bounds_leave_out_most_entries():
    r = np.random.default_rng(3)
    book = r.integers(-2000, 2000, (16, 8)) + np.arange(16)[:, None] * 9000
    x = book[r.integers(0, 16, 500)] + r.integers(-50, 50, (500, 8))
    length, mean, rest = V.segments(x, 1)
    _, m, q = V.segments(book, 1)
    bound = length * (mean - m.T) ** 2 + (rest - q.T) ** 2
    assert (bound <= ((x - book[bound.argmin(1)]) ** 2).sum(1)[:, None]).sum() < 1.2 * len(x)


@pytest.mark.parametrize("dimension", [16, 8, 21, 3])
def test_codes_by_definition(spark, dimension):
    r = random.Random(dimension)
    rows = [(i, [r.choice([r.gauss(0, 0.3), 0.125, -1.0]) for _ in range(dimension)], i % 3) for i in range(90)]
    rows += [(5, [0.5] * dimension, None), (5, [0.5] * dimension, None), (None, [0.25] * dimension, 1), (200, None, 1), (201, [None] * dimension, 1), (202, [float("nan")] * dimension, 2), (203, [float("-inf")] + [0.0] * (dimension - 1), 2)]
    assert coded(spark, rows) == brute(rows)


def test_few_rows_large_components_and_none(spark):
    rows = [(i, [float(i) * 10**k for k in range(16)], 0) for i in range(5)] + [(9, [1e300, -1e300] * 8, 0), (10, [1e8] * 16, 0)]
    assert coded(spark, rows) == brute(rows)
    none = [(1, None, 0), (2, [float("nan")] * 8, 0)]
    assert coded(spark, none)[0] == []
    assert coded(spark, [])[0] == []


def test_other_dimensions_and_labels(spark):
    rows = [(i, [0.01 * i] * 16, i % 2 if i % 5 else None) for i in range(40)] + [(50, [0.1] * 4, 7), (51, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_group", F.lit("x")).withColumn("VC_Code", F.lit(1)).withColumn("_rows", F.lit(2))
    books = V.fit(df)
    for share in (10_000, 2):
        found = V.with_group_errors(V.encode(df, books), "label", share).collect()
        assert len(found) == len(rows)
        sums = {}
        for r in found:
            sums[r.label] = sums.get(r.label, 0) + (r.vc_error or 0)
        assert all(r.vc_group_error == sums[r.label] for r in found if r.label != 7)
        assert {r.vec_id for r in found if r.vc_code is None} == {50, 51}


def test_decoded_is_near(spark):
    rows = [(i, [round(math.sin(i * k) / 3, 3) for k in range(16)], 0) for i in range(16)]
    df = spark.createDataFrame(rows, SCHEMA)
    books = V.fit(df, rounds=0)
    for r in V.encode(df, books).collect():
        assert r.vc_error == 0 and max(abs(a - b) for a, b in zip(books.decode(r.vc_code), r.embedding)) <= 1 / 4096


def test_sliced_batches():
    col = pa.array([[1.0, 2.0], None, [3.0, None], [4.0, 5.0], []], pa.list_(pa.float32()))
    kept, whole, x = V.finite(col.slice(1), 2)
    assert kept.tolist() == [2, 3] and whole.tolist() == [True, False] and x.tolist() == [[16384, 20480]]


def test_query_equals_sql(spark, sf):
    same(op13_vector_codes(spark, sf), duck(sf), OP13_SQL)
