from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.helpers import documents, prose

from driftwarden.llm import quality as Q
from driftwarden.llm.common import strings, utf8
from driftwarden.llm.queries import op12_quality


def of(texts: list[str]):
    return Q.tokens(*utf8(strings(pa.array(texts))))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab AB#1.\né", max_size=30), max_size=6))
def test_tokens_row_by_row(texts):
    cell, row = of(texts)
    assert (np.diff(row) >= 0).all()
    for k, t in enumerate(texts):
        assert cell[row == k].tolist() == of([t])[0].tolist()


def test_what_a_token_is():
    same = lambda a, b: of([a])[0].tolist() == of([b])[0].tolist()
    assert same("House of cards", "house Of Cards")
    assert not same("HOUSE", "house")
    assert same("12 99", "34 56") and not same("12", "123")
    assert len(of(["one two"])[0]) == 2 and len(of(["one  two!"])[0]) == 4
    assert len(of(["", "###"])[0]) == 1


def test_word_vectors_by_definition(spark):
    texts = ["red green blue red", "blue green", "", None, "green, red"]
    got = Q.word_vectors(documents(spark, texts).repartition(3), "text", 8)
    plus, minus = Q.index_vectors(8)
    sums: dict[int, Counter] = {}
    for t in texts:
        cells = of([t or ""])[0].tolist()
        for i, a in enumerate(cells):
            for j in range(max(0, i - Q.WINDOW), min(len(cells), i + Q.WINDOW + 1)):
                if i != j:
                    own = sums.setdefault(a, Counter())
                    own[int(plus[cells[j]])] += 1
                    own[int(minus[cells[j]])] -= 1
    want = np.zeros((Q.CELLS, 8))
    for a, own in sums.items():
        for k, v in own.items():
            want[a, k] = np.sign(v) * np.log1p(abs(v))
    want /= np.maximum(np.sqrt((want**2).sum(1, keepdims=True)), 1e-9)
    assert abs(got - want).max() < 1e-6


def test_pooling_in_steps(monkeypatch):
    vectors = np.random.default_rng(1).normal(size=(Q.CELLS, 4)).astype(np.float32)
    data = utf8(strings(pa.array(["a b c d e f", "", "g h", "x " * 50])))
    whole = Q.pooled(vectors, *data)
    monkeypatch.setattr(Q, "AT_ONCE", 3)
    assert np.allclose(Q.pooled(vectors, *data), whole, atol=1e-5)
    assert (whole[1] == 0).all()


def corpus(n: int = 500):
    r = random.Random(7)
    texts, labels = [], []
    for i in range(n):
        words = prose(i, 80).split()
        good = i % 3 != 0
        texts.append(" ".join(words) + "." if good else " ".join(w + r.choice(["###", "$$", "!!"]) for w in words))
        labels.append((i, int(good)))
    return texts, labels


def test_held_out_and_calibrated(spark):
    texts, labels = corpus()
    docs = documents(spark, texts)
    model = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    found = {r.doc_id: r.ql_score for r in Q.score(docs, model).where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()}
    y = np.array([labels[i][1] for i in found])
    p = np.array(list(found.values()))
    assert ((p >= 0.5) == y).mean() > 0.97
    assert abs(p.mean() - y.mean()) < 0.05


def test_temperature_lowers_the_loss_of_rows_kept_out():
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 20))
    y = (x[:, 0] + r.normal(size=600) > 0).astype(float)
    net = Q.trained(x, y, np.arange(600) % 5 == 0, epochs=30)
    apart = np.arange(600) % 5 == 0
    z = net.logits(x[apart])
    assert Q.loss(z / net.temperature, y[apart]) <= Q.loss(z, y[apart]) + 1e-9


def test_edges(spark):
    texts, labels = corpus(60)
    docs = documents(spark, [*texts, None, "", "##" * 40_000, texts[0]], extra={"QL_score": 9, "cell": 1, "id": 2, "y": 3, "x": 4})
    docs = docs.unionByName(docs.where("doc_id = 3"))
    rows = spark.createDataFrame([*labels, (3, 1), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    found = Q.score(docs, Q.fit(docs, rows, F.lit(True))).collect()
    assert len(found) == 65 and all(0 <= r.ql_score <= 1 for r in found)
    assert len({r.ql_score for r in found if r.doc_id in (60, 61)}) == 1
    empty = docs.limit(0)
    assert Q.score(empty, Q.fit(empty, rows, F.lit(True))).count() == 0
    none = Q.score(docs, Q.fit(docs, rows.limit(0), F.lit(True))).collect()
    assert {r.ql_score for r in none} == {0.5}
    one = Q.fit(docs, rows.where("quality = 1"), F.lit(True))
    assert min(r.ql_score for r in Q.score(docs, one).collect()) > 0.9
    few = Q.fit(docs, rows, F.lit(True), sample_rows=5)
    assert Q.score(docs, few).count() == 65


def test_query(spark, sf):
    found = op12_quality(spark, sf).collect()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(found) == n and all(r.predicted == (r.score >= 0.5) for r in found)
