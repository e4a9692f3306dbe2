from __future__ import annotations

import re

import pytest
from tests.llm.helpers import documents, prose

import corpus_pipeline as C
from driftwarden.llm import pii as P


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    passage = prose(1, 14)
    near = prose(2, 300).split()
    texts = {
        0: "12 34 !!",
        1: None,
        2: " ".join(near),
        3: " ".join([*near[:150], "changed", *near[151:]]),
        4: " ".join(near),
        5: f"{prose(3, 120)} {passage} {prose(4, 120)}",
        6: f"{prose(5, 80)} mail a.b@c.de now",
        7: prose(6, 100),
    }
    root = tmp_path_factory.mktemp("planted")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs = documents(spark, [texts[i] for i in range(8)]).union(documents(spark, [prose(i, 100) for i in range(100, 130)], first=100))
    docs.write.parquet(f"{root}/documents.parquet")
    return str(root), texts, passage


def test_stages(spark, planted):
    root, texts, passage = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, root)
        rows = docs.collect()
        results[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
        if name != "pack":
            assert docs.columns == columns and all(r.n_chars == len(r.text) for r in rows)
    text = {name: {r.doc_id: r.text for r in rows} for name, rows in results.items() if name != "pack"}
    assert {0, 1}.isdisjoint(text["language"]) and len(text["language"]) == 36
    assert {3, 4}.isdisjoint(text["near_duplicates"]) and {2, 5, 6, 7} <= set(text["near_duplicates"]) and len(text["near_duplicates"]) == 34
    assert passage not in text["decontaminate"][5] and text["decontaminate"][5].startswith(prose(3, 120)) and text["decontaminate"][7] == texts[7]
    assert text["pii"][6].endswith("mail [EMAIL] now")
    assert not any(re.search("@", t) for t in text["pii"].values())
    assert {r.doc_id for r in results["pack"]} == set(text["pii"])
    ends = {}
    for r in results["pack"]:
        ends[r.doc_id] = ends.get(r.doc_id, 0) + r.length
    assert all(ends[r.doc_id] == r.doc_tokens for r in results["pack"])


def test_run_equals_the_stages(spark, planted):
    root, _, _ = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, root)
    key = lambda r: tuple(r[c] for c in sorted(r.asDict()))
    assert sorted(map(key, docs.collect())) == sorted(map(key, C.run(spark, root).collect()))


def test_extra_columns_and_empty_table(spark, planted):
    root, _, _ = planted
    docs = spark.read.parquet(f"{root}/documents.parquet").selectExpr("*", "1 AS id", "'k' AS kind", "2 AS LI_Lang", "3 AS tokens", "4 AS _aside_1", "5 AS pii_spans", "6 AS li_score", "7 AS dc_spans")
    for name, stage in C.STAGES:
        docs = stage(spark, docs, root)
        if name != "pack":
            rows = [tuple(r[c] for c in docs.columns if c not in C.OWN) for r in docs.collect()]
            assert set(rows) == {(1, "k", 2, 3, 4, 5, 6, 7)}
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    docs = spark.read.parquet(f"{root}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, root)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_finder_is_bounded(spark):
    """The sample ends at its limit whatever the table holds."""
    docs = spark.range(600).selectExpr("CAST(id % 3 AS LONG) AS doc_id", "concat('call 0', id, ' 1234 5678 and 2', id, '-555-0101') AS text")
    seen = []
    made = P.Finder.__init__

    def noted(self, texts, precision=0.97, seed=13):
        seen.append(len(texts))
        made(self, texts, precision, seed)

    P.Finder.__init__ = noted
    try:
        P.fit(docs, sample_rows=100)
    finally:
        P.Finder.__init__ = made
    assert seen and seen[0] <= 100
