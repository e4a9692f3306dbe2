from __future__ import annotations

import numpy as np
import pytest
from tests.llm.helpers import documents, duck, prose, same
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwarden.llm import decontaminate as D
from driftwarden.llm.queries import OP6_SQL, op6_decontaminate

BENCH = "item_id long, text string"


def test_equals_sql(spark, sf):
    same(op6_decontaminate(spark, sf), duck(sf), OP6_SQL)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=8), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=6))
def test_index_finds_every_occurrence(runs, patterns):
    text = np.array([x for run in runs for x in [*run, 0]], np.int64)
    width = max(map(len, patterns))
    filled = np.array([[0] * (width - len(p)) + p for p in patterns], np.int64)
    index = D.FMIndex(text, 4)
    low, high = index.search(filled, np.array([len(p) for p in patterns], np.int64))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_blocks_give_the_same(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = D.mark(docs, bench, keep=["doc_id"])
    many = D.mark(docs, bench, keep=["doc_id"], block_words=400)
    pick = lambda df: sorted((r.doc_id, r.dc_words, sum(x["end"] - x["start"] for x in r.dc_spans), tuple(r.dc_items)) for r in df.collect())
    assert pick(one) == pick(many)


def test_defined_cases(spark):
    passage = prose(1, 12)
    texts = [None, "", "!!!", passage, f"before {passage.upper()} after", "x " * 50_000 + passage, prose(2, 200)]
    bench = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "short item"), (None, passage)], BENCH)
    docs = documents(spark, [*texts, "a Short, ITEM!"], extra={"dc_words": 7, "start": 1})
    got = {r.doc_id: r for r in D.mark(docs, bench).collect()}
    assert [got[i].dc_words for i in range(3)] == [0, 0, 0] and got[1].start == 1
    assert [(s["start"], s["end"]) for s in got[3].dc_spans] == [(0, 12)] and got[3].dc_items == ["1"]
    assert [(s["start"], s["end"]) for s in got[4].dc_spans] == [(1, 13)]
    assert [(s["start"], s["end"]) for s in got[5].dc_spans] == [(50_000, 50_012)]
    assert got[6].dc_spans == [] and got[7].dc_items == ["4"]


def test_removal_keeps_the_rest(spark):
    passage = prose(1, 12)
    bench = spark.createDataFrame([(1, passage)], BENCH)
    texts = [f"vorher ü {passage} — nachher", "clean", None, passage]
    got = {r.doc_id: r.text for r in D.remove(documents(spark, texts), bench).collect()}
    assert got == {0: "vorher ü  — nachher", 1: "clean", 2: None, 3: ""}


@pytest.mark.parametrize("empty", ["docs", "bench", "both"])
def test_empty_tables(spark, empty):
    docs = documents(spark, [] if empty != "bench" else ["a b c"])
    bench = spark.createDataFrame([] if empty != "docs" else [(1, "a b")], BENCH)
    rows = D.mark(docs, bench).collect()
    assert len(rows) == (empty == "bench") and all(r.dc_words == 3 and not r.dc_spans for r in rows)


def test_few_blocks_are_alive_at_once(spark, monkeypatch):
    import weakref

    held, most = [], []
    real = D.Windows.__init__

    def made(self, items, window):
        real(self, items, window)
        held.append(weakref.ref(self))
        most.append(sum(r() is not None for r in held))

    monkeypatch.setattr(D.Windows, "__init__", made)
    items = [prose(i, 30) for i in range(12)]
    benchmark = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string")
    docs = documents(spark, [f"{prose(50 + i, 20)} {t} {prose(90 + i, 20)}" for i, t in enumerate(items)])
    rows = {r.doc_id: r.dc_items for r in D.mark(docs, benchmark, block_words=60).collect()}
    assert rows == {i: [str(i)] for i in range(12)}
    assert len(held) >= 6 and max(most) <= D.STAGE_BLOCKS + 1
