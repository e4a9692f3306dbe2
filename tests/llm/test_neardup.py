from __future__ import annotations

import random

import pytest
from tests.llm.helpers import documents, duck, prose, same
from pyspark.sql import functions as F

from driftwarden.llm import neardup
from driftwarden.llm.components import components
from driftwarden.llm.queries import OP7_SQL, op7_near_duplicates


def brute(texts: dict, size: int, percent: int = 80) -> dict:
    sets = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
    top = {k: k for k in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


def edited(r: random.Random, words: list[str], share: float) -> str:
    return " ".join(prose(r.randrange(10**9), 1) if r.random() < share else w for w in words)


def test_equals_sql(spark, sf):
    same(op7_near_duplicates(spark, sf), duck(sf), OP7_SQL)


@pytest.mark.parametrize("shares", [(0.0, 0.03), (0.02, 0.06)])
def test_large_groups_lose_no_link(spark, shares):
    """Families larger than a small bucket, with members on both sides of the similarity, against all pairs."""
    r = random.Random(sum(map(lambda x: int(x * 100), shares)))
    texts = []
    for family in range(3):
        words = prose(family, 150).split()
        texts += [edited(r, words, r.uniform(*shares)) for _ in range(60)]
        copy = edited(r, words, 0.05).split()  # copies of a copy share edits that the base lacks
        texts += [edited(r, copy, r.uniform(0, 0.05)) for _ in range(25)]
    texts += [prose(100 + i, 80) for i in range(20)]
    r.shuffle(texts)
    found = neardup.near_duplicates(documents(spark, texts), shingle=4).collect()
    want = brute(dict(enumerate(texts)), 4)
    assert {x.id: (x.nd_shingles, x.nd_component) for x in found} == want
    assert all(x.nd_kept == (x.id == x.nd_component) for x in found)


def test_defined_cases(spark):
    long = prose(5, 40_000)
    texts = [None, "", " \n\t", "one", "one", "ONE", "one two", "one two three four", long, long + " tail", None]
    docs = documents(spark, texts, extra={"n": 1, "id": 5, "keys": "x", "nd_kept": False})
    got = {x.id: (x.nd_shingles, x.nd_component, x.nd_kept) for x in neardup.near_duplicates(docs, shingle=4).collect()}
    assert got[0] == (0, 0, True) and got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[10] == (0, 10, True)
    assert got[3][1:] == (3, True) and got[4][1:] == (3, False) and got[5][1:] == (3, False)
    assert got[6] == (1, 6, True) and got[7] == (1, 7, True)
    assert got[8][1:] == (8, True) and got[9][1:] == (8, False)


def test_null_and_repeated_ids(spark):
    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(2, 50)), (None, prose(1, 50)), (3, prose(3, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.id, x.nd_component, x.nd_kept) for x in neardup.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True)], key=str)


def test_empty_table(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 20), (8, 7), (6, 6), *((100 + i, 101 + i) for i in range(40))], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got[20] == 3 and got[8] == 7 and 6 not in got and all(got[100 + i] == 100 for i in range(41))
    assert components(edges.where(F.lit(False))).count() == 0


def test_rows_grow_with_a_group(spark, monkeypatch):
    """Twice as many near copies of one text give about twice as many differences to join and no crowd of candidates."""

    def grown(members: int) -> dict:
        r = random.Random(9)
        words = prose(3, 120).split()
        texts = [edited(r, words, r.uniform(0.0, 0.07)) for _ in range(members)]
        seen = {}

        def noted(df, name="stage"):
            out = real(df, name)
            seen[name] = out.count() if name in ("differences", "more") else 0
            return out

        monkeypatch.setattr(neardup, "cut", noted)
        got = {x.id: x.nd_component for x in neardup.near_duplicates(documents(spark, texts), shingle=4).collect()}
        assert got == {k: v[1] for k, v in brute(dict(enumerate(texts)), 4).items()}
        return seen

    real = neardup.cut
    small, large = grown(150), grown(300)
    assert 0 < large["differences"] <= 2.75 * small["differences"]
    assert large["more"] <= 100
