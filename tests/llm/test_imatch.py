from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from tests.llm.helpers import documents, prose

from driftwarden.llm import imatch as I
from driftwarden.llm.common import hash_word
from driftwarden.llm.queries import op3_fingerprints


def test_document_frequencies(spark):
    texts = ["a b a", "B c", None, "", "c-c d"]
    counts, n = I.document_frequencies(documents(spark, texts).repartition(3))
    assert n == 5
    want = {"a": 1, "b": 2, "c": 2, "d": 1}
    assert {w: int(counts[int(I.cells(np.array([hash_word(w.encode())], np.uint64))[0])]) for w in want} == want


def test_lexicon_of_all_documents(spark):
    docs = documents(spark, [prose(i % 7, 60) for i in range(40)]).repartition(3)
    want = I.beyond_band(*I.document_frequencies(docs), 0.1, 0.3)
    assert (I.fit(docs, "text", 0.1, 0.3, 8).beyond == want).all() and 0 < (want == 0).sum() < len(want)


def definition(texts: list[str], low: float, high: float, few: int) -> list[tuple[set, str]]:
    """Kept terms of each text by the definition, and the hash of them all, one term at a time."""
    sets = [set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))) for t in texts]
    cell = lambda w: int(I.cells(np.array([hash_word(w.encode())], np.uint64))[0])
    count = {}
    for s in sets:
        for c in {cell(w) for w in s}:
            count[c] = count.get(c, 0) + 1
    out = []
    for s in sets:
        far = {w: int(I.beyond_band(np.array([count[cell(w)]]), len(texts), low, high)[0]) for w in s}
        kept = [w for w in s if far[w] == 0]
        if len(kept) < few:
            kept = sorted(s, key=lambda w: (far[w], hash_word(w.encode())))[:few]
        total = np.zeros(1, np.uint64)
        for w in kept:
            total += I.mix64(np.array([hash_word(w.encode())], np.uint64) + np.uint64(0xA0761D6478BD642F))
        out.append((set(kept), f"{int(I.mix64(total)[0]):016x}" if kept else "0" * 16))
    return out


def test_fingerprints_by_definition(spark):
    texts = [prose(i % 9, 30 + i) + " " + prose(100 + i, 5) for i in range(40)] + ["", "one two", "One, TWO!"]
    rows = {r.id: r for r in I.fingerprint(documents(spark, texts), low=0.05, high=0.3).collect()}
    want = definition(texts, 0.05, 0.3, 8)
    assert [rows[i].fingerprint.split("-")[0] for i in range(len(texts))] == [h for _, h in want]
    for i in range(len(texts) - 1):  # likeness estimates the share of common terms
        a, b = want[i][0], want[i + 1][0]
        share = len(a & b) / max(len(a | b), 1)
        assert abs(rows[i].near_next - share) < 0.45 and (rows[i].near_next == 1.0) == (a == b and bool(a))


@pytest.mark.parametrize("range_rows", [2, 8000])
def test_edited_text_and_equal_texts(spark, range_rows):
    texts = [None, "", "ä", "same words here again", "same words here again", prose(1, 3000), prose(2, 5), "漢字 and more"]
    docs = documents(spark, texts, first=3, extra={"id": 1, "key": 2, "part": 3})
    rows = {r.id: r for r in I.fingerprint(docs, range_rows=range_rows).collect()}
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = rows[i + 3]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[6].fingerprint == rows[7].fingerprint and rows[6].near_next == 1.0
    assert rows[3].fingerprint == rows[4].fingerprint


def test_likeness_follows_shared_terms(spark):
    base = prose(1, 400).split()
    texts = [" ".join(base[: 400 - k] + prose(50 + k, k).split()) for k in (0, 20, 100, 200, 400)]
    lexicon = I.Lexicon(I.beyond_band(np.zeros(1 << I.WIDTH), 1, 0.001, 0.1), 8)
    whole, parts = lexicon.fingerprints([t.encode() for t in texts])
    near = [float(I.likeness((whole[:1], parts[:1]), (whole[k : k + 1], parts[k : k + 1]))[0]) for k in range(5)]
    assert near[0] == 1 and near[1] > 0.6 and near[1] > near[3] > near[4] and near[4] < 0.2


def test_ties_nulls_and_empty(spark):
    rows = [(None, "n"), (1, "b"), (1, "a"), (1, "a"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = I.fingerprint(docs).collect()
    tie = {r.text: r.tie for r in docs.selectExpr("text", "xxhash64(text) AS tie").collect()}
    order = [(None, "n"), *sorted([(1, "a"), (1, "a"), (1, "b")], key=lambda x: tie[x[1]]), (2, "")]
    want = sorted((str(i), hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % 5][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((str(r.id), r.edited_sha256) for r in got) == want
    assert I.fingerprint(docs.where("false")).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_fingerprints(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    by_text = {}
    for r in rows:
        by_text.setdefault(docs[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and all(re.fullmatch("[0-9a-f-]+", r.fingerprint) for r in rows)
    assert sum(r.near_edited for r in rows) > sum(r.near_next for r in rows)


def test_an_id_that_most_rows_share_is_split(spark):
    texts = [prose(i, 20) for i in range(120)]
    rows = [(7 if i % 3 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {r.text: r.tie for r in docs.selectExpr("text", "xxhash64(text) AS tie").collect()}
    order = sorted(rows, key=lambda x: (x[0], tie[x[1]]))
    want = sorted((i, hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert sorted((r.id, r.edited_sha256) for r in I.fingerprint(docs, range_rows=10).collect()) == want
    sizes = [r["count"] for r in I.in_order(docs, "doc_id", "text", 10, 50).where("halo = 0").groupBy("part").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 25


def test_texts_about_the_least_number_of_terms_stay_alike():
    frequencies = np.zeros(1 << I.WIDTH)
    inside = [w.encode() for w in prose(5, 60).split()]
    inside = list(dict.fromkeys(inside))[:9]
    others = list(dict.fromkeys(w.encode() for w in prose(6, 60).split()))[:40]
    for w in inside:
        frequencies[I.cells(np.array([hash_word(w)], np.uint64))] = 50
    for w in others:
        frequencies[I.cells(np.array([hash_word(w)], np.uint64))] = 900
    lexicon = I.Lexicon(I.beyond_band(frequencies, 1000, 0.001, 0.1), 8)
    whole, parts = lexicon.fingerprints([b" ".join(inside[:n] + others) for n in (7, 8, 9)])
    near = I.likeness((whole[[0, 1]], parts[[0, 1]]), (whole[[1, 2]], parts[[1, 2]]))
    assert near.min() > 0.5
