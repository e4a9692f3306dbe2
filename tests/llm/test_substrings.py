from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import documents, prose

from driftwarden.llm import substrings as S
from driftwarden.llm.queries import op9_substrings


def pieces(text: str) -> list[str]:
    data = np.frombuffer(text.encode(), np.uint8)
    ends = S.chunk_ends(data, np.array([0, len(data)]))[0]
    return [data[a:b].tobytes().decode() for a, b in zip([0, *ends], ends, strict=False)]


@settings(max_examples=100, deadline=None)
@given(st.text("abä漢 ", max_size=600))
def test_chunks_cover_and_keep_their_bounds(text):
    got = pieces(text)
    assert "".join(got) == text
    assert all(len(x.encode()) <= S.MAX for x in got) and all(len(x.encode()) >= S.MIN for x in got[:-1])


def test_gear_equals_the_definition():
    data = np.frombuffer(prose(1, 60).encode(), np.uint8)
    h = S.gear(data)
    for i in range(20, len(data)):
        assert int(h[i]) == sum(int(S._GEAR[data[i - j]]) << j for j in range(16)) & 0xFFFF


def test_insertions_move_few_chunks():
    text = prose(1, 3000)
    a, b = set(pieces(text)), set(pieces(text[:5000] + "inserted words " + text[5000:]))
    assert len(a - b) <= 6


def test_planted_passages(spark):
    passage = prose(77, 60)
    texts = [f"{prose(i, 80)} {passage} {prose(100 + i, 80)}" for i in range(5)] + [prose(300 + i, 150) for i in range(10)]
    rows = {r.id: r for r in S.repeats(documents(spark, texts)).collect()}
    assert set(rows) == set(range(5))
    assert rows[0].sd_removed == [] and all(rows[i].sd_removed and rows[i].sd_first == [0] for i in range(1, 5))
    for i, r in rows.items():
        at = texts[i].index(passage)
        assert all(at <= s["start"] + 2 * S.MAX and s["end"] <= at + len(passage) + S.MAX for s in r.sd_repeated)
    cleaned = {r.doc_id: r.text for r in S.without_repeats(documents(spark, texts)).collect()}
    assert cleaned[0] == texts[0] and len(cleaned[1]) < len(texts[1]) - 100 and cleaned[9] == texts[9]


def test_planted_passages_of_short_words(spark):
    import random

    r = random.Random(3)
    short = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 3))) for _ in range(n))
    texts = []
    for _ in range(50):
        passage = short(51)
        texts += [f"{short(60)} {passage} {short(60)}" for _ in range(2)]
    found = {x.id for x in S.repeats(documents(spark, texts)).where("size(sd_shared) > 0").collect()}
    assert len(found) >= 85


def test_against_counting(spark):
    """Every repeated chunk by plain counting over all chunks."""
    texts = [prose(i % 7, 120) + prose(50 + i, 40 * (i % 3)) for i in range(30)]
    seen: dict[str, set[int]] = {}
    for i, t in enumerate(texts):
        for c in pieces(t):
            seen.setdefault(c, set()).add(i)
    rows = {r.id: r.sd_chunks for r in S.repeats(documents(spark, texts), min_run=1).collect()}
    for i, t in enumerate(texts):
        own = pieces(t)
        assert rows.get(i, 0) == sum(len(seen[c]) > 1 or own.count(c) > 1 for c in own)


def test_defined_cases(spark):
    same = prose(5, 100)
    rows = [(None, same), (1, same), (1, same), (2, same), (3, None), (4, ""), (5, "short"), (6, "short"), (7, same + same), (8, prose(9, 60_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS d1", "2 AS start")
    got = sorted(((str(r.id), len(same) if r.sd_removed and r.sd_removed[0]["start"] == 0 else 0) for r in S.repeats(docs).collect()))
    assert [x for x, _ in got] == ["1", "2", "7", "None"] and dict(got)["1"] == 0 and dict(got)["2"] and dict(got)["None"]
    assert S.repeats(docs.where("false")).count() == 0


def test_rows_that_share_an_id_keep_their_own_text(spark):
    p, q, u, v = prose(1, 100), prose(2, 100), prose(3, 100), prose(4, 100)
    rows = [(1, p), (5, p + " " + q), (5, u), (5, u), (None, v), (None, p + " " + v + " " + p), (None, q)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS sd_removed", "1 AS id")
    got = sorted((str(r.doc_id), r.text) for r in S.without_repeats(docs).collect())
    assert got == sorted((str(i), cleaned(i, t, rows)) for i, t in rows)
    assert {(x.id, x.sd_row is not None) for x in S.marked(docs).collect()} == {(i, True) for i, _ in rows}


def cleaned(own, text: str, rows: list[tuple], min_run: int = 40) -> str:
    """By definition: chunks go that the row had before, or that a document with a smaller id has."""
    first: dict[str, int] = {}
    for i, t in rows:
        for c in pieces(t):
            if i is not None:
                first[c] = min(first.get(c, i), i)
    seen, out, run = set(), [], []
    for c in [*pieces(text), None]:
        gone = c is not None and (c in seen or (c in first and (own is None or first[c] < own)))
        seen.add(c)
        if gone:
            run.append(c)
        else:
            out += run if sum(map(len, run)) < min_run else []
            out, run = [*out, c or ""], []
    return "".join(out)


def test_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op9_substrings(spark, sf).collect()}
    assert set(got) == set(docs) and all(got[i].n_chars == len(t) for i, t in docs.items()) and all(0 < r.removed_chars <= r.repeated_chars <= len(docs[i]) or r.removed_chars == 0 for i, r in got.items())
    copies: dict[str, list[int]] = {}
    for i, t in docs.items():
        copies.setdefault(t, []).append(i)
    for t, ids in copies.items():
        if len(ids) > 1 and len(t) > 200:
            assert set(ids) <= set(got) and all(got[i].removed_chars == len(t) for i in ids if i != min(ids))


def test_query_has_every_document(spark, tmp_path):
    paragraph = prose(11, 40)
    documents(spark, [" ".join([paragraph] * 20), prose(12, 200), None, prose(13, 200), f"{prose(14, 60)} {prose(13, 200)}"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op9_substrings(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(5))
    assert got[0].repeated_chars > 3000 and got[0].removed_chars > 3000 and got[0].shared_chars == 0 and got[0].shared_spans == ""
    assert got[3].shared_chars > 400 and got[3].removed_chars == 0 and got[4].removed_chars > 400 and got[4].first_doc_ids == [3]
    assert all((got[i].n_repeated_chunks, got[i].repeated_chars, got[i].removed_spans, got[i].first_doc_ids) == (0, 0, "", []) for i in (1, 2))


def test_columns_of_any_name_stay(spark):
    passage = prose(5, 60)
    names = ("_id", "_row", "_key", "_marks", "_KEY_", "mark_id", "id", "row", "sd_row")
    docs = documents(spark, [f"{prose(1, 50)} {passage} {prose(2, 50)}", f"{prose(3, 50)} {passage} {prose(4, 50)}"], extra={c: f"own {c}" for c in names})
    plain = {r.doc_id: r.text for r in S.without_repeats(docs.select("doc_id", "text")).collect()}
    found = S.without_repeats(docs)
    assert found.columns == docs.columns
    for r in found.collect():
        assert r.text == plain[r.doc_id] and all(r[c] == f"own {c}" for c in names)
