from __future__ import annotations

import itertools
import re

from hypothesis import assume, given, settings
from hypothesis import strategies as st
from tests.llm.helpers import documents, prose

from driftwarden.llm import licenses as C
from driftwarden.llm.queries import op10_licenses

SCANNER = C.Scanner()


def brute(text: str) -> tuple[int, list[tuple[int, str]]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return len(words), sorted((i, label) for p, label in C.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["GNU", "General", "public", "license", "apache", "CC", "by", "MIT", ",", "ü", "cc-by", "x"]), max_size=20))
def test_base_equals_all_places(parts):
    text = " ".join(parts)
    n, base, _ = SCANNER.scan(text.encode())
    assert (n, sorted((b["word"], b["label"]) for b in base)) == brute(text)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(C.NOTICES)), st.lists(st.tuples(st.integers(0, 10**6), st.sampled_from("rid"), st.sampled_from("abcxyz")), max_size=4))
def test_edits_within_the_bound_are_found(notice, edits):
    edits = edits[: len(notice) // C.EDIT_EVERY]
    text = notice
    for at, kind, c in edits:
        at %= len(text)
        text = text[:at] + {"r": c, "i": c + text[at], "d": ""}[kind] + text[at + 1 :]
    assume(text == " ".join(text.split()))  # a space that goes with a word would be a further edit
    _, _, found = SCANNER.scan(f"before {text} after".encode())
    assert any(f["label"] == C.NOTICES[notice] for f in found)


def test_reports_words_and_edits():
    _, base, found = SCANNER.scan(b"This is Licenced under the Apache Licence, Version 2.0. foo")
    assert base == [] and [(f["label"], f["first"], f["last"], f["edits"]) for f in found] == [("apache", 2, 9, 2)]
    assert SCANNER.scan(prose(1, 2000).encode())[2] == []


def test_every_notice_of_several_close_ones():
    exact = "permission is hereby granted free of charge to any person obtaining a copy"
    forms = [(exact, 0), (exact.replace("hereby", "herby"), 1), (exact.replace("hereby", "herby").replace("charge", "charg"), 2)]
    for between in ("and", "or of", "then again"):
        for order in itertools.product(forms, repeat=3):
            _, _, found = SCANNER.scan(f" {between} ".join(t for t, _ in order).encode())
            step = 13 + len(between.split())
            assert [(f["first"], f["last"], f["edits"]) for f in found if f["label"] == "mit"] == [(k * step, k * step + 12, e) for k, (_, e) in enumerate(order)]


def test_a_piece_that_occurs_twice_cuts_no_window():
    scanner = C.Scanner({}, {"abcd efg hijk lmn abcd efg opqr stuv": "x"})
    _, _, found = scanner.scan(b"abxd efg hixk lmn abcd efg opqr stuv")
    assert [(f["first"], f["last"], f["edits"]) for f in found] == [(0, 7, 2)]


def test_defined_cases(spark):
    texts = [None, "", "MIT License", "mit license mit license", "word " * 100_000 + "cc by"]
    docs = documents(spark, texts, extra={"ls_words": 1, "label": "x", "word": 2})
    rows = {r.doc_id: r for r in C.scan(docs).collect()}
    assert [rows[i].ls_words for i in range(4)] == [0, 0, 2, 4] and len(rows[3].ls_base) == 2
    assert rows[4].ls_base[0]["word"] == 100_000 and rows[4].word == 2
    assert C.scan(docs.where("false")).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_licenses(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, base = brute(docs[r.doc_id])
        labels = sorted({x for _, x in base})
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(base), ",".join(labels))
        assert (r.first_word, r.last_word) == ((base[0][0], max(i for i, _ in base)) if base else (None, None))
        assert set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_many_notices_and_phrases_take_linear_time():
    import time

    def took(n: int) -> float:
        began = time.perf_counter()
        _, base, found = SCANNER.scan(b"released under the mit license. dedicated to the publick domain; " * n)
        assert len(base) == n and len(found) == 2 * n
        return time.perf_counter() - began

    took(10)
    small, large = took(1000), took(8000)
    assert large < max(16 * small, 2)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(sorted(C.NOTICES)), st.integers(0, 2), st.integers(0, 10**6)), min_size=1, max_size=5), st.sampled_from([" ", " and ", " of the same kind as ", "; "]))
def test_all_of_several_edited_notices(drawn, between):
    texts = []
    for notice, edits, seed in drawn:
        edits = min(edits, len(notice) // C.EDIT_EVERY)
        for e in range(edits):
            at = (seed * (e + 7)) % len(notice)
            notice_at = notice[at] if notice[at] == " " else "q"
            notice = notice[:at] + notice_at + notice[at + 1 :]
        texts.append(notice)
    _, _, found = SCANNER.scan(between.join(texts).encode())
    for label in set(C.NOTICES.values()):
        assert sum(f["label"] == label for f in found) >= sum(C.NOTICES[n] == label for n, _, _ in drawn)


def test_an_edit_is_a_character():
    """Accents are one edit each, whatever their bytes."""
    notice = "licensed under the gnu general public license"
    scanner = C.Scanner(notices={notice: "gpl"})
    edits = len(notice) // C.EDIT_EVERY
    assert edits >= 2
    text = notice.replace("general", "général")
    n, base, spans = scanner.scan(f"été {text} fin".encode())
    assert n == 9 and base == [] and [(s["label"], s["first"], s["last"], s["edits"]) for s in spans] == [("gpl", 1, 7, 2)]
