from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.helpers import documents, prose

from driftwarden.llm import toxicity as X
from driftwarden.llm.common import held_out
from driftwarden.llm.queries import op2_toxicity


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=3, max_size=7), min_size=1, max_size=6, unique=True), st.text("abc", min_size=1, max_size=9))
def test_automaton_equals_edit_distance(words, word):
    automaton = X.Automaton({w: i for i, w in enumerate(words)}, {})
    best = min(((d, i) for i, w in enumerate(words) if (d := distance(w, word)) <= (1 if len(w) >= X.FUZZY_LENGTH else 0)), default=None)
    assert automaton.match(word) == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=2, max_size=4), min_size=1, max_size=4, unique=True), st.text("ab", min_size=1, max_size=8))
def test_stems_match_exactly(stems, word):
    found = X.Automaton({}, {s: i for i, s in enumerate(stems)}).match(word)
    assert (found is not None) == any(word.startswith(s) for s in stems)


def corpus(spark):
    r = random.Random(4)
    bad = ["glumpfix", "drabtor", "snorvil"]
    texts, labels = [], []
    for i in range(400):
        words = prose(i, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    return texts, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_misspelt_and_quoted(spark):
    texts, labels = corpus(spark)
    docs = documents(spark, texts)
    model = X.fit(docs, labels, ~held_out())
    assert {"glumpfix", "drabtor", "snorvil"} <= {w for w in ("glumpfix", "drabtor", "snorvil") if model.matcher.look_up({w})}
    plain = prose(9999, 60)
    tests = [plain, f"{plain} glumpfix drabtor you", f"{plain} glumpfx drabbtor you", f'{plain} they said "glumpfix" {plain}']
    s, matches = model.score(tests)
    assert s[0] < 0.5 < s[1] and s[2] > s[0] and [m["edits"] for m in matches[2]] == [1, 1]
    assert matches[3][0]["context"] < 0 < matches[1][0]["context"]


def test_held_out_rows_do_not_matter(spark):
    texts, labels = corpus(spark)
    docs = documents(spark, texts)
    out = {r.doc_id for r in docs.where(held_out()).select("doc_id").collect()}
    flipped = labels.rdd.map(lambda r: (r.doc_id, 1 - r.toxic if r.doc_id in out else r.toxic)).toDF("doc_id long, toxic int")
    one, two = X.fit(docs, labels, ~held_out()), X.fit(docs, flipped, ~held_out())
    assert one.weights.tolist() == two.weights.tolist() and one.intercept == two.intercept


def test_defined_cases(spark):
    labels = spark.createDataFrame([(0, None), (1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    docs = documents(spark, [None, "", "a b c", "word " * 100_000], extra={"toxic": 3, "tx_score": 9.0})
    for model in (X.fit(docs, labels, ~held_out()), X.fit(docs, labels.where("false"), ~held_out())):
        rows = X.score(docs, model).collect()
        assert len(rows) == 4 and all(0 <= r.tx_score <= 1 and r.toxic == 3 for r in rows)
    assert X.score(docs.where("false"), model).count() == 0


def test_query(spark, sf):
    rows = op2_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_quality(spark):
    """Documents that the fit does not see, some with misspelled terms, are told apart."""
    import random

    import numpy as np

    r = random.Random(8)
    bad = ["zadrofel", "mirtupian", "golvester", "prundaket", "skamborin"]

    def wrong(w: str) -> str:
        at = r.randrange(1, len(w))
        return r.choice([w[:at] + w[at + 1 :], w[:at] + "q" + w[at + 1 :], w[:at] + "x" + w[at:]])

    texts, labels, misspelled = [], [], set()
    for i in range(900):
        toxic = i % 5 == 2
        words = prose(i, 60).split()
        if toxic:
            own = r.choice(bad)
            if i % 3 == 0:
                own = wrong(own)
                misspelled.add(i)
            words[r.randrange(60)] = own
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs = documents(spark, texts)
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), ~held_out())
    rows = X.score(docs, model).where(held_out()).collect()
    s, y = np.array([x.tx_score for x in rows]), np.array([x.doc_id % 5 == 2 for x in rows])
    assert np.mean([(p > s[~y]).mean() + 0.5 * (p == s[~y]).mean() for p in s[y]]) > 0.95
    found = [x for x in rows if x.doc_id in misspelled]
    assert found and np.mean([any(m["edits"] for m in x.tx_matches) for x in found]) > 0.8


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.range(400).selectExpr("CAST(id % 4 AS LONG) AS doc_id", "concat('text ', id % 200) AS text")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int")
    assert X.learned(docs, labels, F.lit(True), "doc_id", "text", 10, 2).count() == 10
    assert X.learned(docs, labels, F.lit(True), "doc_id", "text", 1000, 2).count() == 200


def test_stems_by_definition(spark):
    texts, labels = corpus(spark)
    found = X.lexicon(X.learned(documents(spark, texts), labels, F.lit(True), "doc_id", "text", 20_000, 2), 5)
    stems = {t for t, stem, _ in found if stem}
    assert not any(a != b and a.startswith(b) for a in stems for b in stems)
