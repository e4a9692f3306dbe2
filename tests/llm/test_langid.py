from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tests.llm.helpers import documents

from driftwarden.llm import langid as L
from driftwarden.llm.common import held_out
from driftwarden.llm.queries import op5_language

WORDS = {"aa": {"banana": 4, "bandana": 2, "nab": 3, "ban": 1}, "bb": {"xylo": 3, "zyx": 2, "lox": 5}}


def kneser_ney(counts: dict[str, int], alphabet: int, order: int = L.ORDER):
    """The model by dictionaries, straight from the definition."""
    raw = [Counter() for _ in range(order + 1)]
    for w, n in counts.items():
        s = "^" + w + "$"
        for i in range(1, len(s)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    raw[k][s[i - k + 1 : i + 1]] += n
    use = [None] * (order + 1)
    use[order] = raw[order]
    for k in range(1, order):
        before = Counter(g[1:] for g in raw[k + 1])
        use[k] = {g: (n if g[0] == "^" or not before[g] else before[g]) for g, n in raw[k].items()}
    tables = []
    for k in range(1, order + 1):
        ones, twos = sum(n == 1 for n in use[k].values()), sum(n == 2 for n in use[k].values())
        d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
        total, kinds = defaultdict(float), Counter()
        for g, n in use[k].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        tables.append((d, use[k], total, kinds))

    def p(context: str, c: str) -> float:
        if len(context) >= order:
            context = context[-(order - 1) :]
        lower = 1 / alphabet
        for k in range(1, len(context) + 2):
            d, n, total, kinds = tables[k - 1]
            ctx = context[len(context) - k + 1 :]
            if ctx in total:
                lower = max(n.get(ctx + c, 0) - d, 0) / total[ctx] + d * kinds[ctx] / total[ctx] * lower
        return lower

    return p


def test_equals_the_definition():
    model = L.Model(WORDS)
    probe = ["banana", "ban", "xyz", "lol", "nab", "q", "banxylo"]
    costs, sizes = model.score_words(probe)
    for lang, column in zip(model.languages, range(2), strict=True):
        p = kneser_ney(WORDS[lang], model.alphabet)
        for w, got in zip(probe, costs[:, column], strict=True):
            s = "^" + w + "$"
            want = -sum(math.log2(p(s[:i], s[i])) for i in range(1, len(s)))
            assert abs(got - want) < 1e-3
    assert sizes.tolist() == [len(w) + 1 for w in probe]


def test_probabilities_sum_to_one():
    model = L.Model({"aa": WORDS["aa"]})
    p = kneser_ney(WORDS["aa"], model.alphabet)
    letters = set("".join(WORDS["aa"])) | {"$"}
    for context in ("^", "^ba", "^bana", "an"):
        assert abs(sum(p(context, c) for c in letters) + (model.alphabet - len(letters)) * p(context, "\0") - 1) < 1e-9


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    both = op5_language(spark, sf).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.max("score"), F.min("score")).first()
    assert both[0] > 0.97 and 0 <= both[2] <= both[1] <= 1


def test_defined_cases(spark):
    texts = [None, "", "12 $% ½ Ⅷ", "a", "banana " * 30_000, "Σίσυφος", "nab ban", "nab ban"]
    docs = documents(spark, ["banana nab ban"] * 20, first=100, lang="aa").union(documents(spark, ["xylo lox zyx"] * 20, first=200, lang="bb"))
    model = L.fit(docs, ~held_out())
    rows = {r.doc_id: r for r in L.identify(documents(spark, texts, extra={"li_lang": "old", "score": 1}), model).collect()}
    assert [rows[i].li_lang for i in range(3)] == ["und"] * 3 and all(rows[i].li_score == 0 and rows[i].li_rejected for i in range(3))
    assert rows[4].li_lang == "aa" and not rows[4].li_rejected and rows[6].li_lang == "aa" and rows[3].li_lang in ("aa", "bb")
    none = L.fit(documents(spark, ["a"], lang=None), ~held_out())
    assert [r.li_lang for r in L.identify(documents(spark, ["abc"]), none).collect()] == ["und"]
    assert L.identify(docs.where("false"), model).count() == 0
    assert L.fit(docs.where("false"), ~held_out()).languages == []


def test_every_language_is_learned(spark):
    names = [f"l{k:02}" for k in range(45)]
    words = {x: " ".join(chr(0x4E00 + 9 * k + j) + chr(0x4E00 + 9 * k + (j + 1) % 9) for j in range(9)) for k, x in enumerate(names)}
    rows = [(100 * k + i, words[x], x) for k, x in enumerate(names) for i in range(24 if k < 42 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, F.lit(True))
    assert model.languages == names and np.isfinite(model.limit).all()
    got = L.identify(docs, model)
    assert got.where("li_lang <> lang OR li_rejected").count() == 0


def test_wrong_labels_do_not_move_the_limit(spark):
    right = documents(spark, ["banana nab ban bandana " * 20] * 400, lang="aa").union(documents(spark, ["xylo lox zyx oxy " * 20] * 400, first=400, lang="bb"))
    few = F.col("doc_id").isin([r.doc_id for r in right.where("lang = 'aa'").where(F.pmod(L.rank_hash(6, "doc_id"), F.lit(4)) == 0).limit(2).collect()])
    wrong = right.withColumn("text", F.when(few, F.lit("xylo lox zyx oxy " * 20)).otherwise(F.col("text")))
    a, b = (L.fit(x, F.lit(True)).limit for x in (right, wrong))
    assert np.allclose(a, b, rtol=0.05)


def test_labels_are_no_inputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs, ~held_out())
    plain = {r.doc_id: (r.li_lang, r.li_score) for r in L.identify(docs, model).collect()}
    mixed = {r.doc_id: (r.li_lang, r.li_score) for r in L.identify(docs.withColumn("lang", F.lit("xx")), model).collect()}
    assert plain == mixed
    assert np.isfinite([s for _, s in plain.values()]).all()


def test_words_shorter_than_the_order_and_vowel_signs():
    model = L.Model({"en": {"a": 3, "bc": 2}})
    lang, score, entropy, _ = model.predict(["hello there", "a bc"])
    assert lang == ["en", "en"] and np.isfinite(entropy).all() and (score > 0).all()
    assert L.words_of("हिन्दी में x1y") == ["हिन्दी", "में", "x", "y"] and L.words_of("Ⅷ ½ 12") == []


def test_rows_that_share_id_and_text_stay_within_the_bound(spark):
    rows = [(None, "same text again", "xx")] * 400 + [(i, f"word{chr(97 + i % 26)} text", "xx") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = L.learned_rows(docs, "doc_id", "text", "lang", F.lit(True), 100, 5)
    assert chosen.where("text = 'same text again'").count() <= 1 and 10 <= chosen.count() <= 150
