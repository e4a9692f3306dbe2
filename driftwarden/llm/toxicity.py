"""Toxicity: Levenshtein automata over a lexicon trie, and scores of the context windows around their matches.

The lexicon is learned: words, and stems (leading characters of a word), whose share of toxic documents among
labelled ones stands out. Its trie is run together with the Levenshtein automaton of one edit: a state is the set of
(trie node, edits so far), found when first needed and remembered, so a word costs one look-up a character.
Words of at least ``FUZZY_LENGTH`` letters match within one edit (a letter more, less or another; two letters that
changed places are two edits), shorter ones and stems exactly. A word under a stem stays in the automaton for its misspellings.

Every match is weighed by its window of ``WINDOW`` words to both sides: quotation marks and reporting words
speak for quotation, second-person words and further matches for abuse. A logistic model over the document's
counts of both turns them into a score from 0 to 1.

Lexicon and model are fitted on at most ``sample_rows`` labelled rows (the smallest seeded hashes of the id) for
which ``learn`` is true; labels, languages, sources and ids are no inputs of a score.

Defined cases: null and empty texts have no match and the score of a text without any; without labels the
lexicon is empty and all scores are the same; ``tx_*`` columns that the documents already have are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.llm.common import cut, prepare, rank_hash, slices, strings

WINDOW = 8
FUZZY_LENGTH = 5
STEMS = range(5, 9)
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W_]+")

# Words that report speech, and words that address somebody, in the tables' four languages.
REPORTING = frozenset("said says wrote quote quoted called sagte sagt schrieb zitat dit disait citation dijo dice cita".split())
ADDRESSING = frozenset("you your youre du dich dein euch tu te toi vous tú ti usted vosotros".split())
QUOTES = frozenset("\"'«»„“”‘’")


class Automaton:
    """Lexicon trie times Levenshtein automaton of at most one edit, determinised as it is used.

    Transitions of a set of (node, edits): keep a letter (no edit), replace or insert one, or skip letters of the
    lexicon (one edit). ``match`` gives the best (edits, entry) or None.
    """

    def __init__(self, words: dict[str, int], stems: dict[str, int]):
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.fuzzy: set[int] = set()  # nodes on the way to a word that may be misspelled
        self.loose_end: set[int] = set()
        for entries, ends, loose in ((words, self.word_at, True), (stems, self.stem_at, False)):
            for text, number in entries.items():
                node, path = 0, [0]
                for c in text:
                    node = self.children[node].setdefault(c, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                    path.append(node)
                ends[node] = number
                if loose and len(text) >= FUZZY_LENGTH:
                    self.fuzzy.update(path)
                    self.loose_end.add(node)
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stem_of: list[int | None] = []
        self.begin = self._state(frozenset({(0, 0)}))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"steps": [{} for _ in self.steps]}

    def _state(self, items: frozenset) -> int:
        """Number of the state with all its skips of lexicon letters."""
        full = set(items)
        for node, edits in items:
            if edits == 0 and node in self.fuzzy:
                full.update((child, 1) for child in self.children[node].values() if child in self.fuzzy)
        full = frozenset(x for x in full if x[1] == 0 or (x[0], 0) not in full)
        if full not in self.ids:
            self.ids[full] = len(self.states)
            self.states.append(full)
            self.steps.append({})
            ends = [(e, self.word_at[n]) for n, e in full if n in self.word_at and (e == 0 or n in self.loose_end)]
            self.accepts.append(min(ends, default=None))
            self.stem_of.append(next((self.stem_at[n] for n, e in full if e == 0 and n in self.stem_at), None))
        return self.ids[full]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.states[state]:
            if (child := self.children[node].get(c)) is not None and (edits == 0 or child in self.fuzzy):
                out.add((child, edits))
            if edits == 0 and node in self.fuzzy:
                out.add((node, 1))
                out.update((child, 1) for child in self.children[node].values() if child in self.fuzzy)
        self.steps[state][c] = to = self._state(frozenset(out)) if out else -1
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        state, stem = self.begin, None
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return (0, stem) if stem is not None else None
            if self.stem_of[state] is not None:
                stem = self.stem_of[state]
        return (0, stem) if stem is not None else self.accepts[state]


class Matcher:
    """Words to matches; it remembers words, so keep one a process."""

    def __init__(self, entries: list[tuple[str, bool, float]], spared: frozenset[str]):
        """``entries``: text, whether a stem, weight. ``spared``: misspellings that clean documents hold."""
        self.weight = np.array([w for _, _, w in entries])
        self.spared = spared
        self.automaton = Automaton({t: k for k, (t, stem, _) in enumerate(entries) if not stem}, {t: k for k, (t, stem, _) in enumerate(entries) if stem})
        self.known: dict[str, tuple[int, int] | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def look_up(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """Those of ``words`` that match, with edits and entry."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, words
        match = self.automaton.match
        for w in new:
            m = match(w)
            self.known[w] = None if m and m[0] and w in self.spared else m
        return {w: m for w in words if (m := self.known[w])}


def describe(text: str, matcher: Matcher) -> tuple[np.ndarray, list[dict]]:
    """Features of a document and its matches with the score of their windows (above 0: abuse)."""
    low = text.lower()
    found = matcher.look_up(set(_WORD.findall(low)))
    if not found:
        return np.zeros(FEATURES), []
    places = list(_WORD.finditer(low))
    words = [m[0] for m in places]
    at = [i for i, w in enumerate(words) if w in found]
    hits, matches, seen = set(at), [], set()
    exact = near = quoted = abuse = best = 0.0
    for i in at:
        edits, entry = found[words[i]]
        window = range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1))
        start, end = places[window[0]].start(), places[window[-1]].end()
        marks = any(c in QUOTES for c in low[start : places[i].start()]) and any(c in QUOTES for c in low[places[i].end() : end + 1])
        said = sum(words[j] in REPORTING for j in window)
        you = sum(words[j] in ADDRESSING for j in window)
        more = sum(j in hits for j in window) - 1
        context = 1.0 + 0.5 * min(you, 2) + 0.5 * min(more, 3) - 1.5 * marks - 0.75 * min(said, 2)
        weight = float(matcher.weight[entry])
        exact += (edits == 0) * weight
        near += (edits > 0) * weight
        quoted += context <= 0
        abuse += max(context, 0) * weight
        best = max(best, weight * (1 if edits == 0 else 0.5))
        seen.add(entry)
        matches.append({"word": words[i], "at": i, "edits": edits, "context": context})
    n = len(words)
    return np.array([1.0, best, np.log1p(exact), np.log1p(near), np.log1p(abuse), quoted / len(at), np.log1p(len(seen)), 100 * len(at) / (n + 50)]), matches


FEATURES = 8


def candidates(text: str) -> tuple[set[str], set[str]]:
    words = set(_WORD.findall(text.lower()))
    return words, {w[:k] for w in words for k in STEMS if len(w) > k}


def learned(docs: DataFrame, labels: DataFrame, learn: Column, id: str, text: str, sample_rows: int, seed: int) -> DataFrame:
    """(text, toxic) of the labelled rows that the fit uses, at most ``sample_rows`` different ones; what is broadcast are their ids and hashes."""
    usable = labels.where(learn & F.col("toxic").isNotNull()).groupBy(id).agg(F.max("toxic").alias("toxic"))
    some = usable.orderBy(rank_hash(seed, id), id).limit(sample_rows)
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    kinds = rows.select("id", "hash").join(F.broadcast(some.withColumnRenamed(id, "id")), "id").distinct()
    chosen = kinds.orderBy(rank_hash(seed, "id"), "id", "hash").limit(sample_rows)
    # Rows that are equal in both count once.
    found = rows.join(F.broadcast(chosen), ["id", "hash"]).dropDuplicates(["id", "hash"])
    return cut(found.select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")


def lexicon(rows: DataFrame, least: int) -> list[tuple[str, bool, float]]:
    """Words and stems by how much likelier they make a toxic document; each a (text, stem, log odds)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {(stem, toxic): Counter() for stem in (False, True) for toxic in (0, 1)}
        for b in batches:
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                for stem, terms in enumerate(candidates(text)):
                    counts[bool(stem), int(toxic > 0)].update(terms)
        for stem in (False, True):  # a term that no toxic row here has only matters where one elsewhere has it
            both = counts[stem, 0] + counts[stem, 1]
            terms = list(both)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([stem] * len(terms), pa.bool_()), pa.array([counts[stem, 1][t] for t in terms], pa.int64()), pa.array([counts[stem, 0][t] for t in terms], pa.int64())], ["term", "stem", "bad", "good"])

    total = {r.toxic: r["count"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return []
    sums = rows.mapInArrow(count, "term string, stem boolean, bad long, good long").groupBy("term", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1)))
    # Half of the term's documents at least have to be toxic, and more than chance gives.
    chosen = sums.where((F.col("bad") >= least) & (F.col("bad") >= 2 * F.col("good"))).withColumn("odds", odds)
    # Their number is bounded by the sample: each is in at least ``least`` of its toxic rows.
    top = chosen.orderBy(F.desc(F.col("odds") * F.log(F.col("bad") + 1)), "term", "stem").collect()
    words = {r.term for r in top if not r.stem}
    stems = [r.term for r in top if r.stem]
    bad_of = {(r.term, r.stem): r.bad for r in top}
    # A stem that only one chosen word has is that word.
    under: dict[str, list[str]] = {}
    for w in words:
        for k in STEMS:
            if len(w) >= k:
                under.setdefault(w[:k], []).append(w)
    kept_stems = {s for s in stems if len(under.get(s, ())) != 1 or bad_of[s, True] > 1.5 * bad_of[under[s][0], False]}
    shortest = {s for s in kept_stems if not any(s[:k] in kept_stems and bad_of[s[:k], True] >= bad_of[s, True] for k in STEMS if k < len(s))}
    return [(r.term, r.stem, float(r.odds)) for r in top if not r.stem or r.term in shortest]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps with a ridge penalty; classes weigh as they occur."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + ridge + 1e-9 * np.eye(len(w)), a.T @ (p - y) / len(a) + ridge @ w)
        w = w - step
        if abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, matcher: Matcher, weights: np.ndarray, intercept: float):
        self.matcher, self.weights, self.intercept = matcher, weights, intercept

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
        described = [describe(t, self.matcher) for t in texts]
        z = np.array([x for x, _ in described]).reshape(-1, FEATURES) @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), [m for _, m in described]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", sample_rows: int = 20_000, least: int = 5, seed: int = 2) -> Model:
    prepare(docs.sparkSession)
    rows = learned(docs, labels, learn, id, text, sample_rows, seed)
    found = lexicon(rows, least)
    if not found:
        return Model(Matcher([], frozenset()), np.zeros(FEATURES), -3.0)
    spread = rows.sparkSession.sparkContext.broadcast(Matcher(found, frozenset()))

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w for t in b["text"].to_pylist() for w, (edits, _) in spread.value.look_up(set(_WORD.findall(t.lower()))).items() if edits]
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(words)), pa.string())], ["word"])

    # Near words that documents without the label hold are words of their own.
    clean = rows.where("toxic = 0").select("text").mapInArrow(misspelled, "word string").distinct()
    matcher = Matcher(found, frozenset(r.word for r in clean.collect()))
    held = rows.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([describe(t, held.value)[0] for t in b["text"].to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b["toxic"], lists], ["toxic", "x"])

    table = rows.select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").toArrow()
    x = np.array(table["x"].to_pylist()).reshape(-1, FEATURES)
    y = (np.array(table["toxic"].to_pylist()) > 0).astype(np.float64)
    return Model(matcher, *logistic(x, y))


_MATCHES = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("at", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("context", T.DoubleType())]))
RESULT = T.StructType([T.StructField("tx_score", T.DoubleType()), T.StructField("tx_matches", _MATCHES)])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``) with ``tx_score`` and ``tx_matches`` (word, its place, edits, score of its window)."""
    prepare(docs.sparkSession)
    keep = [c for c in (keep or docs.columns) if c.lower() not in RESULT.names]
    rows = docs.select(*dict.fromkeys([*keep, text]))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("word", pa.string()), ("at", pa.int64()), ("edits", pa.int64()), ("context", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = strings(b[text])
            for s, e in slices(col):
                scores, matches = held.value.score(col[s:e].to_pylist())
                yield pa.RecordBatch.from_arrays([*(b[c].slice(s, e - s) for c in keep), pa.array(scores), pa.array(matches, kind)], [*keep, *RESULT.names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *RESULT.fields]))
