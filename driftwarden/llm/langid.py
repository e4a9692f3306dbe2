"""Language identification with interpolated Kneser-Ney character models.

One model a language, over the symbols of a lower-cased word between a start and an end mark, with up to
``ORDER - 1`` symbols of context. The n-grams of all languages lie in one sorted array of hashes per
order, with a row of probabilities (a column a language); contexts and their back-off weights likewise.
A text's cross-entropy in a language is the mean over all its symbols; the lowest wins, ties go to the
alphabetically first. A word's cost depends on nothing outside it, so it is computed once and remembered.

A text is rejected if it has no letter, or if its best cross-entropy lies above that language's limit. The
limit comes from labelled rows that the models did not see, without those likelier in another language: twice the
largest excess over the median found there, and at least half the way from the median to the cost of symbols drawn evenly.

Fitting uses about ``per_language`` rows of every language (a seeded hash of id and text chooses them). The tables have a
column a language, so from ``MANY`` languages on rows become fewer with their square, down to ``LEAST``; labels,
sources and ids are never inputs of a prediction.

Defined cases: null texts and texts without a letter get ``und``, score 0 and are rejected; without a
single labelled row everything is ``und``; ``li_*`` columns that the documents already have are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.llm.common import mix64, prepare, rank_hash, slices, strings

ORDER = 5
START, END, FIRST = 1, 2, 3
REMEMBERED = 200_000
MANY, LEAST = 40, 30
FEW = 8  # languages of fewer rows are calibrated on the rows that they are learned from
SHARPNESS = 40  # symbols at most that the confidence counts as independent
_PLAIN_WORD = regex.compile(r"[a-z]+")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
RESULT = T.StructType([T.StructField("li_lang", T.StringType()), T.StructField("li_score", T.DoubleType()), T.StructField("li_entropy", T.DoubleType()), T.StructField("li_rejected", T.BooleanType())])


def words_of(text: str) -> list[str]:
    """Letters with the marks that combine with them, such as vowel signs."""
    return (_PLAIN_WORD if text.isascii() else _WORD).findall(text.lower())


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words with their marks, the place in its word and the word of each."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + FIRST
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(lengths + 2) - (lengths + 2)
    place = np.arange(int((lengths + 2).sum())) - np.repeat(first, lengths + 2)
    word = np.repeat(np.arange(len(words)), lengths + 2)
    out = np.zeros(len(place), np.int64)
    out[first], out[first + lengths + 1] = START, END
    out[(place > 0) & (place <= lengths[word])] = points
    return out, place, word


def gram_hashes(code: np.ndarray) -> list[np.ndarray]:
    """[k][i]: hash of the k symbols that end at i (only where the word has so many), k from 0."""
    sums, out = np.zeros(len(code), np.uint64), [np.zeros(len(code), np.uint64)]
    for k in range(1, ORDER + 1):
        back = np.zeros(len(code), np.uint64)
        back[k - 1 :] = code[: max(len(code) - k + 1, 0)].astype(np.uint64)
        sums = sums + mix64(back * _FACTORS[k - 1] + np.uint64(k))
        out.append(mix64(sums + np.uint64(k)))
    return out


def fit_language(counts: dict[str, int], alphabet: int) -> tuple[list, list]:
    """Per order: (gram hashes, probabilities) and (context hashes, back-off weights), hashes in order."""
    words = list(counts)
    code, place, word = symbols(words)
    weight = np.array([counts[w] for w in words], np.float64)[word]
    grams = gram_hashes(code)
    found = []
    for k in range(1, ORDER + 1):
        at = np.flatnonzero((place >= k - 1) & (place >= 1))
        hashes, first, which = np.unique(grams[k][at], return_index=True, return_inverse=True)
        found.append((hashes, at[first], np.bincount(which, weight[at], len(hashes))))
    tables, contexts = [], []
    lower_hash, lower_p = None, None
    for k in range(1, ORDER + 1):
        hashes, rep, count = found[k - 1]
        if k < ORDER:  # how many symbols precede it; raw counts where the word begins with it
            longer = grams[k][found[k][1]]
            preceded = np.bincount(np.searchsorted(hashes, longer), minlength=len(hashes))
            count = np.where((place[rep] == k - 1) | (preceded == 0), count, preceded)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
        context = grams[k - 1][np.maximum(rep - 1, 0)] if k > 1 else np.zeros(len(rep), np.uint64)
        names, which = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(which, count), np.bincount(which)
        gamma = discount * kinds / total
        below = np.full(len(rep), 1 / alphabet) if k == 1 else lower_p[np.searchsorted(lower_hash, grams[k - 1][rep])]
        p = np.maximum(count - discount, 0) / total[which] + gamma[which] * below
        tables.append((hashes, p))
        contexts.append((names, gamma))
        lower_hash, lower_p = hashes, p
    return tables, contexts


def union(parts: list[tuple[np.ndarray, np.ndarray]], absent: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([h for h, _ in parts]))
    out = np.full((len(keys), len(parts)), absent, np.float32)
    for column, (h, v) in enumerate(parts):
        out[np.searchsorted(keys, h), column] = v
    return keys, out


def look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """Models of all languages and the limits of rejection."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        self.alphabet = len({c for words in counts.values() for w in words for c in w}) + 2
        fitted = [fit_language(counts[x], self.alphabet) for x in self.languages]
        orders = range(ORDER if fitted else 0)
        self.grams = [union([f[0][k] for f in fitted], -1) for k in orders]
        self.contexts = [union([f[1][k] for f in fitted], 1) for k in orders]
        self.median = np.zeros(len(fitted))
        self.limit = np.full(len(fitted), np.inf)
        self.remembered: dict[str, int] = {}
        self.costs = np.empty((0, len(fitted)), np.float32)
        self.sizes = np.empty(0, np.int32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"remembered": {}, "costs": self.costs[:0], "sizes": self.sizes[:0]}

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word in each language, and how many symbols it has."""
        code, place, word = symbols(words)
        grams = gram_hashes(code)
        p = np.full((len(code), len(self.languages)), 1 / self.alphabet, np.float32)
        for k in range(1, ORDER + 1):
            at = np.flatnonzero((place >= k - 1) & (place >= 1))
            keys, values = self.grams[k - 1]
            if not len(keys):  # no learned word is so long
                break
            row, seen = look_up(keys, grams[k][at])
            names, gamma = self.contexts[k - 1]
            context = grams[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.uint64)
            crow, cseen = look_up(names, context)
            backed = p[at] * np.where(cseen[:, None], gamma[crow], np.float32(1))
            own = np.where(seen[:, None], values[row], np.float32(-1))
            p[at] = np.where(own >= 0, own, backed)
        bits = -np.log2(p)
        bits[place == 0] = 0
        costs = np.zeros((len(words), len(self.languages)), np.float32)
        if len(word):
            costs = np.add.reduceat(bits, np.searchsorted(word, np.arange(len(words))), axis=0)
        return costs, np.fromiter(map(len, words), np.int64, len(words)) + 1

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean bits a symbol (texts x languages) and the number of symbols."""
        found = [words_of(t) for t in texts]
        new = set().union(*found).difference(self.remembered) if found else set()
        share = max(1, len(self.languages) / MANY)  # a word takes memory for each language
        if len(self.remembered) + len(new) > REMEMBERED / share:
            self.remembered, self.costs, self.sizes = {}, self.costs[:0], self.sizes[:0]
            new = set().union(*found)
        fresh = list(new)
        step = max(1, int(20_000 / share))
        for s in range(0, len(fresh), step):
            costs, sizes = self.score_words(fresh[s : s + step])
            self.remembered.update(zip(fresh[s : s + step], range(len(self.sizes), len(self.sizes) + len(sizes)), strict=True))
            self.costs, self.sizes = np.concatenate([self.costs, costs]), np.concatenate([self.sizes, sizes.astype(np.int32)])
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for i, words in enumerate(found):
            if words:
                at = np.fromiter(map(self.remembered.__getitem__, words), np.int64, len(words))
                sums[i], n[i] = self.costs[at].sum(axis=0, dtype=np.float64), self.sizes[at].sum()
        return sums / np.maximum(n, 1)[:, None], n

    def excess(self, entropy: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bits above the language's median, less for short texts, whose means scatter more."""
        return (entropy - self.median[best]) * np.minimum(1, np.sqrt(n / 400))

    def predict(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        score = 1 / np.exp2(-(h - low[:, None]) * np.minimum(n, SHARPNESS)[:, None]).sum(axis=1)
        named = n > 0
        rejected = ~named | (self.excess(low, best, n) > self.limit[best])
        return [self.languages[b] if y else "und" for b, y in zip(best, named, strict=True)], np.where(named, score, 0), np.where(named, low, 0), rejected


def learned_rows(docs: DataFrame, id: str, text: str, lang: str, learn: Column, per_language: int, seed: int) -> DataFrame:
    """About ``per_language`` rows of each language, chosen by a hash; ``part`` 0 calibrates, 1 to 3 train, -1 does both.

    Rows that share an id and a text count once, so that they stay within the bound.
    """
    usable = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = usable.groupBy(lang).count().collect()
    most = min(per_language, max(LEAST, per_language * MANY**2 // max(len(sizes), 1) ** 2))
    limits = [(name, ((1 << 63) - 1) * min(most, count) // count, count < FEW) for name, count in sizes]
    table = docs.sparkSession.createDataFrame(limits, "lang string, highest long, few boolean")
    rows = usable.select(F.col(lang).alias("lang"), F.col(id).alias("id"), F.col(text).alias("text"), F.pmod(rank_hash(seed + 1, id, text), F.lit(4)).alias("part"), rank_hash(seed, id, text).alias("rank"))
    chosen = rows.join(F.broadcast(table), "lang").where(F.col("rank") <= F.col("highest"))
    return chosen.groupBy("lang", "id", "text").agg(F.min(F.when(F.col("few"), F.lit(-1)).otherwise(F.col("part"))).alias("part")).drop("id")


def count_words(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1500, margin: float = 2.0, seed: int = 5) -> Model:
    """A model of the languages that ``lang`` names in the rows where ``learn`` is true."""
    prepare(docs.sparkSession)
    rows = learned_rows(docs, id, text, lang, learn, per_language, seed)
    counts: dict[str, dict[str, int]] = {}
    table = count_words(rows.where("part <> 0").select("lang", "text")).toArrow()
    for name, word, n in zip(*(table[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts.setdefault(name, {})[word] = n
    model = Model(counts)
    if not counts:
        return model
    held = docs.sparkSession.sparkContext.broadcast(model)
    number = {x: i for i, x in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            h, n = m.entropies(b["text"].to_pylist())
            own = np.array([number.get(x, -1) for x in b["lang"].to_pylist()], np.int64)
            use = np.flatnonzero((n > 0) & (own >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(own[use], pa.int64()), pa.array(h[use, own[use]]), pa.array(n[use]), pa.array(h[use].argmin(axis=1) == own[use])], ["k", "h", "n", "best"])

    seen = rows.where("part <= 0").select("lang", "text").mapInArrow(run, "k long, h double, n long, best boolean").toArrow()
    k, h, n, best = (np.array(seen[c]) for c in ("k", "h", "n", "best"))
    for x in range(len(model.languages)):
        own = k == x
        if (own & best).any():  # rows that are likelier in another language may be labelled wrongly
            own &= best
        if own.any():
            model.median[x] = np.median(h[own])
            halfway = (np.log2(model.alphabet) - model.median[x]) / 2
            model.limit[x] = max(halfway, margin * float(model.excess(h[own], k[own], n[own]).max()))
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``) with ``li_lang``, ``li_score``, ``li_entropy`` (bits a symbol) and ``li_rejected``."""
    prepare(docs.sparkSession)
    keep = [c for c in (keep or docs.columns) if c.lower() not in RESULT.names]
    rows = docs.select(*dict.fromkeys([*keep, text]))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = strings(b[text])
            for s, e in slices(col):
                lang, score, entropy, rejected = held.value.predict(col[s:e].to_pylist())
                yield pa.RecordBatch.from_arrays([b[c].slice(s, e - s) for c in keep] + [pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], [*keep, *RESULT.names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *RESULT.fields]))
