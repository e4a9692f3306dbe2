"""Quality: random-indexing word vectors pooled per document, and a small network with calibrated probabilities.

A token is a word, or what stands between two words unless that is one space; words in capitals only and numbers by their length are
tokens of their own. Tokens fall into ``CELLS`` hashed cells. Every cell has a sparse random index vector (one +1, one -1), and its
word vector is the sum of the index vectors of all tokens within ``WINDOW`` places, over the whole corpus, damped by a logarithm and
scaled to length 1. A document is the mean and the mean square of its tokens' vectors, the mean cosine of tokens 1, 2 and 3 places
apart (near 1 where words repeat), and the logarithm of the number of tokens.

Two layers of numpy turn that into a score: a hidden layer and a logistic one, trained by Adam on labelled rows; a fifth of them is
kept out and gives the number of epochs and the temperature by which the logits are divided (the least log loss there).

Word vectors take one pass over all texts: a task sends what it has added, cell by cell, and the sums are made per group of cells. What is
sent to tasks is the table of vectors, ``CELLS`` x ``dimension`` numbers (8 MB) whatever the corpus. The network is fitted on at most
``sample_rows`` labelled rows, the smallest seeded hashes of the id; only their pooled vectors reach the driver.

Defined cases: null and empty texts have no tokens, and the score of a text without any; several labels of an id are averaged; repeated rows
are scored alike; without labels every score is 0.5, with one class only it is the share of that class; ``ql_score`` replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.llm.common import ALNUM_WORDS, Words, cut, hash_spans, mix64, prepare, rank_hash, slices, strings, utf8

CELLS = 1 << 16
GROUPS = 64
DIMENSION = 32
WINDOW = 2
HIDDEN = 32
LAGS = (1, 2, 3)
AT_ONCE = 1 << 15
RESULT = T.StructType([T.StructField("ql_score", T.DoubleType())])


# ---------------------------------------------------------------- tokens


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and rows of the tokens of a slice, in order."""
    words = Words(data, offsets, ALNUM_WORDS)
    size = words.end - words.start
    capitals = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
    digits = np.r_[0, np.cumsum((data >= 48) & (data <= 57))]
    hash = words.hash.copy()
    shouted = (capitals[words.end] - capitals[words.start] == size) & (size > 1)
    hash[shouted] ^= np.uint64(0x5851F42D4C957F2D)
    number = digits[words.end] - digits[words.start] == size
    hash[number] = mix64(size[number].astype(np.uint64) + np.uint64(7 << 40))
    first = words.bounds[:-1]
    has = words.bounds[1:] > first
    start = np.r_[0, words.end[:-1]] if len(words) else np.empty(0, np.int64)
    start[first[has]] = offsets[:-1][has]
    tail = offsets[:-1].copy()
    tail[has] = words.end[words.bounds[1:][has] - 1]
    gap_start, gap_end = np.r_[start, tail], np.r_[words.start, offsets[1:]]
    gap_row = np.r_[words.row, np.arange(len(offsets) - 1)]
    length = gap_end - gap_start
    own = length > 0
    own[own] = (length[own] > 1) | (data[gap_start[own]] != 32)
    gap_start, gap_row, length = gap_start[own], gap_row[own], length[own]
    at = np.repeat(gap_start - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum()) if len(length) else np.empty(0, np.int64)
    order = np.argsort(np.r_[words.start, gap_start], kind="stable")
    every = np.r_[hash, hash_spans(data[at], length) ^ np.uint64(0x9FB21C651E98DF25)][order]
    return (mix64(every) >> np.uint64(48)).astype(np.int64), np.r_[words.row, gap_row][order]


def index_vectors(dimension: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Places of the +1 and the -1 of every cell."""
    random = np.random.default_rng(seed)
    plus = random.integers(0, dimension, CELLS)
    return plus, (plus + 1 + random.integers(0, dimension - 1, CELLS)) % dimension


def word_vectors(docs: DataFrame, text: str, dimension: int) -> np.ndarray:
    """The cells' vectors, float32, from all texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus, minus = index_vectors(dimension)
        total = np.zeros(CELLS * dimension, np.int32)
        for b in batches:
            col = strings(b["text"])
            for s, e in slices(col):
                cell, row = tokens(*utf8(col[s:e]))
                for near in range(1, WINDOW + 1):
                    same = row[near:] == row[:-near]
                    left, right = cell[:-near][same], cell[near:][same]
                    for a, b2 in ((left, right), (right, left)):
                        np.add.at(total, a * dimension + plus[b2], 1)
                        np.add.at(total, a * dimension + minus[b2], -1)
        groups = total.reshape(GROUPS, -1)
        used = [(g, np.flatnonzero(x)) for g, x in enumerate(groups)]
        used = [(g, at) for g, at in used if len(at)]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in used], pa.int32()), pa.array([at.astype(np.int32).tobytes() for _, at in used], pa.binary()), pa.array([groups[g][at].tobytes() for g, at in used], pa.binary())], ["group", "at", "add"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for g, at, value in zip(b["group"].to_pylist(), b["at"], b["add"], strict=True):
                sums.setdefault(g, np.zeros(CELLS // GROUPS * dimension, np.int64))[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(value.as_buffer(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([damped(x, dimension).tobytes() for x in sums.values()], pa.binary())], ["group", "vectors"])

    # A task's rows are at most GROUPS; a group's sums are of fixed size and are added as they come.
    parts = docs.select(F.col(text).alias("text")).mapInArrow(add, "group int, at binary, add binary")
    found = parts.repartition(GROUPS // 4, "group").mapInArrow(together, "group int, vectors binary").collect()
    out = np.zeros((GROUPS, CELLS // GROUPS, dimension), np.float32)
    for r in found:
        out[r.group] = np.frombuffer(r.vectors, np.float32).reshape(-1, dimension)
    return out.reshape(CELLS, dimension)


def damped(sums: np.ndarray, dimension: int) -> np.ndarray:
    x = (np.sign(sums) * np.log1p(abs(sums))).reshape(-1, dimension)
    return (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row a text: mean and mean square of its tokens' vectors, mean cosines by lag, and the logarithm of the tokens' number."""
    cell, row = tokens(data, offsets)
    rows, dimension = len(offsets) - 1, vectors.shape[1]
    out = np.zeros((rows, width(dimension)))
    for s in range(0, len(cell), AT_ONCE):  # one very long text is as many steps, not one large array
        n = min(AT_ONCE, len(cell) - s)
        wide, rows_of = vectors[cell[s : s + n + LAGS[-1]]], row[s : s + n + LAGS[-1]]
        x, own = wide[:n], rows_of[:n]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first], :dimension] += np.add.reduceat(x, first, axis=0)
        out[own[first], dimension : 2 * dimension] += np.add.reduceat(x * x, first, axis=0)
        for k, lag in enumerate(LAGS):
            a, b = wide[: len(wide) - lag][:n], wide[lag:][:n]
            alike = np.where(rows_of[: len(wide) - lag][:n] == rows_of[lag:][:n], np.einsum("ij,ij->i", a, b), 0)
            np.add.at(out[:, 2 * dimension + k], own[: len(alike)], alike)
    n = np.bincount(row, minlength=rows)
    out[:, :-1] /= np.maximum(n, 1)[:, None]
    out[:, -1] = np.log1p(n)
    return out


def width(dimension: int) -> int:
    return 2 * dimension + len(LAGS) + 1


# ---------------------------------------------------------------- the network


class Network:
    """tanh hidden layer and one logistic output; inputs are standardised by the training rows."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, layers: list[np.ndarray], temperature: float = 1.0):
        self.mean, self.spread, self.layers, self.temperature = mean, spread, layers, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh(((x - self.mean) / self.spread) @ w + b) @ v + c

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).mean())


def trained(x: np.ndarray, y: np.ndarray, apart: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = 12) -> Network:
    """Network fitted on the rows not ``apart``; those choose the epoch and the temperature."""
    learn = ~apart if (~apart).any() and apart.any() else np.ones(len(x), bool)
    check = apart if apart.any() else learn
    mean, spread = x[learn].mean(0), np.maximum(x[learn].std(0), 1e-6)
    random = np.random.default_rng(seed)
    layers = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    share = np.clip(y[learn].mean(), 1e-3, 1 - 1e-3)
    layers[3][0] = np.log(share / (1 - share))
    net = Network(mean, spread, layers)
    if y[learn].min() == y[learn].max():
        net.layers[2][:] = 0
        return net
    z, target = (x[learn] - mean) / spread, y[learn]
    first, second, step, best = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0, (np.inf, None)
    for _ in range(epochs):
        order = random.permutation(len(z))
        for s in range(0, len(z), 128):
            own = order[s : s + 128]
            hidden = np.tanh(z[own] @ layers[0] + layers[1])
            wrong = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -40, 40))) - target[own]) / len(own)
            back = np.outer(wrong, layers[2]) * (1 - hidden * hidden)
            slopes = [z[own].T @ back + decay * layers[0], back.sum(0), hidden.T @ wrong + decay * layers[2], np.array([wrong.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        now = loss(net.logits(x[check]), y[check])
        if now < best[0]:
            best = now, [p.copy() for p in layers]
    net.layers = best[1] or layers
    logits = net.logits(x[check])
    grid = np.exp(np.linspace(np.log(0.2), np.log(5), 81))
    net.temperature = float(min(grid, key=lambda t: loss(logits / t, y[check])))
    return net


class Model:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def score(self, col: pa.Array) -> np.ndarray:
        return self.network.probabilities(pooled(self.vectors, *utf8(col)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 20_000, dimension: int = DIMENSION, seed: int = 12) -> Model:
    """Word vectors of all ``docs``; network of the labelled rows for which ``learn`` holds."""
    spark = prepare(docs.sparkSession)
    vectors = word_vectors(docs, text, dimension)
    held = spark.sparkContext.broadcast(vectors)
    usable = labels.where(learn & F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.avg((F.col(label) > 0).cast("double")).alias("y"))
    some = usable.orderBy(rank_hash(seed, "id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id")  # at most sample_rows ids
    size = width(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = strings(b["text"])
            for s, e in slices(col):
                x = pooled(held.value, *utf8(col[s:e]))
                yield pa.RecordBatch.from_arrays([b["id"].slice(s, e - s), b["y"].slice(s, e - s), pa.ListArray.from_arrays(pa.array(np.arange(e - s + 1, dtype=np.int32) * size), pa.array(x.ravel()))], ["id", "y", "x"])

    found = cut(rows.mapInArrow(run, f"id {docs.schema[id].dataType.simpleString()}, y double, x array<double>"), "pooled")
    # Rows of one id count as often as they occur, up to the bound.
    sample = found.orderBy(rank_hash(seed, "id"), "id", "x").limit(sample_rows).select("y", "x", (F.pmod(rank_hash(seed + 1, "id"), F.lit(5)) == 0).alias("apart")).toArrow()
    if not sample.num_rows:
        zero = np.zeros(size)
        return Model(vectors, Network(zero, zero + 1, [np.zeros((size, 1)), np.zeros(1), np.zeros(1), np.zeros(1)]))
    x = np.array(sample["x"].combine_chunks().flatten()).reshape(-1, size)
    return Model(vectors, trained(x, np.array(sample["y"]), np.array(sample["apart"]), seed=seed))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``) with ``ql_score``, the probability of good quality."""
    prepare(docs.sparkSession)
    keep = [c for c in (keep or docs.columns) if c.lower() not in RESULT.names]
    rows = docs.select(*dict.fromkeys([*keep, text]))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = strings(b[text])
            for s, e in slices(col):
                yield pa.RecordBatch.from_arrays([*(b[c].slice(s, e - s) for c in keep), pa.array(held.value.score(col[s:e]))], [*keep, *RESULT.names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *RESULT.fields]))
