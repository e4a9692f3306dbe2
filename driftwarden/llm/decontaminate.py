"""Benchmark decontamination: an FM-index per training shard, searched for the benchmark's windows.

A shard is one slice of an Arrow batch. Its words become symbols of the benchmark's own vocabulary;
every other word can take part in no match and separates. Runs of vocabulary words shorter than the
shortest window are left out for the same reason, so the suffix array covers only text that can match.
The index is a Burrows-Wheeler transform in a wavelet matrix; windows are found by backward search,
placed by walking to sampled suffix positions, and their spans merged.

A window is ``window`` consecutive words of an item, or all words of a shorter item. The benchmark is a
query set: it is read in blocks of at most ``block_words`` words, each broadcast alone, one pass a block; after every
``STAGE_BLOCKS`` passes the rows are written and their blocks given up, so that neither the driver nor a task holds more.

Defined cases: null or empty texts have no words and stay; items without words match nothing; items that
share an id count once; ``dc_*`` columns that the documents already have are replaced; repeated rows
are each marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.llm.common import ALNUM_WORDS, Words, cut, hash_word, prepare, slices, strings, utf8

SAMPLE = 8
STAGE_BLOCKS = 4
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = T.StructType([T.StructField("dc_words", T.LongType()), T.StructField("dc_spans", SPANS), T.StructField("dc_items", T.ArrayType(T.StringType())), T.StructField("dc_bytes", SPANS)])


class WaveletMatrix:
    """Ranks and symbols of an integer sequence, one bit vector for each binary digit."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.digits = range(max(1, int(top).bit_length()) - 1, -1, -1)
        for d in self.digits:
            bits = (symbols >> d) & 1
            ones = np.zeros(len(bits) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.levels.append((ones, bits.astype(bool), len(bits) - int(ones[-1])))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, at = np.zeros_like(at), at.copy()
        for d, (ones, _, zeros) in zip(self.digits, self.levels, strict=True):
            one = ((symbol >> d) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol, at = np.zeros_like(at), at.copy()
        for d, (ones, bits, zeros) in zip(self.digits, self.levels, strict=True):
            one = bits[at]
            symbol |= one.astype(symbol.dtype) << d
            at = np.where(one, zeros + ones[at], at - ones[at])
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling. Zeros separate and all differ, the earlier being the less."""
    n, zero = len(text), text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + int(zero.sum()))
    step = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, 2 * step


class FMIndex:
    """Backward search and location over a text of symbols 1.., in which 0 separates and ends it."""

    def __init__(self, text: np.ndarray, top: int):
        order = suffix_array(text)
        before = text[order - 1]  # of the first suffix: the last symbol, a separator
        self.n = len(text)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.bwt = WaveletMatrix(before.astype(np.int64), top)
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.places = sampled, order[sampled]
        self.sample_rank = np.cumsum(sampled) - 1

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.bwt.rank(symbol, at)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns (rows, filled from the right)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            live = live[(lengths[live] >= back) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = patterns[live, -back]
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, walked, place = rows.copy(), np.zeros_like(rows), np.empty_like(rows)
        live = np.arange(len(rows))
        while len(live):
            there = self.sampled[at[live]]
            done, live = live[there], live[~there]
            place[done] = self.places[self.sample_rank[at[done]]] + walked[done]
            at[live] = self.step(self.bwt.access(at[live]), at[live])
            walked[live] += 1
        return place


class Windows:
    """The distinct windows of a block of items, as symbols of the block's vocabulary."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        names = sorted({word for _, words in items for word in words})
        hashes = np.array([hash_word(w) for w in names], np.uint64)
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]
        symbol = {names[k]: i + 1 for i, k in enumerate(order)}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({item for item, _ in items})
        number = {x: i for i, x in enumerate(self.items)}
        for item, words in items:
            ids = [symbol[w] for w in words]
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i : i + window]), set()).add(number[item])
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for row, key in zip(self.patterns, found, strict=True):
            row[-len(key) :] = key
        self.item_bounds = np.cumsum([0, *(len(v) for v in found.values())])
        self.item_ids = np.array([i for v in found.values() for i in sorted(v)], np.int64)

    def symbols(self, words: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words.hash, at + 1, 0)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a window and the word it begins at."""
        symbols = self.symbols(words)
        inside = symbols > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (words.row[1:] != words.row[:-1])
        run = np.cumsum(begins)[inside]
        if not len(run):
            return run, run
        long = np.bincount(run) >= self.lengths.min()
        kept = np.flatnonzero(inside)[long[run]]
        if not len(kept):
            return kept, kept
        run = run[long[run]]
        place = np.arange(len(kept)) + np.concatenate([[0], np.cumsum(run[1:] != run[:-1])])
        text = np.zeros(int(place[-1]) + 2, np.int64)
        text[place] = symbols[kept]
        origin = np.zeros(len(text), np.int64)
        origin[place] = kept
        index = FMIndex(text, len(self.vocabulary))
        low, high = index.search(self.patterns, self.lengths)
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
        return which, origin[index.locate(rows)]


def spans_of(mask: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of true words that stay within a row: first and one past the last."""
    new_row = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.empty(0, bool)
    first, last = mask.copy(), mask.copy()
    if len(mask):
        first[1:] &= ~mask[:-1] | new_row[1:]
        last[:-1] &= ~mask[1:] | new_row[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mark_slice(windows: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[list, list, list, list]:
    words = Words(data, offsets, ALNUM_WORDS)
    n = len(offsets) - 1
    spans, found, cuts = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
    which, at = windows.occurrences(words)
    if len(which):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + windows.lengths[which], -1)
        for s, e in zip(*spans_of(np.cumsum(change[:-1]) > 0, words.row), strict=True):
            r = words.row[s]
            spans[r].append((int(s - words.bounds[r]), int(e - words.bounds[r])))
            cuts[r].append((int(words.start[s] - offsets[r]), int(words.end[e - 1] - offsets[r])))
        pairs = np.unique(np.stack([words.row[at], which], 1), axis=0)
        for r, k in pairs.tolist():
            found[r].extend(windows.item_ids[windows.item_bounds[k] : windows.item_bounds[k + 1]].tolist())
    return np.diff(words.bounds).tolist(), spans, [sorted({windows.items[i] for i in x}) for x in found], cuts


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def joined(a: list, b: list) -> list:
    """Spans of two passes; words that only touch stay together, as they do within one pass."""
    return merged([*((x["start"], x["end"]) for x in a), *b]) if a else b


def blocks(benchmark: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, streamed from the executors in blocks of at most ``block_words`` words."""
    held, size = [], 0
    for item, text in benchmark.select(F.col(item_id).cast("string"), item_text).toLocalIterator():
        data = np.frombuffer((text or "").encode(), np.uint8)
        words = Words(data, np.array([0, len(data)]), ALNUM_WORDS, hashes=False)
        if item is None or not len(words):
            continue
        if held and size + len(words) > block_words:
            yield held
            held, size = [], 0
        held.append((item, [words.text(i) for i in range(len(words))]))
        size += len(words)
    if held:
        yield held


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, keep: list[str] | None = None, block_words: int = 1_000_000) -> DataFrame:
    """``docs`` (its columns ``keep``, by default all) with what matched:

    ``dc_words`` words of the text, ``dc_spans`` word spans inside occurrences, ``dc_items`` ids of the
    items that occur (sorted as strings), ``dc_bytes`` the same spans as bytes of the UTF-8 text.
    """
    prepare(docs.sparkSession)
    keep = [c for c in (keep or docs.columns) if c.lower() not in RESULT.names]
    out = docs.select(*dict.fromkeys([*keep, text]))
    sc = docs.sparkSession.sparkContext
    coming = chain(blocks(benchmark, item_id, item_text, block_words), [None])
    items, k, sent = next(coming), 0, []
    while items is not None or k == 0:
        windows = Windows(items, window) if items else None
        items = next(coming) if items else None
        last = items is None
        kept = keep if last else out.columns[: len(dict.fromkeys([*keep, text]))]
        fields = [out.schema[c] for c in kept]
        held = sc.broadcast(windows)
        sent.append(held)

        def run(batches: Iterator[pa.RecordBatch], kept=kept, held=held, later=k > 0) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = strings(b[text])
                for s, e in slices(col):
                    if held.value is None:
                        data, offsets = utf8(col[s:e])
                        words = np.diff(Words(data, offsets, ALNUM_WORDS, hashes=False).bounds).tolist()
                        result = [words, *([[] for _ in words] for _ in range(3))]
                    else:
                        result = list(mark_slice(held.value, *utf8(col[s:e])))
                    if later:
                        old = b.slice(s, e - s)
                        result[1] = [joined(x, y) for x, y in zip(old["dc_spans"].to_pylist(), result[1], strict=True)]
                        result[2] = [sorted({*x, *y}) for x, y in zip(old["dc_items"].to_pylist(), result[2], strict=True)]
                        result[3] = [joined(x, y) for x, y in zip(old["dc_bytes"].to_pylist(), result[3], strict=True)]
                    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    pairs = lambda rows: pa.array([[{"start": x, "end": y} for x, y in r] for r in rows], span)
                    arrays = [b[c].slice(s, e - s) for c in kept] + [pa.array(result[0], pa.int64()), pairs(result[1]), pa.array(result[2], pa.list_(pa.string())), pairs(result[3])]
                    yield pa.RecordBatch.from_arrays(arrays, [*kept, *RESULT.names])

        out = out.mapInArrow(run, T.StructType([*fields, *RESULT.fields]))
        k += 1
        if k % STAGE_BLOCKS == 0 and not last:
            out = cut(out, "marked")
            while sent:
                sent.pop().destroy()
    return out


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the matched spans; the rest of each text stays as it is, whole and in order."""
    columns = docs.columns
    marked = mark(docs, benchmark, text=text, **options)
    raw = F.encode(F.col(text), "utf-8")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform("dc_bytes", lambda x: F.array(x["start"], x["end"]))), F.array(F.octet_length(F.col(text)).cast("long")))
    pieces = F.transform(F.sequence(F.lit(0), F.size("dc_bytes")), lambda i: F.decode(F.substring(raw, (F.get(edges, i * 2) + 1).cast("int"), (F.get(edges, i * 2 + 1) - F.get(edges, i * 2)).cast("int")), "utf-8"))
    clean = F.when(F.size("dc_bytes") > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    return marked.withColumn(text, clean).select(*columns)
