"""I-Match fingerprints: distinct terms within a band of inverse document frequency, hashed over random subsets.

Document frequencies come from all documents, counted in ``1 << WIDTH`` hashed cells: a table of fixed size. Terms that
share a cell raise each other's count; with t distinct terms a document a cell gains about t / 2^WIDTH of all
documents, for 300 terms 0.007 %, far below the band's lower edge, at any corpus size.

A text keeps its distinct terms whose share of documents lies in [low, high], that is an inverse document
frequency in [ln(1/high), ln(1/low)]; with fewer than ``few`` such terms, those nearest to the band make up the number,
so texts on both sides of it differ in a term only. The fingerprint has a hash of
them all (classic I-Match), then one part for each of ``SUBSETS`` random lexicon orders: halving subsets of
the lexicon are nested, and the part names the sparsest one that holds any of the terms, with the hash of those
it holds. Hashes are sums of mixed term hashes, which is the hash of the sorted list of distinct terms
whatever order they are met in. Likeness is the share of lexicon orders whose parts agree; it estimates the
share of terms that two texts have in common and is 1 for equal term sets.

Defined cases: null is empty; texts without a term have an empty fingerprint part list and are like each other
alone; rows are ordered by id, then a hash of the text, then text, nulls first, and each is followed by the next row.
An id that very many rows share is spread over ranges by that hash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.common import ALNUM_WORDS, Words, mix64, prepare, slices, strings, utf8

WIDTH = 22
BLOCK = 12
SUBSETS = 24
RANGE_ROWS = 8_000
NULL_ID = -(1 << 63)
_SEEDS = np.random.Generator(np.random.Philox(3141)).integers(0, 1 << 63, SUBSETS, dtype=np.int64).astype(np.uint64)


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WIDTH)).astype(np.int64)


def distinct_terms(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct term hashes of each row."""
    words = Words(data, offsets, ALNUM_WORDS)
    return [np.unique(words.hash[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]


def packed(counts: np.ndarray) -> bytes:
    """The counts above 0 and their places."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<i8").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 10
    return np.frombuffer(data, "<u2", n), np.frombuffer(data, "<i8", n, 2 * n)


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(block, counts): documents with a term in each cell, a row a block of cells; block -1 counts the documents."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << WIDTH, np.int32), 0
        for b in batches:
            rows += b.num_rows
            col = strings(b["text"])
            for s, e in slices(col):
                for terms in distinct_terms(*utf8(col[s:e])):
                    total[np.unique(cells(terms))] += 1
        if rows:
            blocks = total.reshape(-1, 1 << BLOCK)
            kept = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array([*(packed(blocks[k]) for k in kept), packed(np.array([rows]))], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None, None
        for b in batches:
            out = []
            for k, counts in zip(b["block"].to_pylist(), b["counts"].to_pylist(), strict=True):
                if k != own:
                    out += [(own, packed(total))] if own is not None else []
                    own, total = k, np.zeros(1 << BLOCK, np.int64)
                at, n = unpacked(counts)
                total[at] += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["block", "counts"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([packed(total)], pa.binary())], ["block", "counts"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "block long, counts binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, counts binary")


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """The counts of ``counted`` as one array of cells, and how many documents there are."""
    summed = counted(docs, text).toArrow()
    out, documents = np.zeros((1 << WIDTH - BLOCK, 1 << BLOCK), np.int64), 0
    for k, counts in zip(summed["block"].to_pylist(), summed["counts"].to_pylist(), strict=True):
        at, n = unpacked(counts)
        if k < 0:
            documents = int(n.sum())
        else:
            out[k, at] = n
    return out.ravel(), documents


def beyond_band(frequencies: np.ndarray, documents: int, low: float, high: float) -> np.ndarray:
    """How far each cell is from the band, a byte: 0 inside, else steps of an eighth of a bit beyond its edge."""
    edges = np.log2([max(2, low * documents), max(2, high * documents)])
    at = np.log2(np.maximum(frequencies, 0.5))
    beyond = np.maximum(np.maximum(edges[0] - at, at - edges[1]), 0)
    return np.minimum(np.ceil(beyond * 8), 255).astype(np.uint8)


def fit(docs: DataFrame, text: str, low: float, high: float, few: int) -> Lexicon:
    """The lexicon of all documents: a byte a cell reaches the driver, 4 MB before compression."""
    documents = docs.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = []
            for counts in b["counts"].to_pylist():
                at, n = unpacked(counts)
                block = np.zeros(1 << BLOCK, np.int64)
                block[at] = n
                codes.append(zlib.compress(beyond_band(block, documents, low, high).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b["block"], pa.array(codes, pa.binary())], ["block", "codes"])

    found = counted(docs, text).where("block >= 0").mapInArrow(run, "block long, codes binary").toArrow()
    out = np.full((1 << WIDTH - BLOCK, 1 << BLOCK), beyond_band(np.zeros(1), documents, low, high)[0], np.uint8)
    for k, codes in zip(found["block"].to_pylist(), found["codes"].to_pylist(), strict=True):
        out[k] = np.frombuffer(zlib.decompress(codes), np.uint8)
    return Lexicon(out.ravel(), few)


class Lexicon:
    """Which terms of a text are kept, from the distance of their cells to the band (``beyond_band``)."""

    def __init__(self, beyond: np.ndarray, few: int):
        self.beyond, self.few = beyond, few

    def kept(self, terms: np.ndarray) -> np.ndarray:
        beyond = self.beyond[cells(terms)]
        chosen = terms[beyond == 0]
        if len(chosen) >= self.few or len(chosen) == len(terms):
            return chosen
        return np.sort(terms[np.lexsort((terms, beyond))[: self.few]])

    def fingerprints(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of all kept terms, and the parts (level in the upper 8 bits, hash below), a row a text."""
        offsets = np.cumsum([0, *map(len, texts)])
        rows = [self.kept(x) for x in distinct_terms(np.frombuffer(b"".join(texts), np.uint8), offsets)]
        sizes = np.array([len(r) for r in rows], np.int64)
        full = np.flatnonzero(sizes)
        whole, parts = np.zeros(len(rows), np.uint64), np.zeros((len(rows), SUBSETS), np.uint64)
        if len(full):
            terms = np.concatenate([rows[i] for i in full])
            starts = np.cumsum(sizes[full]) - sizes[full]
            value = mix64(terms + np.uint64(0xA0761D6478BD642F))
            whole[full] = mix64(np.add.reduceat(value, starts))
            for k in range(SUBSETS):
                order = mix64(terms ^ _SEEDS[k])
                least = np.minimum.reduceat(order, starts)
                level = np.minimum(63 - np.floor(np.log2(np.maximum(least.astype(np.float64), 1.0))).astype(np.int64), 40)
                bound = (np.uint64(1) << (64 - level).clip(0, 63).astype(np.uint64)) - np.uint64(1)
                bound[level <= 0] = np.uint64((1 << 64) - 1)
                held = order <= np.repeat(bound, sizes[full])
                sums = mix64(np.add.reduceat(np.where(held, value, np.uint64(0)), starts) + np.uint64(k))
                parts[full, k] = (level.astype(np.uint64) << np.uint64(56)) | (sums >> np.uint64(32))
        return whole, parts


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.where(a[0] == b[0], 1.0, (a[1] == b[1]).mean(axis=1) * (a[0] != 0) * (b[0] != 0))


def spelled(whole: np.ndarray, parts: np.ndarray) -> list[str]:
    return [f"{w:016x}" + "".join(f"-{p >> 56:02x}{p & 0xFFFFFFFF:08x}" for p in row) if w else f"{w:016x}" for w, row in zip(whole.tolist(), parts.tolist(), strict=True)]


def ranges_of(key: np.ndarray, tie: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each row. A key that several bounds share is split among them by the tie's place in its domain."""
    first = np.searchsorted(bounds, key, side="left")
    several = np.searchsorted(bounds, key, side="right") - first
    share = (tie.astype(np.float64) + 2.0**63) / 2.0**64
    return (first + np.minimum((several * share).astype(np.int64), np.maximum(several - 1, 0))).astype(np.int64)


def in_order(docs: DataFrame, id: str, text: str, range_rows: int, max_ranges: int) -> DataFrame:
    """(part, halo, id, tie, text) in order within parts; each part ends with the row that follows its last (halo 1)."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", F.coalesce("id", F.lit(NULL_ID)).alias("key"), F.xxhash64("text").alias("tie"), "text")
    keys = rows.select("key", "tie")
    ranges = min(max(1, -(-keys.count() // range_rows)), max_ranges)
    cuts = [k / ranges for k in range(1, ranges)]
    bounds = np.array(sorted(keys.agg(F.percentile_approx("key", cuts, 20 * ranges)).first()[0] or []) if cuts else [], np.int64)

    def place(b: pa.RecordBatch) -> np.ndarray:
        return ranges_of(b["key"].to_numpy(), b["tie"].to_numpy(), bounds)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(b)), b["key"], b["tie"]], ["part", "key", "tie"])

    firsts = keys.mapInArrow(parts, "part long, key long, tie long").groupBy("part").agg(F.min(F.struct("key", "tie")).alias("head")).orderBy("part").collect()
    before = {(first.head.key, first.head.tie): firsts[i - 1].part for i, first in enumerate(firsts)}
    heads = np.array(sorted({k for k, _ in before}), np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, key, tie = place(b), b["key"].to_numpy(), b["tie"].to_numpy()
            zero = np.zeros(len(key), np.int64)
            names = ["part", "halo", "id", "tie", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(zero), b["id"], b["tie"], b["text"]], names)
            at = [i for i in np.flatnonzero(np.isin(key, heads)).tolist() if (int(key[i]), int(tie[i])) in before]
            if at:
                to, taken = pa.array([before[int(key[i]), int(tie[i])] for i in at], pa.int64()), pa.array(at)
                yield pa.RecordBatch.from_arrays([to, pa.array(zero[at] + 1), b["id"].take(taken), b["tie"].take(taken), b["text"].take(taken)], names)

    dealt = rows.mapInArrow(spread, "part long, halo long, id long, tie long, text string")
    # Ranges are tasks by their number: dealt by a hash, several would meet in one task.
    return dealt.repartitionById(len(bounds) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "halo", F.col("id").asc_nulls_first(), "tie", "text")


def fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text", low: float = 0.001, high: float = 0.1, few: int = 8, range_rows: int = RANGE_ROWS, max_ranges: int = 50_000) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row a document.

    The edited text has its last floor(n / 2) code points replaced by as many first ones of the next document.
    """
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, text, low, high, few))

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """``rows``: each but the last is compared with the one after it."""
        chosen = [i for i in range(len(rows) - 1) if not rows[i][1]]
        for k in range(0, len(chosen), 1000):
            at = chosen[k : k + 1000]
            own = [rows[i][3] for i in at]
            edited = [(t[: len(t) - len(t) // 2] + rows[i + 1][3][: len(t) // 2]).encode() for i, t in zip(at, own, strict=True)]
            mine = held.value.fingerprints([t.encode() for t in own])
            other = held.value.fingerprints(edited)
            # The next text is the next chosen row's own; only where it is not, it is done apart.
            follows = {i: n for n, i in enumerate(at)}
            apart = [i + 1 for i in at if i + 1 not in follows]
            extra = held.value.fingerprints([rows[i][3].encode() for i in apart])
            where = {i: n for n, i in enumerate(apart)}
            pick = lambda m, x: np.array([m[follows[i + 1]] if i + 1 in follows else x[where[i + 1]] for i in at])
            after = pick(mine[0], extra[0]), pick(mine[1], extra[1])
            sha = [hashlib.sha256(t).hexdigest() for t in edited]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i][2] for i in at], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array(sha), pa.array(spelled(*mine)), pa.array(spelled(*other)), pa.array(likeness(mine, other)), pa.array(likeness(mine, after))],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for b in batches:
            for s, e in slices(strings(b["text"])):
                piece = b.slice(s, e - s)
                rows = last + list(zip(*(piece[c].to_pylist() for c in ("part", "halo", "id", "text")), strict=True))
                yield from compare(rows)
                last = rows[-1:]

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, id, text, range_rows, max_ranges).mapInArrow(run, schema)
