"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes of UTF-8 sets chunk ends, so an insertion moves only the chunks
around it. Chunks have at least ``MIN`` and at most ``MAX`` bytes and never split a character. Equal 128-bit
digests are equal chunks: of each, the document with the smallest id keeps its first occurrence and every
other one is removed. A run of repeated chunks counts from ``min_run`` characters on.

Digests are counted with partial sums, and only those that occur again are written and joined back, so a passage
that a third of all documents share is one row of the counted table; both sides of the join are scans, so
adaptive execution can split its hot keys.

Spans belong to a row, named by its id and a hash of its text, so rows that share an id never mix theirs.

Defined cases: null and empty texts have no chunks; rows that share an id are one document for the choice of
who keeps a chunk (all keep it) but each has spans of its own, equal ones where the texts are equal; rows with a
null id come after all others, and what only they hold is kept in all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.common import cut, prepare, slices, strings, unused, utf8, wanted_only

MIN, MAX = 20, 128
END_MASK = np.uint16(0xF000)  # four upper bits of a 16-bit hash: one end in 16 places
_GEAR = np.random.Generator(np.random.Philox(424242)).integers(0, 1 << 16, 256, dtype=np.uint16)
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def gear(data: np.ndarray) -> np.ndarray:
    """Sum of gear values of the last 16 bytes, each shifted by its distance, modulo 2^16."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        moved = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += moved
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each row the ends of its chunks, as places in ``data``."""
    head = np.ones(len(data) + 1, bool)
    head[:-1] = (data & 0xC0) != 0x80
    ends = np.flatnonzero(((gear(data) & END_MASK) == 0) & head[1:]) + 1
    bounds = np.searchsorted(ends, offsets, side="right")
    out = []
    for r in range(len(offsets) - 1):
        start, stop, own = int(offsets[r]), int(offsets[r + 1]), []
        for p in ends[bounds[r] : bounds[r + 1]].tolist():
            if p - start < MIN:
                continue
            while p - start > MAX:
                start = _back(head, start + MAX)
                own.append(start)
            if p - start >= MIN:
                own.append(p)
                start = p
        while stop - start > MAX:
            start = _back(head, start + MAX)
            own.append(start)
        if stop > start:
            own.append(stop)
        out.append(own)
    return out


def _back(head: np.ndarray, at: int) -> int:
    while not head[at]:
        at -= 1
    return at


def row_key(text: str):
    """What tells apart rows that share an id."""
    return F.xxhash64(F.col(text))


def chunks(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, row, d1, d2, start, length, again): a row a chunk, places in code points; ``again`` if the row had it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = strings(b["text"])
            for s, e in slices(col):
                data, offsets = utf8(col[s:e])
                if not len(data):
                    continue
                own = chunk_ends(data, offsets)
                row = np.repeat(np.arange(e - s), [len(x) for x in own])
                end = np.array([p for x in own for p in x], np.int64)
                begin = np.concatenate([[0], end[:-1]])
                view, digest = memoryview(data), xxhash.xxh3_128_digest
                d = np.frombuffer(b"".join([digest(view[x:y]) for x, y in zip(begin.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                first = points[offsets[row]]
                order = np.lexsort((begin, d[:, 1], d[:, 0], row))
                same = np.zeros(len(end), bool)
                same[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (d[order[1:]] == d[order[:-1]]).all(axis=1)
                at = pa.array(row + s)
                yield pa.RecordBatch.from_arrays([b["id"].take(at), b["row"].take(at), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array((points[begin] - first).astype(np.int32)), pa.array((points[end] - points[begin]).astype(np.int32)), pa.array(same)], ["id", "row", "d1", "d2", "start", "length", "again"])

    return docs.select(F.col(id).cast("long").alias("id"), row_key(text).alias("row"), F.col(text).alias("text")).mapInArrow(run, "id long, row long, d1 long, d2 long, start int, length int, again boolean")


def runs(group: np.ndarray, start: np.ndarray, end: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching spans of a group, in order and without overlap, as runs (group, start, end) of at least ``min_run``."""
    new = np.ones(len(start), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] != end[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]])[: len(first)] - 1
    long = end[last] - start[first] >= min_run
    return group[first][long], start[first][long], end[last][long]


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", min_run: int = 40) -> DataFrame:
    """The rows of ``marked`` with a repeated run."""
    return marked(docs, id, text, min_run).where(F.size("sd_repeated") > 0)


def marked(docs: DataFrame, id: str = "doc_id", text: str = "text", min_run: int = 40) -> DataFrame:
    """(id, sd_row, sd_chunks, sd_repeated, sd_shared, sd_removed, sd_first): texts with a repeated chunk, a row each.

    ``sd_row`` is ``row_key`` of the text. ``sd_repeated``, ``sd_shared`` (what other documents hold too) and ``sd_removed`` are arrays of (start, end) in
    code points, ``sd_first`` the smallest ids that hold the repeated chunks, ``sd_chunks`` how many of the text's chunks occur
    elsewhere or again. A text whose runs are all shorter than ``min_run`` has empty arrays.
    """
    prepare(docs.sparkSession)
    found = chunks(docs, id, text)
    counted = cut(found.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("nameless")).where("n > 1"), "repeated-chunks")
    hits = wanted_only(found, "d1", counted.select("d1"), 1 << 18).join(counted.hint("merge"), ["d1", "d2"])
    shared = F.coalesce(F.col("first") != F.col("last"), F.lit(False)) | ((F.col("nameless") > 0) & (F.col("first").isNotNull() | (F.col("nameless") > 1)))
    gone = F.col("again") | F.coalesce(F.col("first") < F.col("id"), F.col("first").isNotNull() & F.col("id").isNull())
    hits = hits.select("id", "row", "start", "length", "first", shared.alias("shared"), gone.alias("gone"))
    hits = hits.repartition("id", "row").sortWithinPartitions("id", "row", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the text that the batches so far end in; it may go on
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.concat_batches([held, b]) if held is not None else b
            edges = _edges(b)
            if len(edges) > 1:
                yield _summed(b.slice(0, edges[-1]), edges[:-1], min_run)
            held = b.slice(edges[-1])
        if held is not None:
            yield _summed(held, np.zeros(1, np.int64), min_run)

    return hits.mapInArrow(run, "id long, sd_row long, sd_chunks long, sd_repeated array<struct<start:long,end:long>>, sd_shared array<struct<start:long,end:long>>, sd_removed array<struct<start:long,end:long>>, sd_first array<long>")


def _edges(b: pa.RecordBatch) -> np.ndarray:
    """Where a new text begins."""
    id, null, row = b["id"].fill_null(0).to_numpy(), b["id"].is_null().to_numpy(zero_copy_only=False), b["row"].to_numpy()
    new = np.ones(len(row), bool)
    new[1:] = (id[1:] != id[:-1]) | (null[1:] != null[:-1]) | (row[1:] != row[:-1])
    return np.flatnonzero(new)


def _summed(b: pa.RecordBatch, edges: np.ndarray, min_run: int) -> pa.RecordBatch:
    """A row a text of chunk rows in order; equal rows of the documents have each chunk twice."""
    group = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, b.num_rows)))
    start = b["start"].to_numpy().astype(np.int64)
    once = np.ones(len(start), bool)
    once[1:] = (group[1:] != group[:-1]) | (start[1:] != start[:-1])
    group, start, end = group[once], start[once], (start + b["length"].to_numpy())[once]
    shared, gone = (b[c].to_numpy(zero_copy_only=False)[once] for c in ("shared", "gone"))

    def spans(chosen: np.ndarray) -> tuple[pa.Array, tuple]:
        found = runs(group[chosen], start[chosen], end[chosen], min_run)
        bounds = np.searchsorted(found[0], np.arange(len(edges) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(found[1]), pa.array(found[2])], ["start", "end"])), found

    every, found = spans(np.ones(len(group), bool))
    # Chunks within a run that is long enough, and the documents that hold them first.
    far = np.int64(1) << 40  # beyond any text's length
    at = np.searchsorted(found[0] * far + found[1], group * far + start, side="right") - 1
    inside = (at >= 0) & (found[0][np.maximum(at, 0)] == group) & (start < found[2][np.maximum(at, 0)]) if len(at) and len(found[0]) else np.zeros(len(group), bool)
    first, known = b["first"].fill_null(0).to_numpy()[once], b["first"].is_valid().to_numpy(zero_copy_only=False)[once]
    pairs = np.unique(np.stack([group[inside & known], first[inside & known]], 1), axis=0) if len(group) else np.empty((0, 2), np.int64)
    firsts = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(len(edges) + 1)).astype(np.int32)), pa.array(pairs[:, 1]))
    at = pa.array(edges)
    n = np.bincount(group, minlength=len(edges)).astype(np.int64)
    return pa.RecordBatch.from_arrays([b["id"].take(at), b["row"].take(at), pa.array(n), every.cast(SPANS), spans(shared)[0].cast(SPANS), spans(gone)[0].cast(SPANS), firsts], ["id", "sd_row", "sd_chunks", "sd_repeated", "sd_shared", "sd_removed", "sd_first"])


def with_marks(docs: DataFrame, marks: DataFrame, id: str, row: str, into: str = "_marks") -> DataFrame:
    """Every row of ``docs``, whose column ``row`` has its ``row_key``, with the column ``into``: the columns of ``marks``, null where it has none."""
    found = marks.select(F.col("id").alias("mark_id"), F.col("sd_row").alias("mark_row"), F.struct("*").alias(into))
    on = docs[id].cast("long").eqNullSafe(found["mark_id"]) & (docs[row] == found["mark_row"])
    return docs.join(found, on, "left").select(*(docs[f"`{c}`"] for c in docs.columns), found[into])


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", min_run: int = 40) -> DataFrame:
    """``docs`` with the removed runs cut out of their texts."""
    key, marks = unused("_key", docs), unused("_marks", docs)
    joined = with_marks(docs.withColumn(key, row_key(text)), marked(docs, id, text, min_run).where(F.size("sd_removed") > 0), id, key, marks)
    gone = F.col(f"{marks}.sd_removed")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform(gone, lambda x: F.array(x["start"], x["end"]))), F.array(F.char_length(text).cast("long")))
    pieces = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.substring(text, (F.get(edges, i * 2) + 1).cast("int"), (F.get(edges, i * 2 + 1) - F.get(edges, i * 2)).cast("int")))
    clean = F.when(F.col(marks).isNotNull(), F.array_join(pieces, "")).otherwise(F.col(text))
    return joined.select(*(clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
