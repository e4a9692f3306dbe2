"""Vector code compression: a vector becomes one code a part, the nearest entry of that part's codebook.

Components are floored to integers of 1/4096, so codebooks, distances and sums are exact and the same for any order of tasks. Entries
are filtered coarse to fine before any distance is taken. A part is cut into 1, 2, then 4 segments; with the segments' means m and
residual norms r, |x - c|^2 is at least the sum of length * (m_x - m_c)^2 + (r_x - r_c)^2. Entries whose bound lies above the distance
of the likeliest entry cannot be nearest and are left out (bounds are lowered by more than rounding could have raised them); survivors
get their exact integer distance.

A round is one scan: every task sends one row of sums for each entry in use, and the driver gets the sums of all tasks, a row
an entry. Codebooks are what is sent to tasks: ``entries`` times the dimension. Nothing depends on the number of vectors.

Defined cases: rows whose vector is null, or holds a null or a non-finite component, are dropped. The dimension is that of the smallest kept id
(null ids last, equal ids by vector); rows of another dimension stay, with null code and errors. Parts differ by one in length where the
dimension is no multiple. With fewer rows than entries the codebooks are that short. Components of any finite size are
exact (Python integers beyond 2^26); an error too large for a long is null. Repeated rows count as often as they occur. No rows, no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.llm.common import cut, prepare

SCALE = 4096
SMALL = 1 << 26
SEGMENTS = (1, 2, 4)
SLACK = 1e-11
RESULT = T.StructType([T.StructField("vc_code", T.StringType()), T.StructField("vc_error", T.LongType())])


def finite(col: pa.Array, dimension: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows to keep, which of these have the dimension, and the latter's floored components, a row each."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.asarray(pc.fill_null(pc.list_value_length(col), 0).cast(pa.int64()))
    flat = col.flatten()
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan))
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    end = np.cumsum(size)
    kept = np.flatnonzero((bad[end] == bad[end - size]) & np.asarray(col.is_valid()))
    whole = size[kept] == (size[kept[0]] if dimension is None and len(kept) else dimension)
    rows = kept[whole]
    width = int(size[rows[0]]) if len(rows) else dimension or 0
    x = values[(end[rows] - width)[:, None] + np.arange(width)] if len(values) else np.zeros((len(rows), width))
    return kept, whole, floored(x)


def floored(x: np.ndarray) -> np.ndarray:
    if not x.size or abs(x).max() < SMALL / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= 2**53 else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


def cuts(size: int, parts: int) -> list[tuple[int, int]]:
    return [(k * size // parts, (k + 1) * size // parts) for k in range(parts)]


class Entries:
    """One part's codebook with the segment statistics of its entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.large = entries.dtype == object or entries.shape[1] > 256 or (entries.size and abs(entries).max() >= SMALL)
        if not self.large:
            self.levels = [(g, *segments(entries, g)) for g in SEGMENTS if g <= entries.shape[1]]
            self.norm = (entries.astype(np.float64) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower of equals) and its squared distance, a row each."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if self.large or x.dtype == object:
            d = ((x[:, None, :].astype(object) - self.entries[None].astype(object)) ** 2).sum(-1)
            best = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64)
            return best, d[np.arange(len(x)), best]
        slack = SLACK * ((x.astype(np.float64) ** 2).sum(1)[:, None] + self.norm[None]) + 1e-6
        g, length, mean, rest = self.levels[0]
        _, own_mean, own_rest = segments(x, g)
        bound = length[0] * (own_mean - mean[:, 0][None]) ** 2 + (own_rest - rest[:, 0][None]) ** 2
        guess = bound.argmin(1)
        limit = ((x - self.entries[guess]) ** 2).sum(1)
        distance = np.full(bound.shape, np.iinfo(np.int64).max)
        alive = bound - slack <= limit[:, None]
        alive[np.arange(len(x)), guess] = False
        i, j = np.nonzero(alive)
        for g, length, mean, rest in self.levels[1:]:
            _, own_mean, own_rest = segments(x, g)
            fine = (length * (own_mean[i] - mean[j]) ** 2 + (own_rest[i] - rest[j]) ** 2).sum(1)
            near = fine - slack[i, j] <= limit[i]
            i, j = i[near], j[near]
        distance[np.arange(len(x)), guess] = limit
        distance[i, j] = ((x[i] - self.entries[j]) ** 2).sum(1)
        best = distance.argmin(1)
        return best, distance[np.arange(len(x)), best]


def segments(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, means and residual norms of ``count`` consecutive segments of each row."""
    at = np.array([a for a, _ in cuts(x.shape[1], count)])
    length = np.diff(np.r_[at, x.shape[1]]).astype(np.float64)
    y = x.astype(np.float64)
    mean = np.add.reduceat(y, at, axis=1) / length
    rest = np.add.reduceat((y - np.repeat(mean, length.astype(int), axis=1)) ** 2, at, axis=1)
    return length, mean, np.sqrt(rest)


class Codebooks:
    """``parts[p]``: the entries of part p. Exact integers throughout."""

    def __init__(self, parts: list[np.ndarray], dimension: int | None):
        self.parts, self.dimension, self.cuts = [Entries(x) for x in parts], dimension, cuts(dimension or 0, len(parts))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for p in self.parts for e in p.entries.tolist() for v in e).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        found = [p.nearest(x[:, a:b]) for p, (a, b) in zip(self.parts, self.cuts, strict=True)]
        return np.stack([f[0] for f in found], 1), [f[1] for f in found]

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for: the middle of its integers' cells."""
        return [(v + 0.5) / SCALE for p, k in zip(self.parts, bytes.fromhex(code), strict=True) for v in p.entries[k].tolist()]


def fit(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks:
    """Codebooks over all rows, from the ``entries`` smallest ids; every round scans ``vectors`` once."""
    prepare(vectors.sparkSession)
    bound = float("inf")
    fine = vectors.where(F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < bound)))
    rows = fine.select(F.col(id).alias("id"), F.col(vector).alias("v"))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).limit(1).toArrow()["v"].combine_chunks()
    if not len(first):
        return Codebooks([np.zeros((0, 0), np.int64)] * parts, None)
    dimension = len(first[0])
    seeds = finite(rows.where(F.size("v") == dimension).orderBy(*order).limit(entries).toArrow()["v"], dimension)[2]
    books = Codebooks([seeds[:, a:b] for a, b in cuts(dimension, parts)], dimension)
    for _ in range(rounds):
        books = improved(vectors.select(F.col(vector).alias("v")), books)
    return books


def improved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries replaced by the floored means of the parts assigned to them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = {}, {}
        for b in batches:
            x = finite(b["v"], books.dimension)[2]
            codes = books.nearest(x)[0] if len(x) else []
            for p, (start, end) in enumerate(books.cuts):
                for e in np.unique(codes[:, p]).tolist() if len(x) else []:
                    own = x[codes[:, p] == e, start:end]
                    count[p, e] = count.get((p, e), 0) + len(own)
                    total[p, e] = total.get((p, e), 0) + own.sum(0).astype(object)
        keys = list(count)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([count[k] for k in keys], pa.int64()), pa.array([[str(v) for v in total[k]] for k in keys], pa.list_(pa.string()))], ["part", "entry", "n", "total"])

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].sum())
        mean = [str(sum(map(int, column)) // n) for column in zip(*rows["total"])]
        return pd.DataFrame({"part": rows["part"].iloc[:1], "entry": rows["entry"].iloc[:1], "mean": [mean]})

    # A group has one row a task.
    found = vectors.mapInArrow(sums, "part int, entry int, n long, total array<string>").groupBy("part", "entry").applyInPandas(together, "part int, entry int, mean array<string>").collect()
    new = [p.entries.astype(object) for p in books.parts]
    for r in found:
        new[r.part][r.entry] = [int(v) for v in r.mean]
    return Codebooks([x if x.size and abs(x).max() >= SMALL else x.astype(np.int64) for x in new], books.dimension)


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Kept rows of ``vectors`` (its columns ``keep``) with ``vc_code`` (two hex digits a part) and ``vc_error``."""
    prepare(vectors.sparkSession)
    keep = [c for c in (keep or vectors.columns) if c.lower() not in RESULT.names]
    rows = vectors.select(*dict.fromkeys([*keep, vector]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, whole, x = finite(b[vector], books.dimension)
            code, error = np.full(len(kept), None, object), np.full(len(kept), None, object)
            if len(x):
                codes, distances = books.nearest(x)
                text = codes.astype(np.uint8).tobytes().hex()
                size = 2 * len(books.parts)
                code[whole] = [text[i : i + size] for i in range(0, len(text), size)]
                sums = sum(d.astype(object) for d in distances)
                error[whole] = [v if v < 1 << 63 else None for v in sums.tolist()]
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in keep), pa.array(code, pa.string()), pa.array(error, pa.int64())], [*keep, *RESULT.names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *RESULT.fields]))


def with_group_errors(coded: DataFrame, label: str, share: int = 10_000) -> DataFrame:
    """``coded`` with ``vc_group_error``, the errors summed over equal labels (null if one of them is null).

    Sums of labels that hold one of ``share`` rows or more (at most ``share`` labels) are sent to all tasks; the others are joined.
    """
    rows = cut(coded, "codes")
    whole = F.count_if(F.col("vc_error").isNull() & F.col("vc_code").isNotNull()) == 0
    sums = cut(rows.groupBy(F.col(label).alias("_group")).agg(F.when(whole, F.sum(F.col("vc_error").cast("decimal(38,0)")).try_cast("long")).alias("vc_group_error"), F.count("*").alias("_rows")), "group-errors")
    least = max(1, (sums.agg(F.sum("_rows")).first()[0] or 0) // share)
    of = rows[label].eqNullSafe(sums["_group"])
    large, rest = F.broadcast(sums.where(F.col("_rows") >= least)), sums.where(F.col("_rows") < least)
    columns = [*(rows[c] for c in rows.columns), "vc_group_error"]
    return rows.join(large, of).select(columns).unionByName(rows.join(large, of, "left_anti").join(rest, of).select(columns))
