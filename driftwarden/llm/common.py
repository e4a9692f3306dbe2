"""Shared pieces of the corpus operators: table access, checkpoints and batch-wise word tables.

Texts reach Python as Arrow batches. A batch is cut into slices of about ``SLICE_BYTES`` so that
the numpy work arrays stay small whatever the batch size; one text longer than that is a slice
of its own and is still processed whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.session import checkpoint_dir, ship

SLICE_BYTES = 1 << 20
ARROW_BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on: small Arrow batches and a code path for workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one where that is unset, in local mode only."""
    return checkpoint_dir(spark)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores as it takes to be no column of ``frames``, whatever their case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/driftwarden/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``frames``; nothing that is still to run may read them."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def wanted_only(df: DataFrame, key: str, ids: DataFrame, words: int = 1 << 17) -> DataFrame:
    """Rows of ``df`` whose long ``key`` may be in ``ids`` (one long column), so that a join moves little else.

    The ids set bits of a map of 64 * ``words`` bits, which is broadcast: its size is fixed (2 MB by default).
    With very many ids more rows pass than need to; a join must follow.
    """
    place = lambda c: F.xxhash64(F.lit(3), c)
    word = lambda c: F.pmod(F.shiftright(place(c), 6), F.lit(words))
    bit = lambda c: F.pmod(place(c), F.lit(64)).cast("int")
    own = F.col(ids.columns[0])
    one = F.lit(1).cast("long")
    table = ids.groupBy(word(own).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", one, bit(own))).alias("_bits"))
    found = df.join(F.broadcast(table), word(F.col(key)) == F.col("_word"))
    return found.where(F.call_function("shiftright", F.col("_bits"), bit(F.col(key))).bitwiseAND(one) == 1).select(*df.columns)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def rank_hash(seed: int, *cols: str):
    """A seeded number in [0, 2^63), the same for a row in every run."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 63) - 1))


def strings(col: pa.Array) -> pa.Array:
    """The column as large strings without nulls."""
    return pc.fill_null(col.cast(pa.large_string()), "")


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a ``strings`` array, each of at most ``limit`` bytes or of one row."""
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    start = 0
    while start < len(col):
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(col))
        yield start, end
        start = end


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (starting at 0) of a ``strings`` array, without a copy."""
    if not len(col) or col.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


# ---------------------------------------------------------------- word tables

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def byte_class(separators: bytes | range | list[int]) -> np.ndarray:
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    return is_word


#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM_WORDS = byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Words `[^\x20\x09-\x0D]+`.
SPACED_WORDS = byte_class([0x20, *range(0x09, 0x0E)])

_rng = np.random.Generator(np.random.Philox(20240229))
_BYTE_KEYS = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, _BASE, np.uint64), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Word occurrences of a slice: ``start``/``end`` in bytes, ``row``, 64-bit ``hash``, ``per_row`` bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashes: bool = True):
        self.data = ASCII_LOWER[data]
        inside = is_word[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:n]
            last[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        if hashes:
            self.hash = hash_spans(self.data[inside], self.end - self.start)

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def hash_spans(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive byte spans of the given lengths (all above 0)."""
    if not len(lengths):
        return np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(data)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_BYTE_KEYS[data] * _POWERS[at & 0xFFFF], first)
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_word(word: bytes) -> int:
    """What ``Words.hash`` has for this word."""
    return int(hash_spans(np.frombuffer(word, np.uint8), np.array([len(word)]))[0])


def utf8_to_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code-point positions of byte positions ``at`` within one text's UTF-8."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return heads[at]


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one batch to batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()], schema=schema)
