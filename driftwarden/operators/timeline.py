"""Ordered operators per station that split a long station over days.

Rolling frames look back a bounded time, so a day's rows are joined by a copy of what the frames need of the day
before (the halo). Counters and previous rows need unbounded history: each day yields one summary row, the summaries
are combined in order, and their result is joined back. No task ever holds a whole station.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pandas.core.window import Rolling
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.schema import CHUNK_US
from driftwarden.session import ship
from driftwarden.sources.tables import micros

DAY = ["station_id", "chunk"]


def with_chunk(df: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Adds ``us`` (microseconds) and ``chunk``, the stretch of time that the row lies in."""
    return df.withColumn("us", micros()).withColumn("chunk", F.floor(F.col("us") / chunk_us))


def in_day() -> Window:
    return Window.partitionBy(*DAY).orderBy("us")


def with_previous(df: DataFrame, columns: list[str]) -> DataFrame:
    """``prev_<c>`` for each column: its value in the station's row before, however long ago; needs ``with_chunk``."""
    df = df.drop("prev_us", *(f"prev_{c}" for c in columns))
    row = F.struct("us", *columns)
    last = df.groupBy(*DAY).agg(F.max_by(row, "us").alias("last"))
    before = last.select(*DAY, F.lag("last").over(Window.partitionBy("station_id").orderBy("chunk")).alias("_before"))
    joined = df.withColumn("_lag", F.lag(row).over(in_day())).join(before, DAY)
    previous = F.coalesce("_lag", "_before")
    return joined.select(*df.columns, previous["us"].alias("prev_us"), *(previous[c].alias(f"prev_{c}") for c in columns if c != "us"))


def rolling(df: DataFrame, look_back_us: int, columns: dict[str, tuple[Column, int]], chunk_us: int = CHUNK_US, ordered: dict[str, tuple[str, int, float | str]] | None = None, with_now: bool = False) -> DataFrame:
    """Adds window results over [t - width, t): ``columns`` maps a name to (aggregate, width in microseconds).

    ``ordered`` maps a name to (column, width, statistic), by ``with_frame_statistics``. With ``with_now`` the frames
    end with the row itself. ``look_back_us`` is the greatest width; it must not exceed a chunk. Needs ``with_chunk``.
    """
    late = F.col("us") % chunk_us >= chunk_us - look_back_us
    own, halo = F.struct(F.col("chunk").alias("c"), F.lit(False).alias("h")), F.struct((F.col("chunk") + 1).alias("c"), F.lit(True).alias("h"))
    spread = df.withColumn("_to", F.explode(F.when(late, F.array(own, halo)).otherwise(F.array(own)))).withColumn("chunk", F.col("_to.c")).withColumn("_halo", F.col("_to.h")).drop("_to")
    frames = {w: in_day().rangeBetween(-w, 0 if with_now else -1) for w in {w for _, w in columns.values()}}
    out = spread.select("*", *(agg.over(frames[w]).alias(name) for name, (agg, w) in columns.items()))
    if ordered:
        # The frames above leave each day together and in order, so this sorts nothing again.
        out = (out if columns else out.repartition(*DAY)).sortWithinPartitions(*DAY, "us")
        out = with_frame_statistics(out, ordered, look_back_us, chunk_us, with_now)
    return out.where(~F.col("_halo")).drop("_halo")


class Frames(BaseIndexer):
    """Windows whose first and last row are known."""

    def __init__(self, start: np.ndarray, end: np.ndarray):
        super().__init__()
        self.start, self.end = start, end

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.start, self.end


def quantile(frames: Rolling, q: float) -> np.ndarray:
    """Quantiles with linear interpolation from the nearer of both neighbours."""
    if q in (0, 1, 0.5):
        return (frames.min() if q == 0 else frames.max() if q == 1 else frames.median()).to_numpy()
    low, high = (frames.quantile(q, interpolation=side).to_numpy() for side in ("lower", "higher"))
    return between(low, high, q * np.maximum(frames.count().to_numpy() - 1, 0))


def between(low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
    part = place - np.floor(place)
    return np.where(part < 0.5, low + (high - low) * part, low * (1 - part) + high * part)


#: Frames of at most so many rows are sorted whole; over longer ones a skip list slides.
SHORT_FRAME = 64


def sorted_frames(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, rows of the longest): each frame's values in order, missing ones last; and how many there are."""
    steps = np.arange(max(1, int((end - start).max(initial=0))))
    at = start[:, None] + steps
    held = np.sort(np.where(at < end[:, None], x[np.minimum(at, len(x) - 1)], np.nan), axis=1)
    return held, (~np.isnan(held)).sum(axis=1)


def quantile_of(held: np.ndarray, count: np.ndarray, q: float) -> np.ndarray:
    """``quantile`` of ``sorted_frames``."""
    rows, last = np.arange(len(held)), np.maximum(count - 1, 0)
    place = q * last
    low, high = held[rows, np.floor(place).astype(np.int64)], held[rows, np.ceil(place).astype(np.int64)]
    return low if q in (0, 1) else (low + high) / 2 if q == 0.5 else between(low, high, place)


def moments(x: np.ndarray, start: np.ndarray, end: np.ndarray, spread: bool = True) -> dict[str, np.ndarray]:
    """Mean and, with ``spread``, deviation and variance of the values (NaN: missing) in each of the frames ``start`` to ``end``.

    Every frame is summed from its first value on, all frames a value at a time (Welford). Equal frames so give equal results, whichever day
    or batch they lie in; sums that slide carry what earlier rows left, and z-scores that tie would be told apart by it.
    """
    n, total, mean, squares = (np.zeros(len(start)) for _ in range(4))
    for j in range(int((end - start).max(initial=0))):
        v = x[np.minimum(start + j, len(x) - 1)]
        there = (start + j < end) & ~np.isnan(v)
        n += there
        total += np.where(there, v, 0.0)
        if not spread:
            continue
        v = np.where(there, v, mean)  # adds nothing
        apart = v - mean
        mean += apart / np.maximum(n, 1)
        squares += (v - mean) * apart
    with np.errstate(divide="ignore", invalid="ignore"):
        if not spread:
            return {"mean": total / n}
        variance = np.where(n > 1, squares / (n - 1), np.nan)
        return {"mean": total / n, "std": np.sqrt(variance), "var": variance}


def frame_statistics(x: np.ndarray, start: np.ndarray, end: np.ndarray, before: int, wanted: dict[str, float | str]) -> dict[str, np.ndarray]:
    """Statistics of the frames ``start`` to ``end`` of the rows from ``before`` on: ``wanted`` maps a name to a quantile or one of ``moments``.

    The batch plan and the stream both take theirs from here, so that a row's do not hang on which of them it came through.
    """
    out, sums = {}, {q for q in wanted.values() if isinstance(q, str)}
    if sums:
        summed = moments(x, start[before:], end[before:], bool(sums - {"mean"}))
        out |= {name: summed[q] for name, q in wanted.items() if isinstance(q, str)}
    ranks = {name: q for name, q in wanted.items() if not isinstance(q, str)}
    if ranks and (end - start)[before:].max(initial=0) <= SHORT_FRAME:
        in_order = sorted_frames(x, start[before:], end[before:])
        out |= {name: quantile_of(*in_order, q) for name, q in ranks.items()}
    elif ranks:
        slid = pd.Series(x).rolling(Frames(start, end), min_periods=1)
        out |= {name: quantile(slid, q)[before:] for name, q in ranks.items()}
    return out


def with_frame_statistics(df: DataFrame, wanted: dict[str, tuple[str, int, float | str]], look_back_us: int, chunk_us: int, with_now: bool) -> DataFrame:
    """Statistics of the values within ``width`` before each row: ``wanted`` maps a name to (column, width, quantile or one of ``moments``).

    Rows must come day by day in order. Short frames are sorted whole, once for all their order statistics. Over longer ones a skip list slides:
    a row costs the logarithm of its frame, where sorting would cost more than its length. Only the last ``look_back_us`` of a day are held between batches.
    """
    ship(df.sparkSession)
    sources = sorted({c for c, _, _ in wanted.values()})
    apart = chunk_us + 2 * look_back_us

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.empty(0) for c in sources} | {c: np.empty(0, np.int64) for c in (*DAY, "us")}
        for b in batches:
            if not b.num_rows:
                continue
            before = len(held["us"])
            own = {c: b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in (*DAY, "us")} | {c: b[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in sources}
            x = {c: np.concatenate([held[c], own[c]]) for c in own}
            new = np.r_[False, (x["station_id"][1:] != x["station_id"][:-1]) | (x["chunk"][1:] != x["chunk"][:-1])]
            # Days are laid far enough apart that no frame reaches into another.
            at = np.cumsum(new) * apart + x["us"] - x["chunk"] * chunk_us + look_back_us
            if (np.diff(at) < 0).any():
                raise ValueError("rows of a day are not in order")
            added = {}
            for c, width in sorted({(c, w) for c, w, _ in wanted.values()}):
                start, end = np.searchsorted(at, at - width, "left"), np.searchsorted(at, at, "right" if with_now else "left")
                added |= frame_statistics(x[c], start, end, before, {name: q for name, (own_c, w, q) in wanted.items() if (own_c, w) == (c, width)})
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(added[name], pa.float64(), from_pandas=True) for name in wanted)], [*b.schema.names, *wanted])
            keep = at >= at[-1] - look_back_us
            held = {c: v[keep] for c, v in x.items()}

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name in wanted)]))


def run_counts(df: DataFrame, counters: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds counters: ``name`` maps to (reset, counted). A row that resets starts at its own count.

    Needs ``with_chunk``; both conditions must not be NULL.
    """
    w = in_day()
    names = list(counters)
    out = df.select("*", *(flag.cast("int").alias(f"_{kind}_{n}") for n, (reset, counted) in counters.items() for kind, flag in (("r", reset), ("k", counted))))
    out = out.select("*", *(F.sum(f"_k_{n}").over(w).alias(f"_s_{n}") for n in names))
    out = out.select("*", *(F.max(F.when(F.col(f"_r_{n}") == 1, F.col(f"_s_{n}") - F.col(f"_k_{n}"))).over(w).alias(f"_b_{n}") for n in names))
    own = {n: F.col(f"_s_{n}") - F.coalesce(f"_b_{n}", F.lit(0)) for n in names}
    days = out.groupBy(*DAY).agg(*(x for n in names for x in (F.max_by(own[n], "us").alias(f"t_{n}"), F.max(f"_r_{n}").alias(f"r_{n}"))))
    v = Window.partitionBy("station_id").orderBy("chunk")
    days = days.select("*", *(F.sum(f"t_{n}").over(v).alias(f"s_{n}") for n in names))
    days = days.select("*", *(F.max(F.when(F.col(f"r_{n}") == 1, F.col(f"s_{n}") - F.col(f"t_{n}"))).over(v).alias(f"b_{n}") for n in names))
    days = days.select(*DAY, *(F.lag(F.col(f"s_{n}") - F.coalesce(f"b_{n}", F.lit(0)), 1, 0).over(v).alias(f"_c_{n}") for n in names))
    joined = out.join(days, DAY)
    total = lambda n: own[n] + F.when(F.col(f"_b_{n}").isNull(), F.col(f"_c_{n}")).otherwise(0)
    return joined.select(*df.columns, *(total(n).cast("int").alias(n) for n in names))


def row_numbers(df: DataFrame, name: str = "row") -> DataFrame:
    """Adds the row's place within its station, from 1; needs ``with_chunk``."""
    return run_counts(df, {name: (F.lit(False), F.lit(True))})


def islands(df: DataFrame, change: Column) -> DataFrame:
    """Adds ``island``, the number of changes up to the row within its station; needs ``with_chunk``."""
    rows = df.withColumn("_change", change.cast("long"))
    days = rows.groupBy(*DAY).agg(F.sum("_change").alias("t"))
    v = Window.partitionBy("station_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(*DAY, F.coalesce(F.sum("t").over(v), F.lit(0)).alias("_before"))
    return rows.withColumn("_own", F.sum("_change").over(in_day())).join(before, DAY).select(*df.columns, (F.col("_own") + F.col("_before")).alias("island"))


def with_following(df: DataFrame, ahead_us: int, chunk_us: int = CHUNK_US) -> DataFrame:
    """Rows of each day and, with ``_halo`` true, those of the next day's first ``ahead_us`` (at most a day)."""
    early = F.col("us") % chunk_us <= ahead_us
    own, halo = F.struct(F.col("chunk").alias("c"), F.lit(False).alias("h")), F.struct((F.col("chunk") - 1).alias("c"), F.lit(True).alias("h"))
    spread = df.withColumn("_to", F.explode(F.when(early, F.array(own, halo)).otherwise(F.array(own))))
    return spread.withColumn("chunk", F.col("_to.c")).withColumn("_halo", F.col("_to.h")).drop("_to")
