"""Interval joins, anti-overlap, and differences of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_S = 86_400


def days_between(start: str, end: str) -> Column:
    return F.explode(F.sequence(F.to_date(start), F.to_date(end)))


def interval_join(rows: DataFrame, intervals: DataFrame, start: str, end: str, ts: str = "ts", keys: tuple[str, ...] = ("station_id",), how: str = "inner") -> DataFrame:
    """Rows with the intervals that hold their time, both ends included.

    Each interval is laid on the days it touches, so the join is an equality on (keys, day) with a filter: it hashes and
    spreads where a condition of only < and > would pair everything.
    """
    laid = intervals.withColumn("_day", days_between(start, end))
    condition = [rows[k] == laid[k] for k in keys]
    both = rows.withColumn("_row_day", F.to_date(ts))
    on = (F.col("_row_day") == F.col("_day")) & (F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))
    for c in condition:
        on = on & c
    out = both.join(laid, on, how)
    for k in keys:
        if how not in ("left_anti", "left_semi"):
            out = out.drop(laid[k])
    return out.drop("_row_day", "_day")


def without_overlap(new: DataFrame, old: DataFrame, start: str = "start_ts", end: str = "end_ts", keys: tuple[str, ...] = ("station_id",)) -> DataFrame:
    """Intervals of ``new`` that touch none of ``old`` with the same keys."""
    a = new.withColumn("_day", F.sequence(F.to_date(start), F.to_date(end))).withColumn("_day", F.explode("_day"))
    b = old.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).withColumn("_day", days_between("_s", "_e"))
    hit = a.join(b, [*keys, "_day"]).where((F.col("_s") <= F.col(end)) & (F.col("_e") >= F.col(start))).select(*new.columns).distinct()
    on = None
    for c in new.columns:
        same = new[c].eqNullSafe(hit[c])
        on = same if on is None else on & same
    return new.join(hit, on, "left_anti")


def table_difference(left: DataFrame, right: DataFrame, keys: list[str], rtol: float = 1e-5, atol: float = 1e-8, by: list[str] | None = None) -> DataFrame:
    """Per common column how many keys differ (doubles within atol + rtol |right|, the rest null-safe), and lone keys; a row for each value of the keys ``by``."""
    names = [c for c in left.columns if c in right.columns and c not in keys]
    a = left.select(*keys, *(F.col(c).alias(f"a_{c}") for c in names), F.lit(1).alias("_a"))
    b = right.select(*keys, *(F.col(c).alias(f"b_{c}") for c in names), F.lit(1).alias("_b"))
    both = a.join(b, keys, "full_outer")

    def differs(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if isinstance(left.schema[c].dataType, T.DoubleType | T.FloatType):
            close = F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), x.isNull() & y.isNull())
            return F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~close)
        return F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~x.eqNullSafe(y))

    return both.groupBy(*(by or [])).agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"), *(differs(c).alias(c) for c in names))
