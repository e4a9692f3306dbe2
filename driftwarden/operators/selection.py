"""Exact quantiles by selection: a few passes over the values, with memory that does not grow with a group.

A group has one row of brackets, one for each rank that is asked for. A pass splits each bracket at 1,000 points of a sketch; the next counts
exactly what lies before, within and after the three strips around the rank, and the bracket becomes the part that holds it. After
each pair of passes a bracket holds about 1/300 of what it held, whatever the values are; one whose ends are equal is
done. What is left, ``kept`` values at most, is sorted. All sums are partial first, so a group with any share of the rows is no task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.session import drop, materialize

KEPT = 20_000
POINTS = 1_000


def exact_quantiles(df: DataFrame, column: str, by: Sequence[str], levels: Sequence[float], kept: int = KEPT, points: int = POINTS) -> DataFrame:
    """(``by``, q): the quantiles at ``levels`` with linear interpolation, an array; groups without values have no row.

    Null values do not count; null keys are a group.
    """
    keys = [f"_g{k}" for k in range(len(by))] or ["_g0"]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias("_g0")]
    rows = materialize(df.select(*named, F.col(column).cast("double").alias("_x")).where("_x IS NOT NULL"), "values")
    x, size = F.col("_x"), 2 * len(levels)
    each = lambda make: F.array(*(make(k) for k in range(size)))
    totals = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in levels]
    ranks = F.array(*(y.cast("long") for p in place for y in (F.floor(p), F.ceil(p))))
    state = materialize(totals.select(*keys, "_n", ranks.alias("rank"), each(lambda _: F.col("_lo")).alias("lo"), each(lambda _: F.col("_hi")).alias("hi"), each(lambda _: F.lit(0).cast("long")).alias("below"), each(lambda _: F.col("_n")).alias("inside")), "brackets")

    def at(k: int, name: str) -> Column:
        return F.col(name)[k]

    def unsettled(k: int) -> Column:
        return (at(k, "inside") > kept) & (at(k, "lo") < at(k, "hi"))

    def joined(some: DataFrame) -> DataFrame:
        on = [rows[k].eqNullSafe(some[k]) for k in keys]
        return rows.join(some, on).select(*(rows[k] for k in keys), "_x", *(some[c] for c in some.columns if c not in keys))

    first = True
    while True:
        todo = state.where(F.exists(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (F.get("inside", k) > kept) & (F.get("lo", k) < F.get("hi", k))), lambda y: y))
        if todo.isEmpty():
            break
        sketch = lambda v: F.percentile_approx(v, F.array(*(F.lit(j / points) for j in range(points + 1))), 10 * points)
        near = joined(todo)
        inside = [x.between(at(k, "lo"), at(k, "hi")) & unsettled(k) for k in range(size)]
        if first:  # all brackets are the whole group
            cut = near.groupBy(*keys).agg(sketch(x).alias("_s")).select(*keys, each(lambda _: F.col("_s")).alias("_s"))
        else:
            cut = near.groupBy(*keys).agg(*(sketch(F.when(inside[k], x)).alias(f"_s{k}") for k in range(size))).select(*keys, each(lambda k: F.col(f"_s{k}")).alias("_s"))
        strip = lambda k: F.floor((at(k, "rank") - at(k, "below")) * points / at(k, "inside")).cast("int")
        split_at = lambda k, j: F.get(F.get("_s", F.lit(k)), F.greatest(F.least(j, F.lit(points)), F.lit(0)))
        # Strips that are the whole bracket (few distinct values) would settle nothing: then one value is the strip.
        all_of = lambda k: (split_at(k, strip(k) - 1) <= at(k, "lo")) & (split_at(k, strip(k) + 2) >= at(k, "hi"))
        low = each(lambda k: split_at(k, F.when(all_of(k), strip(k)).otherwise(strip(k) - 1)))
        high = each(lambda k: split_at(k, F.when(all_of(k), strip(k)).otherwise(strip(k) + 2)))
        joint = [todo[k].eqNullSafe(cut[k]) for k in keys]
        split = todo.join(cut, joint).select(*(todo[c] for c in todo.columns), low.alias("a"), high.alias("b"))
        split = materialize(split, "splits")
        sums = []
        for k in range(size):
            before, after = inside[k] & (x < at(k, "a")), inside[k] & (x > at(k, "b"))
            mid = inside[k] & x.between(at(k, "a"), at(k, "b"))
            sums += [F.count_if(before).alias(f"n0_{k}"), F.count_if(mid).alias(f"n1_{k}"), F.max(F.when(before, x)).alias(f"h0_{k}"), F.min(F.when(mid, x)).alias(f"l1_{k}"), F.max(F.when(mid, x)).alias(f"h1_{k}"), F.min(F.when(after, x)).alias(f"l2_{k}")]
        counts = joined(split).groupBy(*keys).agg(*sums)
        both = split.join(counts, [split[k].eqNullSafe(counts[k]) for k in keys]).select(*(split[c] for c in split.columns), *(c for c in counts.columns if c not in keys))

        def part(k: int, before: Column, mid: Column, after: Column, else_: Column) -> Column:
            r = at(k, "rank") - at(k, "below")
            n0, n1 = F.col(f"n0_{k}"), F.col(f"n1_{k}")
            return F.when(~unsettled(k), else_).when(r < n0, before).when(r < n0 + n1, mid).otherwise(after)

        n0, n1 = (lambda k: F.col(f"n0_{k}")), (lambda k: F.col(f"n1_{k}"))
        moved = both.select(
            *keys, "_n", "rank",
            each(lambda k: part(k, at(k, "lo"), F.col(f"l1_{k}"), F.col(f"l2_{k}"), at(k, "lo"))).alias("lo"),
            each(lambda k: part(k, F.col(f"h0_{k}"), F.col(f"h1_{k}"), at(k, "hi"), at(k, "hi"))).alias("hi"),
            each(lambda k: part(k, at(k, "below"), at(k, "below") + n0(k), at(k, "below") + n0(k) + n1(k), at(k, "below"))).alias("below"),
            each(lambda k: part(k, n0(k), n1(k), at(k, "inside") - n0(k) - n1(k), at(k, "inside"))).alias("inside"),
        )
        settled = state.join(todo.select(*keys), [state[k].eqNullSafe(todo[k]) for k in keys], "left_anti")
        last, state, first = state, materialize(settled.unionByName(moved), "brackets"), False
        drop(last, split)
    open_ = [at(k, "lo") < at(k, "hi") for k in range(size)]
    left = joined(state).groupBy(*keys, "_n", "rank", "lo", "hi", "below").agg(*(F.collect_list(F.when(open_[k] & x.between(at(k, "lo"), at(k, "hi")), x)).alias(f"v{k}") for k in range(size)))
    value = lambda k: F.when(open_[k], F.get(F.sort_array(f"v{k}"), (at(k, "rank") - at(k, "below")).cast("int"))).otherwise(at(k, "lo"))
    part_of = [p - F.floor(p) for p in place]
    q = F.array(*(value(2 * i) + part_of[i] * (value(2 * i + 1) - value(2 * i)) for i in range(len(levels))))
    out = materialize(left.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), q.alias("q")), "quantiles")
    drop(rows, state)
    return out


def with_quantiles(table: DataFrame, df: DataFrame, column: str, by: Sequence[str], names: dict[str, float]) -> DataFrame:
    """``table`` (a row a group of ``by``) with the quantiles of ``df`` under ``names``; null for a group without values."""
    found = exact_quantiles(df, column, by, list(names.values()))
    on = [table[c].eqNullSafe(found[c]) for c in by]
    columns = [F.get(found["q"], F.lit(k)).alias(n) for k, n in enumerate(names)]
    return table.join(found, on, "left").select(*(table[c] for c in table.columns), *columns) if by else table.join(found, F.lit(True), "left").select(*table.columns, *columns)
