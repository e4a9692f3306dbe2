"""Column functions with the missing-value rules of the engine: NULL is missing, NaN never leaves a source."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bounded(x: str | Column, k: float) -> Column:
    """1 - exp(-x / k): maps 0.. to 0..1."""
    return 1 - F.exp(-col(x) / k)


def clip(x: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def safe_divisor(x: str | Column, least: float = 1e-6) -> Column:
    """``x``, or ``least`` where it is missing or smaller."""
    return F.when(col(x).isNull() | (col(x) < least), F.lit(least)).otherwise(col(x))


def zero(x: str | Column) -> Column:
    return F.coalesce(col(x), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def greatest_known(columns: Iterable[Column]) -> Column:
    """The greatest of the values that are there."""
    return F.greatest(*columns)


def greatest_or_null(columns: Iterable[Column]) -> Column:
    """The greatest, or NULL as soon as one is missing."""
    items = list(columns)
    unknown = items[0].isNull()
    for c in items[1:]:
        unknown = unknown | c.isNull()
    return F.when(~unknown, F.greatest(*items))


def rounded(x: str | Column, digits: int = 4) -> Column:
    """Half up by floor: the same doubles in any engine."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + 0.5).cast("double") / scale


def known(x: str | Column) -> Column:
    """NULL for NaN."""
    return F.when(~F.isnan(col(x)), col(x))


def case(pairs: Iterable[tuple[Column, object]], default: object) -> Column:
    """First value whose condition holds."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def first_greatest(named: list[tuple[object, Column]]) -> Column:
    """Name of the greatest value, the first one on ties; values must be there."""
    top = F.greatest(*(c for _, c in named))
    return case(((c == top, name) for name, c in named), None)
