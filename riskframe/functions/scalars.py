"""Null-safe scalar expressions. All of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column) -> Column:
    """Double, or NULL when the text does not parse. NaN becomes NULL too: ``NaN > x`` is true in Spark."""
    d = col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def finite(c: str | Column) -> Column:
    """The value, or NULL when it is infinite."""
    return F.when(F.abs(col(c)) != F.lit(float("inf")), col(c))


def clip(c: str | Column, low: float | None, high: float | None) -> Column:
    """Clamp to bounds; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    out = col(c)
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(col(c).isNotNull(), out)


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ratio(top: str | Column, bottom: str | Column) -> Column:
    """Division that yields NULL on a zero or NULL denominator."""
    return F.try_divide(col(top), col(bottom))


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2] ...``; NULL outside the edges."""
    value, out = col(c), None
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (value > F.lit(float(low))) & (value <= F.lit(float(high)))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def steps(c: str | Column, *, upto: Sequence[tuple[float, int]] = (), below: Sequence[tuple[float, int]] = (),
          above: int = 0) -> Column:
    """Points by threshold, first match wins: ``value <= t`` (``upto``) or ``value < t`` (``below``).

    A value past every threshold gets ``above``; NULL gets 0.
    """
    value, out = col(c), F.when(col(c).isNull(), 0)
    for limit, points in upto:
        out = out.when(value <= F.lit(float(limit)), points)
    for limit, points in below:
        out = out.when(value < F.lit(float(limit)), points)
    return out.otherwise(above)
