"""Keyed randomness: draws depend on (seed, key) alone, never on partitioning or run order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col

SPAN = 4294967296.0  # number of 32-bit values

# Cumulative Poisson(1) probabilities.
POISSON_STEPS = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917)


def digest(seed: int | str, *keys: str | Column) -> Column:
    parts: list[Column] = [F.lit(str(seed))]
    for key in keys:
        parts += [F.lit("|"), col(key).cast("string")]
    return F.md5(F.concat(*parts))


def word(text: Column, index: int = 0) -> Column:
    """The ``index``-th 32-bit word (0-3) of a hex digest as a bigint."""
    return F.conv(F.substring(text, 1 + 8 * index, 8), 16, 10).cast("bigint")


def hash32(seed: int | str, *keys: str | Column) -> Column:
    return word(digest(seed, *keys))


def uniform(value: Column) -> Column:
    """[0, 1) from a 32-bit word."""
    return value / F.lit(SPAN)


def poisson1(u: Column, steps: Iterable[float] = POISSON_STEPS) -> Column:
    """Poisson(1) draw: how many cumulative steps the uniform reaches.

    The steps end at 7: the one draw in 98,000 that would be larger counts 7, which lowers a total by about 0.001 %."""
    total = F.lit(0)
    for step in steps:
        total = total + (u >= F.lit(step)).cast("int")
    return total
