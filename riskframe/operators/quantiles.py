"""Exact order statistics without a full sort and without one task holding every value.

Spark's exact ``percentile`` merges a value->count map of the whole column in one reducer, which a
continuous column outgrows. Here a quantile sketch (with its guaranteed rank error) first brackets
each wanted rank; then only the values inside the bracket are counted, distributed by value. The
sketch is repeated inside brackets that are still wide, so the last step sees a bounded histogram.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .schema import unpivot

ACCURACY = 10_000  # sketch accuracy: rank error at most rows / ACCURACY
MARGIN = 2.0 / ACCURACY  # bracket half width; twice the sketch error
FEW_VALUES = 50_000  # columns with about this many values or fewer use the built-in exact percentile
WHOLE_ROWS = 200_000  # a slot with no more rows than this is counted whole
BRACKET_ROWS = 2_000_000  # a bracket that may hold more rows than this is narrowed again


@dataclass
class Bracket:
    slot: str | None
    ranks: list[int]
    low: object = None  # None: open
    high: object = None
    rows: float = 0.0


@dataclass(frozen=True)
class Stat:
    value: object
    below: int  # rows with a smaller value
    equal: int  # rows with this value


def order_statistics(
    long: DataFrame, probs: Sequence[float], ranks_of: Callable[[str, float, int], Iterable[int]]
) -> tuple[dict[str, int], dict[tuple[str, int], Stat]]:
    """Exact ranked values per slot of ``long(slot, value)``.

    ``ranks_of(slot, prob, n)`` names the 1-based ranks wanted near each probability once the
    non-null count ``n`` is known. Returns the counts and a Stat per (slot, rank).
    """
    long = long.where(F.col("value").isNotNull())
    grid = [b for p in probs for b in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    heads = (long.groupBy("slot")
             .agg(F.count("value").alias("n"), F.percentile_approx("value", grid, ACCURACY).alias("g")).collect())
    counts = {h["slot"]: h["n"] for h in heads}
    brackets: list[Bracket] = []
    for h in heads:
        n, per_prob = h["n"], []
        for i, p in enumerate(probs):
            ranks = sorted({min(max(r, 1), n) for r in ranks_of(h["slot"], p, n)})
            per_prob.append(Bracket(h["slot"], ranks, h["g"][2 * i], h["g"][2 * i + 1], 3 * MARGIN * n))
        if n <= WHOLE_ROWS:
            brackets.append(Bracket(h["slot"], sorted({r for b in per_prob for r in b.ranks}), rows=n))
        else:
            brackets += per_prob
    _narrow(long, brackets)
    return counts, _read(long, brackets)


def _inside(b: Bracket):
    return F.col("slot").eqNullSafe(F.lit(b.slot)) & (F.col("value") >= F.lit(b.low)) & (F.col("value") <= F.lit(b.high))


def _narrow(long: DataFrame, brackets: list[Bracket]) -> None:
    while True:
        wide = [b for b in brackets if b.rows > BRACKET_ROWS and b.low is not None and b.low < b.high]
        if not wide:
            return
        sizes = long.agg(
            *[F.count_if(F.col("slot").eqNullSafe(F.lit(b.slot)) & (F.col("value") < F.lit(b.low))).alias(f"below{i}")
              for i, b in enumerate(wide)],
            *[F.count_if(_inside(b)).alias(f"within{i}") for i, b in enumerate(wide)],
        ).first()
        spans = []
        for i, b in enumerate(wide):
            below, within = sizes[f"below{i}"], max(sizes[f"within{i}"], 1)
            low = max(0.0, (b.ranks[0] - below) / within - MARGIN)
            high = min(1.0, (b.ranks[-1] - below) / within + MARGIN)
            spans.append([low, high])
        cuts = long.agg(*[
            F.percentile_approx(F.when(_inside(b), F.col("value")), span, ACCURACY).alias(f"cut{i}")
            for i, (b, span) in enumerate(zip(wide, spans, strict=True))
        ]).first()
        for i, b in enumerate(wide):
            low, high = cuts[f"cut{i}"]
            # no narrower: the span is made of few, heavily repeated values
            b.rows = 0.0 if (low, high) == (b.low, b.high) else 3 * MARGIN * sizes[f"within{i}"]
            b.low, b.high = low, high


def _histogram(long: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """(bracket, value, equal) over the bracketed values; smaller values are counted under a NULL value.

    A bracket is known by its number alone, so that no slot's name can be taken for another bracket's; a NULL slot is a slot.
    """
    value_type = long.schema["value"].dataType
    frame = StructType([
        StructField("_slot", StringType()), StructField("bracket", IntegerType()),
        StructField("low", value_type), StructField("high", value_type),
    ])
    rows = [(b.slot, i, b.low, b.high) for i, b in enumerate(brackets)]
    windows = long.sparkSession.createDataFrame(rows, frame)  # at most slots x probabilities rows
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    return (
        long.join(F.broadcast(windows), F.col("slot").eqNullSafe(F.col("_slot")))
        .where(high.isNull() | (value <= high))
        .select("bracket", F.when(low.isNull() | (value >= low), value).alias("value"))
        .groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("equal"))
    )


def _read(long: DataFrame, brackets: list[Bracket]) -> dict[tuple[str | None, int], Stat]:
    if not brackets:
        return {}
    wanted = long.sparkSession.createDataFrame(
        [(i, r) for i, b in enumerate(brackets) for r in b.ranks], "bracket int, rank bigint")
    below = Window.partitionBy("bracket").orderBy(F.col("value").asc_nulls_first())
    hits = (
        _histogram(long, brackets)
        .withColumn("below", F.sum("equal").over(below) - F.col("equal"))
        .join(F.broadcast(wanted), "bracket")
        .where((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("equal")))
        .collect()  # one row per wanted rank
    )
    return {(brackets[h["bracket"]].slot, h["rank"]): Stat(h["value"], h["below"], h["equal"]) for h in hits}


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
              accuracy: int | None = None) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns, NULLs ignored.

    Exact by default; ``accuracy`` switches to the one-pass sketch with rank error rows/accuracy.
    """
    columns = list(columns)
    if not columns:
        return {}
    if accuracy:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy).alias(c)
                       for c in columns]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}

    row = df.agg(*[F.count(F.col(c)).alias(f"{c}_n") for c in columns],
                 *[F.approx_count_distinct(c).alias(f"{c}_u") for c in columns]).first()
    few = [c for c in columns if row[f"{c}_n"] <= WHOLE_ROWS or row[f"{c}_u"] <= FEW_VALUES]
    out = {}
    if few:  # the value -> count map of these columns is small
        exact = df.agg(*[F.percentile(c, list(probs)).alias(c) for c in few]).first()
        out = {c: exact[c] if exact[c] is not None else [None] * len(probs) for c in few}
    many = [c for c in columns if c not in few]
    if many:
        out.update(_ranked_quantiles(df, many, probs))
    return out


def _ranked_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    def ranks(_slot: str, p: float, n: int) -> set[int]:
        at = p * (n - 1)
        return {math.floor(at) + 1, math.ceil(at) + 1}

    counts, found = order_statistics(unpivot(df, columns, "slot"), probs, ranks)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        n, values = counts.get(c, 0), []
        for p in probs:
            if n == 0:
                values.append(None)
                continue
            at = p * (n - 1)
            low = found[(c, math.floor(at) + 1)].value
            high = found[(c, math.ceil(at) + 1)].value
            values.append(low + (high - low) * (at - math.floor(at)))
        out[c] = values
    return out


def medians(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, columns, [0.5], accuracy).items()}
