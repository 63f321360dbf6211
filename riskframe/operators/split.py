"""Exact, repeatable splits.

A row's place is decided by the hash of its key. The rank where a split ends is turned into one hash
threshold per stratum (an exact order statistic, found without sorting rows), so assigning rows is a
projection: no row is shuffled, a class that holds most rows costs nothing extra, and new data or a
stream can be assigned with the same thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from .quantiles import order_statistics

EVERYTHING = "*"


@dataclass(frozen=True)
class Threshold:
    """Rows up to here in (hash, key) order are inside. ``key`` matters only for equal hashes."""

    hash: int
    key: object = None

    def past(self, value: Column, key: Column) -> Column:
        if self.key is None:
            return value > F.lit(self.hash)
        return (value > F.lit(self.hash)) | ((value == F.lit(self.hash)) & (key > F.lit(self.key)))


@dataclass(frozen=True)
class Cuts:
    """Ordered thresholds per stratum; a row's part is the number of thresholds it lies past."""

    seed: int
    key: str
    stratum: str | None
    at: Mapping[str | None, Sequence[Threshold]]  # rows without a class are a stratum of their own

    @classmethod
    def fit(cls, df: DataFrame, key: str, seed: int, steps: Sequence[tuple[float, Callable[[int], int]]],
            stratum: str | None = None) -> Cuts:
        """``steps`` gives each threshold's approximate share and its exact rank as a function of the row count."""
        slot = F.col(stratum).cast("string") if stratum else F.lit(EVERYTHING)
        value = hash32(seed, key)
        rank_of = {p: f for p, f in steps}
        counts, found = order_statistics(
            df.select(slot.alias("slot"), value.alias("value")), list(rank_of), lambda _s, p, n: [rank_of[p](n)])
        at: dict[str, list[Threshold]] = {}
        for name, n in counts.items():
            at[name] = []
            for _, f in steps:
                r = f(n)
                if r <= 0:
                    at[name].append(Threshold(-1))
                    continue
                stat = found[(name, min(r, n))]
                inside = min(r, n) - stat.below
                if inside == stat.equal:
                    at[name].append(Threshold(stat.value))
                else:  # equal hashes straddle the cut: order those few rows by key
                    same = (df.where(slot.eqNullSafe(F.lit(name)) & (value == F.lit(stat.value))).select(key)
                            .orderBy(key).limit(inside).collect())
                    at[name].append(Threshold(stat.value, same[-1][0]))
        return cls(seed, key, stratum, at)

    def part(self) -> Column:
        value, key = hash32(self.seed, self.key), F.col(self.key)
        out = F.lit(None).cast("int")
        for name, cuts in self.at.items():
            count = F.lit(0)
            for t in cuts:
                count = count + t.past(value, key).cast("int")
            if self.stratum is None:
                return count
            out = F.when(F.col(self.stratum).cast("string").eqNullSafe(F.lit(name)), count).otherwise(out)
        return out


def _name(part: Column, names: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), part)


def nearest_count(share: float, n: int) -> int:
    return math.floor(share * n + 0.5)


def _three(test: float, validation: float):
    def first(n: int) -> int:
        return nearest_count(test, n)

    def second(n: int) -> int:
        return first(n) + nearest_count(validation / (1.0 - test), n - first(n))

    return [(test, first), (test + validation, second)]


def stratified(df: DataFrame, y: str, key: str, test: float = 0.15, validation: float = 0.15, seed: int = 42
               ) -> DataFrame:
    """Adds ``split``: test, then validation out of the rest, then train, with equal class shares."""
    cuts = Cuts.fit(df, key, seed, _three(test, validation), y)
    return df.withColumn("split", _name(cuts.part(), ["test", "validation", "train"]))


def halves(df: DataFrame, y: str, key: str, share: float = 0.5, names: Sequence[str] = ("select", "calibrate"),
           seed: int = 43, column: str = "split") -> DataFrame:
    """Stratified two-way split, used to divide the validation rows once more."""
    cuts = Cuts.fit(df, key, seed, [(share, lambda n: nearest_count(share, n))], y)
    return df.withColumn(column, _name(cuts.part(), names))


def grouped(df: DataFrame, group: str, test: float = 0.15, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """All rows of one group land on one side; shares count groups."""
    cuts = Cuts.fit(df.select(group).distinct(), group, seed, _three(test, validation))
    return df.withColumn("split", _name(cuts.part(), ["test", "validation", "train"]))


def temporal(df: DataFrame, ts: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Earliest rows train, latest rows test; rows of one instant stay together, rows without one get no split.

    Instants are compared as microseconds since the epoch, whatever the time zones of session and driver. An empty table, or one
    without instants, gets the column with nothing in it.
    """
    when = F.unix_micros(F.col(ts).cast("timestamp")) if df.schema[ts].dataType.typeName().startswith("timestamp") else F.col(ts)
    steps = {train: lambda n: nearest_count(train, n),
             train + validation: lambda n: nearest_count(train + validation, n)}
    _, found = order_statistics(df.select(F.lit(EVERYTHING).alias("slot"), when.alias("value")), list(steps),
                                lambda _s, p, n: [steps[p](n)])
    if not found:
        return df.withColumn("split", F.lit(None).cast("string"))
    edges = sorted(s.value for s in found.values())
    return df.withColumn("split", F.when(when <= F.lit(edges[0]), "train").when(when <= F.lit(edges[-1]), "validation")
                         .when(when.isNotNull(), "test"))


def kfold(df: DataFrame, y: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1; fold sizes differ by at most one row inside every class."""
    steps = [(i / k, lambda n, i=i: (i * n) // k) for i in range(1, k)]
    return df.withColumn("fold", Cuts.fit(df, key, seed, steps, y).part())


def nested_samples(df: DataFrame, key: str, shares: Sequence[float], seed: int = 42) -> DataFrame:
    """Adds ``step``: the first of the growing samples that holds the row (shares ascending, last one 1)."""
    steps = [(s, lambda n, s=s: nearest_count(s, n)) for s in shares[:-1]]
    return df.withColumn("step", Cuts.fit(df, key, seed, steps).part())


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows: the n smallest hashes, kept as a top-n per task."""
    return df.orderBy(hash32(seed, key), F.col(key)).limit(n)


def check(df: DataFrame, y: str, split: str = "split") -> DataFrame:
    """Class counts and shares inside each split."""
    return (df.groupBy(split, y).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split))))
