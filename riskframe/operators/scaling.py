"""Robust, standard and min-max scaling: fit reads one row of statistics, apply is a projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quantiles
from .schema import roles


@dataclass(frozen=True)
class Scaler:
    center: Mapping[str, float | None]
    scale: Mapping[str, float | None]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], method: str = "robust",
            accuracy: int | None = None) -> Scaler:
        """``robust`` (median, IQR), ``minmax``, or ``standard`` (also for any other name). Zero width scales by 1."""
        center, scale = {}, {}
        if method == "robust":
            for c, (q1, mid, q3) in quantiles.quantiles(df, columns, [0.25, 0.5, 0.75], accuracy).items():
                center[c], scale[c] = mid, None if q1 is None else q3 - q1
        elif columns:
            a, b = (F.min, F.max) if method == "minmax" else (F.avg, F.stddev_pop)
            row = df.agg(*[a(c).alias(f"{c}_a") for c in columns], *[b(c).alias(f"{c}_b") for c in columns]).first()
            for c in columns:
                at, width = row[f"{c}_a"], row[f"{c}_b"]
                center[c] = at
                scale[c] = width - at if method == "minmax" and at is not None else width
        return cls(center, {c: 1.0 if w == 0 else w for c, w in scale.items()})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(float(m))) / F.lit(float(self.scale[c]))
                               for c, m in self.center.items() if m is not None})

    def state(self) -> dict:
        return {"center": dict(self.center), "scale": dict(self.scale)}


def scalable_columns(df: DataFrame, target: str | None, keys: Sequence[str] = ()) -> list[str]:
    """Numeric columns with more than two values that are neither target, key nor missing-indicator.

    Minimum and maximum come first; a third value exists exactly when some value is neither of them.
    Two narrow scans, no distinct sets.
    """
    numeric = [c for c in roles(df, target, keys).numeric if not c.endswith("_was_missing")]
    if not numeric:
        return []
    ends = df.agg(*[F.min(c).alias(f"{c}_a") for c in numeric], *[F.max(c).alias(f"{c}_b") for c in numeric]).first()
    open_ = [c for c in numeric if ends[f"{c}_a"] is not None and ends[f"{c}_a"] < ends[f"{c}_b"]]
    if not open_:
        return []
    third = df.agg(*[F.coalesce(F.bool_or((F.col(c) != F.lit(ends[f"{c}_a"])) & (F.col(c) != F.lit(ends[f"{c}_b"]))),
                                F.lit(False)).alias(c) for c in open_]).first()
    return [c for c in open_ if third[c]]
