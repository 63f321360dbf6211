"""Outlier reports and their treatment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip
from . import quantiles

FENCE = 1.5
Z_LIMIT = 3.0
WINSOR_P = 0.99
TREAT_PCT = 10.0


def _long(row: DataFrame, per_column: Mapping[str, Sequence]) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), *cells)
                                          for c, cells in per_column.items()])).alias("r")).select("r.*")


def outliers_iqr(df: DataFrame, columns: Sequence[str], accuracy: int | None = None,
                 quartiles: Mapping[str, Sequence[float | None]] | None = None) -> DataFrame:
    """Fences at 1.5 interquartile ranges and how many rows lie strictly outside them; known quartiles are not read again."""
    q = quartiles or quantiles.quantiles(df, columns, [0.25, 0.75], accuracy)
    fences = {}
    for c in columns:
        q1, q3 = q[c]
        width = None if q1 is None else FENCE * (q3 - q1)
        fences[c] = (q1, q3, None if q1 is None else q1 - width, None if q1 is None else q3 + width)
    outside = [F.count_if((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))).alias(c)
               for c, (_, _, lo, hi) in fences.items()]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *outside)

    def num(v):
        return F.lit(v).cast("double")

    return _long(row, {c: (num(q1).alias("q1"), num(q3).alias("q3"), num(lo).alias("lower"), num(hi).alias("upper"),
                           F.col(c).alias("iqr_outliers"),
                           F.try_divide(F.col(c) * F.lit(100.0), F.col("_n")).alias("iqr_pct"))
                       for c, (q1, q3, lo, hi) in fences.items()})


def outliers_z(df: DataFrame, columns: Sequence[str], accuracy: int | None = None,
               medians: Mapping[str, float | None] | None = None) -> DataFrame:
    """Rows more than three population deviations from the mean, gaps taken as the median; known medians are not read again."""
    fill = {c: m for c, m in (medians or quantiles.medians(df, columns, accuracy)).items() if m is not None}
    filled = df.select(*[F.coalesce(F.col(c), F.lit(m)).alias(c) for c, m in fill.items()])
    stats = filled.agg(*[F.avg(c).alias(f"{c}_m") for c in fill], *[F.stddev_pop(c).alias(f"{c}_s") for c in fill]
                       ).first()
    counts = [F.count_if(F.abs(F.try_divide(F.col(c) - F.lit(stats[f"{c}_m"]), F.lit(stats[f"{c}_s"]))) > Z_LIMIT
                         ).alias(c) for c in fill]
    row = filled.agg(F.count(F.lit(1)).alias("_n"), *counts)
    return _long(row, {c: (F.col(c).alias("z_outliers"),
                           F.try_divide(F.col(c) * F.lit(100.0), F.col("_n")).alias("z_pct")) for c in fill})


def outlier_report(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Both counts per feature, worst fence share first, with marks for more than 10% and 20%."""
    q = quantiles.quantiles(df, columns, [0.25, 0.5, 0.75], accuracy)
    both = outliers_iqr(df, columns, quartiles={c: (v[0], v[2]) for c, v in q.items()}).join(
        F.broadcast(outliers_z(df, columns, medians={c: v[1] for c, v in q.items()})), "feature")  # one row per feature
    return both.select(
        "feature", "iqr_outliers", "iqr_pct", "z_outliers", "z_pct",
        (F.col("iqr_pct") > 10).cast("int").alias("over_10"), (F.col("iqr_pct") > 20).cast("int").alias("over_20"),
    ).orderBy(F.desc("iqr_pct"), "feature")


@dataclass(frozen=True)
class Winsor:
    """Fitted bounds per treated feature."""

    bounds: Mapping[str, tuple[float, float]]
    share: Mapping[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], p: float = WINSOR_P, over_pct: float = TREAT_PCT,
            accuracy: int | None = None) -> Winsor:
        """Bounds at the 1-p and p quantiles for features with more than ``over_pct`` % outside the fences."""
        q = quantiles.quantiles(df, columns, [1 - p, 0.25, 0.75, p], accuracy)
        share = {r["feature"]: r["iqr_pct"] for r in outliers_iqr(df, columns, quartiles={c: v[1:3] for c, v in q.items()}).collect()}
        treat = [c for c in columns if share[c] is not None and share[c] > over_pct]
        return cls({c: (q[c][0], q[c][3]) for c in treat if q[c][0] is not None}, share)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in self.bounds.items()})

    def log(self, df: DataFrame) -> DataFrame:
        rows = [(c, "winsorize", lo, hi, self.share[c]) for c, (lo, hi) in self.bounds.items()]
        return df.sparkSession.createDataFrame(
            rows, "feature string, method string, lower double, upper double, iqr_pct double")


def positive_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose every row holds a value above zero."""
    row = df.agg(*[((F.min(c) > 0) & (F.count(F.col(c)) == F.count(F.lit(1)))).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def log1p_if_positive(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """log(1+x) where the whole column is positive; the log says what was really transformed."""
    good = set(positive_columns(df, columns))
    log = df.sparkSession.createDataFrame([(c, c in good) for c in columns], "feature string, transformed boolean")
    return df.withColumns({c: F.log1p(c) for c in columns if c in good}), log
