"""Feature cleaning, collinearity, and the clinical feature bundle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions.scalars import cut, finite, flag, to_number
from . import quantiles

VARIANCE_FLOOR = 1e-6
VIF_LIMIT = 10.0
# Bands of the inflation factor.
VIF_EDGES = (0.0, 5.0, 10.0, 100.0, float("inf"))
VIF_LABELS = ("Low (<5)", "Moderate (5-10)", "High (10-100)", "Severe (>100)")
GRAM_IN_SQL = 24  # columns up to which the products are plain aggregate expressions


def variances(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return df.agg(*[F.var_samp(c).alias(c) for c in columns]).first().asDict()


def variance_filter(df: DataFrame, columns: Sequence[str], eps: float = VARIANCE_FLOOR) -> list[str]:
    """Columns whose sample variance exceeds ``eps``; a column without variance (all NULL, one row) goes."""
    found = variances(df, columns)
    return [c for c in columns if found[c] is not None and found[c] > eps]


def fit_clean(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> dict[str, float]:
    """Fill values for ``clean_numeric``: medians of the finite values, 0 for an empty column."""
    tidy = df.select(*[finite(c).alias(c) for c in columns])
    return {c: 0.0 if v is None else v for c, v in quantiles.medians(tidy, columns, accuracy).items()}


def clean_numeric(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    """Infinite or missing values become the fitted fill."""
    return df.withColumns({c: F.coalesce(finite(c), F.lit(v)) for c, v in fills.items()})


def gram(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Sums of products of all column pairs in one scan; the driver receives d x d numbers."""
    columns, d = list(columns), len(columns)
    out = np.zeros((d, d))
    if d <= GRAM_IN_SQL:
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        row = df.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            out[i, j] = out[j, i] = row[f"p{i}_{j}"] or 0.0
        return out

    def partial(frames):
        total = np.zeros((d, d))
        for f in frames:
            x = f.to_numpy(dtype=float)
            total += x.T @ x
        import pandas as pd

        i, j = np.triu_indices(d)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    sums = (df.select(*[F.col(c).cast("double").alias(c) for c in columns])
            .mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")))
    for r in sums.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def vif_from_gram(g: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Uncentred inflation factors from a Gram matrix.

    Columns that take part in a linear dependency are infinite; every other column has its factor over all columns, which the
    pseudo-inverse gives. A column of zeros is infinite and leaves the others alone.
    """
    out = np.full(len(g), np.inf)
    root = np.sqrt(np.diag(g))
    used = np.flatnonzero(root > 0)
    if not len(used):
        return out
    unit = g[np.ix_(used, used)] / np.outer(root[used], root[used])  # same factors, far better conditioned
    value, vector = np.linalg.eigh(unit)
    null = value <= tolerance * value[-1]
    dependent = (vector[:, null] ** 2).sum(axis=1) > 1e-8
    inverse = (vector[:, ~null] ** 2 / value[~null]).sum(axis=1)
    out[used] = np.where(dependent, np.inf, inverse)
    return out


@dataclass(frozen=True)
class Collinearity:
    columns: list[str]
    gram: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> Collinearity:
        """Constant columns are left out, gaps take the median; one Gram pass serves every later step."""
        kept = variance_filter(df, columns)
        tidy = clean_numeric(df.select(*kept), fit_clean(df, kept, accuracy))
        return cls(kept, gram(tidy, kept))

    def vif(self, keep: Sequence[str] | None = None) -> dict[str, float]:
        keep = self.columns if keep is None else list(keep)
        at = [self.columns.index(c) for c in keep]
        return dict(zip(keep, vif_from_gram(self.gram[np.ix_(at, at)]).tolist(), strict=True))

    def eliminate(self, limit: float = VIF_LIMIT, protect: Sequence[str] = (), max_iter: int = 50
                  ) -> tuple[list[str], list[tuple[int, str, float]]]:
        """Drop the worst unprotected column above ``limit``, recompute from the same Gram matrix, repeat.

        Of equally bad columns, as several infinite ones, the first in table order goes."""
        keep, removed = list(self.columns), []
        for step in range(1, max_iter + 1):
            factors = {c: v for c, v in self.vif(keep).items() if c not in protect and v > limit}
            if not factors:
                break
            worst = max(factors, key=factors.get)
            keep.remove(worst)
            removed.append((step, worst, factors[worst]))
        return keep, removed


def vif(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    factors = Collinearity.fit(df, columns, accuracy).vif()
    frame = df.sparkSession.createDataFrame(list(factors.items()), "feature string, vif double")
    return frame.withColumn("vif_category", cut("vif", VIF_EDGES, VIF_LABELS)).orderBy(F.desc("vif"), "feature")


def vif_bands(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    return vif(df, columns, accuracy).groupBy("vif_category").agg(F.count(F.lit(1)).alias("n"))


def drop_collinear(df: DataFrame, columns: Sequence[str], limit: float = VIF_LIMIT, protect: Sequence[str] = (),
                   max_iter: int = 50, accuracy: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The table without the eliminated columns, and the removal log."""
    _, removed = Collinearity.fit(df, columns, accuracy).eliminate(limit, protect, max_iter)
    log = df.sparkSession.createDataFrame(removed, "step int, feature string, vif double")
    return df.drop(*[name for _, name, _ in removed]), log


# ---- clinical bundle ------------------------------------------------------------------------------------


def early_warning(df: DataFrame) -> DataFrame:
    """Sub-scores of four vitals and their sum; needs all five vitals in the table."""
    if not {"hr", "sbp", "spo2", "temp", "gcs"} <= set(df.columns):
        return df
    df = df.withColumns({"hr_risk_score": C.hr_points(), "sbp_risk_score": C.sbp_points(),
                         "spo2_risk_score": C.spo2_points(), "temp_risk_score": C.temp_points()})
    return df.withColumn("clinical_risk_score", F.col("hr_risk_score") + F.col("sbp_risk_score")
                         + F.col("spo2_risk_score") + F.col("temp_risk_score"))


def fit_shock_index(df: DataFrame, accuracy: int | None = None) -> float | None:
    """Median of the capped shock index: fills rows where it cannot be computed."""
    return quantiles.medians(df.select(C.capped_shock_index().alias("si")), ["si"], accuracy)["si"]


def shock_index(df: DataFrame, fill: float | None) -> DataFrame:
    value = F.coalesce(C.capped_shock_index(), F.lit(fill).cast("double"))
    return df.withColumn("shock_index", value).withColumn(
        "shock_index_high", flag(F.col("shock_index") > F.lit(C.SHOCK_HIGH)))


def map_pressure(df: DataFrame) -> DataFrame:
    return df.withColumns({"map": C.mean_pressure(), "map_low": C.low_pressure_flag()})


def age_band(df: DataFrame) -> DataFrame:
    return df.withColumns({"age_category": C.age_band(), "elderly_flag": C.elderly_flag()})


def abnormal_count(df: DataFrame) -> DataFrame:
    marks = [make() for name, make in C.ABNORMAL.items() if name in df.columns]
    return df.withColumn("abnormal_vitals_count", sum(marks[1:], marks[0])) if marks else df


def pain_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"severe_pain": C.severe_pain_flag(), "no_pain": C.no_pain_flag()})


def add_clinical(df: DataFrame, shock_fill: float | None = None, accuracy: int | None = None
                 ) -> tuple[DataFrame, list[str]]:
    """Every clinical feature the table's columns allow, on raw units, plus the list of new columns.

    Give ``shock_fill`` (fitted on training rows) to score other rows or a stream without reading them.
    """
    before, have = df.columns, set(df.columns)
    if "pain_raw" in have and "pain" not in have:
        df = df.withColumn("pain", to_number("pain_raw"))
        have.add("pain")
    df = early_warning(df)
    if {"hr", "sbp"} <= have:
        df = shock_index(df, fit_shock_index(df, accuracy) if shock_fill is None else shock_fill)
    if {"sbp", "dbp"} <= have:
        df = map_pressure(df)
    if "age" in have:
        df = age_band(df)
    df = abnormal_count(df)
    if "pain" in have:
        df = pain_flags(df)
    return df, [c for c in df.columns if c not in before]
