"""Fill gaps with the mean of the nearest rows that have the value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .lsh import nearest_lsh
from .neighbors import nearest


def knn_values(df: DataFrame, target: str, features: Sequence[str], key: str, k: int = 5, method: str = "exact") -> DataFrame:
    """``(key, value)`` for the rows lacking ``target``: mean of the k nearest rows that have it.

    Distances use the other features present on both sides, scaled by (features / shared), the target
    counting as one of the features as it does in the usual nan-aware distance. ``method`` "lsh" finds most of these rows by
    random-projection buckets (see ``lsh``), at a cost that does not grow with the number of boxes near a row.
    """
    if method not in ("exact", "lsh"):
        raise ValueError(f"unknown method {method}")
    search = nearest if method == "exact" else nearest_lsh
    dims = [f for f in features if f != target]
    scale = (len(dims) + 1) / len(dims)  # constant factor: it cannot change the order, only d2
    rows = durable(df.select(F.col(key).alias("id"), target, *dims))  # read by several stages
    near = search(rows.where(F.col(target).isNull()), rows.where(F.col(target).isNotNull()), dims, k, carry=[target])
    total = F.aggregate("near", F.lit(0.0), lambda a, p: a + p[target])
    return near.select(F.col("id").alias(key), (total / F.size("near")).alias("value"),
                       F.size("near").alias("donors"), (F.element_at("near", 1)["d2"] * scale).alias("nearest_d2"))


def knn(df: DataFrame, target: str, features: Sequence[str], key: str, k: int = 5, fill_all: bool = False,
        method: str = "exact") -> DataFrame:
    """The table with ``target`` filled (``fill_all``: every listed feature); the column mean where no row is comparable.

    Every column is searched on the table as it came: a fill is never a neighbour's coordinate or value.
    """
    targets = list(features) if fill_all else [target]
    means = df.agg(*[F.avg(c).alias(c) for c in targets]).first()
    out = df
    for c in targets:
        filled = durable(knn_values(df, c, features if c in features else [c, *features], key, k, method).select(key, F.col("value").alias("_fill")))
        out = out.join(filled, key, "left").withColumn(c, F.coalesce(c, "_fill", F.lit(means[c]))).drop("_fill")
    return out
