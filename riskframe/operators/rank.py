"""Top-n rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: str, n: int, tiebreak: str) -> DataFrame:
    """The n largest by ``by``, ties by key: each task keeps n rows, no full sort."""
    return df.orderBy(F.desc(by), F.asc(tiebreak)).limit(n)


def arg_max(df: DataFrame, what: str, by: str) -> DataFrame:
    return df.agg(F.max_by(what, by).alias(what), F.max(by).alias(by))
