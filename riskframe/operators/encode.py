"""Label codes, one-hot columns, one-vs-rest columns.

Class labels and other short lists of values become literals (``LabelCodec``, ``one_hot``). Columns of any number of values are
coded by a table (``code_table``, ``with_codes``) that is joined, and their one-hot form is a sparse vector (``one_hot_sparse``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, slices

MAX_LEVELS = 10_000  # values that may become literals of a plan; ``code_table`` has no such bound
BROADCAST_CODES = 500_000  # codes that a join may broadcast, about 50 MB


def levels(df: DataFrame, column: str) -> list[str]:
    """Sorted non-null values of a categorical column; its size is checked before it is used as literals."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct()
             .limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} values: use code_table and one_hot_sparse")
    return sorted(found, key=lambda v: v.encode() if isinstance(v, str) else v)


@dataclass(frozen=True)
class LabelCodec:
    """Codes 0..k-1 by sorted class name."""

    classes: tuple[str, ...]

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> LabelCodec:
        return cls(tuple(levels(df, column)))

    def encode(self, column: str) -> Column:
        out = F.lit(None).cast("int")
        for i, name in enumerate(self.classes):
            out = F.when(F.col(column) == name, i).otherwise(out)
        return out

    def decode(self, column: str) -> Column:
        return F.get(F.array(*[F.lit(c) for c in self.classes]), F.col(column).cast("int"))


def one_hot(df: DataFrame, columns: Sequence[str], values: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Adds ``<column>_<value>`` 0/1 columns; a NULL is 0 everywhere."""
    added = {}
    for c in columns:
        for v in (values or {}).get(c) or levels(df, c):
            added[f"{c}_{v}"] = F.coalesce((F.col(c) == v).cast("int"), F.lit(0))
    return df.withColumns(added)


def binarize(df: DataFrame, y: str, classes: Sequence[str]) -> DataFrame:
    """Adds ``is_<class>`` 0/1 columns."""
    return df.withColumns({f"is_{c}": (F.col(y) == c).cast("int") for c in classes})


def code_table(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: codes 0..k-1 by sorted value, for any number of values; null and NaN have none.

    Ranges of the sorted values are numbered by themselves, and a range's first code is the number of values in the ranges
    before it, so no task sees all values.
    """
    kind = df.schema[column].dataType.typeName()
    there = F.col(column).isNotNull() & (~F.isnan(column) if kind in ("double", "float") else F.lit(True))
    values = durable(df.where(there).select(F.col(column).alias("value")).distinct())
    ranged = durable(values.repartitionByRange(slices(df.sparkSession), "value").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # a row per range
    bases = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("value")) - 1
    return durable(ranged.withColumn("_at", inside).join(F.broadcast(bases), "_range").select("value", (F.col("_base") + F.col("_at")).alias("code")))


def with_codes(df: DataFrame, column: str, table: DataFrame, out: str = "code") -> DataFrame:
    """``df`` with the code of ``column`` as a bigint; a value that ``table`` lacks has none. A long table is joined by a shuffle."""
    codes = table.select(F.col("value").alias("_value"), F.col("code").alias(out))
    codes = F.broadcast(codes) if table.count() <= BROADCAST_CODES else codes
    return df.join(codes, df[column] == codes["_value"], "left").drop("_value")


def one_hot_sparse(df: DataFrame, column: str, table: DataFrame, out: str = "vector") -> DataFrame:
    """``df`` with a sparse vector as long as ``table``: 1 at the code of ``column``, all 0 where it has none."""
    size = table.count()
    if size == 0:
        raise ValueError(f"{column} has no value")
    coded = with_codes(df, column, table, "_code").withColumn("_code", F.coalesce(F.col("_code"), F.lit(size)).cast("double"))
    # the encoder's own size comes from the largest code; codes beyond it are kept as a last place, which is dropped
    encoder = OneHotEncoder(inputCol="_code", outputCol=out, dropLast=True, handleInvalid="keep")
    return encoder.fit(df.sparkSession.range(1).select(F.lit(float(size - 1)).alias("_code"))).transform(coded).drop("_code")
