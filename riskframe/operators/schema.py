"""Column roles, coercion and alignment. Only metadata is read on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ..functions.scalars import to_number


@dataclass(frozen=True)
class Roles:
    numeric: list[str]
    text: list[str]
    time: list[str]


def roles(df: DataFrame, target: str | None = None, keys: Sequence[str] = ()) -> Roles:
    """Columns by kind; the target and row keys belong to none."""
    skip = {target, *keys}
    fields = [f for f in df.schema.fields if f.name not in skip]
    return Roles(
        [f.name for f in fields if isinstance(f.dataType, NumericType)],
        [f.name for f in fields if isinstance(f.dataType, StringType)],
        [f.name for f in fields if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))],
    )


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers from text where they parse, NULL elsewhere; columns the table lacks are skipped."""
    return df.withColumns({c: to_number(c) for c in columns if c in df.columns})


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's features in its order: absent ones are 0, extra ones go."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(f) if f in have else F.lit(0.0).alias(f) for f in features])


def unpivot(df: DataFrame, columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Long form (column, value) of numeric columns as doubles: one narrow pass, no shuffle."""
    return df.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns
        ])).alias("cell")
    ).select(f"cell.{name}", f"cell.{value}")


def rows(*cells: dict[str, Column | object]) -> Column:
    """Several output rows per input row, to be exploded: equal names, one value per name and row."""
    return F.explode(F.array(*[
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(name) for name, v in cell.items()])
        for cell in cells]))
