"""Row-wise operators on a stream: fitted on stored rows, applied to arriving ones as plain projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.features import add_clinical


def read_visits(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet",
                files_per_trigger: int = 100) -> DataFrame:
    """Visit files arriving in a folder."""
    return (spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(folder))


def apply_fitted(stream: DataFrame, fitted: Sequence, shock_fill: float | None = None) -> DataFrame:
    """Runs fitted steps (fills, winsor bounds, chains, scalers: anything with ``apply``) and the clinical features.

    Clinical features are computed before scaling, so pass scalers through ``fitted`` only when
    ``shock_fill`` is None.
    """
    out = stream
    for step in fitted:
        out = step.apply(out)
    return add_clinical(out, shock_fill)[0] if shock_fill is not None else out
