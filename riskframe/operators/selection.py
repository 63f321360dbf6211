"""Choosing the final model from scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics

# Weights of performance and of a controlled gap, and the gap at which nothing is left.
PERFORMANCE, CONTROL, WIDEST_GAP = 0.7, 0.3, 0.15


def compare(scored: DataFrame, y: str, p: str, model: str = "model", split: str = "split") -> DataFrame:
    """Selection score per model from rows ``(model, split, y, p)`` of splits train and validation.

    Only confusion counts leave the scan: models x splits x classes x classes rows.
    """
    s = metrics.summary(scored, y, p, [model, split])

    def of(name: str, what: str):
        return F.max(F.when(F.col(split) == name, F.col(what)))

    row = s.groupBy(model).agg(
        of("validation", "balanced_accuracy").alias("val_balanced"), of("validation", "macro_f1").alias("val_f1"),
        (of("train", "accuracy") - of("validation", "accuracy")).alias("acc_gap"))
    kept = F.lit(1.0) - F.least(F.greatest("acc_gap", F.lit(0.0)), F.lit(WIDEST_GAP)) / F.lit(WIDEST_GAP)
    return row.withColumn("selection_score", F.col("val_balanced") * PERFORMANCE + kept * CONTROL)


def select(scored: DataFrame, y: str, p: str, order: list[str], model: str = "model", split: str = "split") -> DataFrame:
    """The winning row of ``compare``; on a tie the model listed first."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col(model))
    return compare(scored, y, p, model, split).orderBy(F.desc(F.round("selection_score", 12)), place).limit(1)
