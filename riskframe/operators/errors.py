"""Which mistakes a model makes, and which of them are dangerous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics

# Class roles in the triage scale, and mistakes by kind.
HIGH, MIDDLE, LOW = "RED", "YELLOW", "GREEN"
KINDS = {
    "critical": ((HIGH, MIDDLE), (HIGH, LOW)),
    "important": ((MIDDLE, LOW),),
    "over_triage": ((LOW, HIGH), (LOW, MIDDLE)),
}
UNDER_TRIAGE = ("critical", "important")


def kind(y: str, p: str) -> Column:
    out = F.lit(None).cast("string")
    for name, pairs in KINDS.items():
        for a, b in pairs:
            out = F.when((F.col(y) == a) & (F.col(p) == b), name).otherwise(out)
    return out


def patterns(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mistakes by (true, predicted) with their share of all rows, most frequent first."""
    cells = metrics.counts(df, y, p).withColumn("t", F.sum("n").over(Window.partitionBy(F.lit(1))))
    return (cells.where(F.col("y") != F.col("p"))
            .select(F.col("y").alias("y_true"), F.col("p").alias("y_pred"), "n",
                    (F.col("n") * F.lit(100.0) / F.col("t")).alias("pct"))
            .orderBy(F.desc("n"), "y_true", "y_pred"))


def high_risk(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows whose mistake is critical, important or over-triage, with that kind."""
    return df.withColumn("risk", kind(y, p)).where(F.col("risk").isNotNull())


def error_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """How many mistakes of each kind; under-triage is critical plus important."""
    cells = metrics.counts(df, y, p).withColumn("risk", kind("y", "p"))

    def total(names):
        return F.coalesce(F.sum(F.when(F.col("risk").isin(list(names)), F.col("n"))), F.lit(0))

    row = cells.agg(*[total([k]).alias(k) for k in KINDS], total(UNDER_TRIAGE).alias("under_triage"))
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in [*KINDS, "under_triage"]])).alias("r")
    ).select("r.*")
