"""Class distribution, resampling targets, weights, and the gates that judge a resampled table.

Everything past the first ``groupBy`` runs on one row per class.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Shift of the target ratio per strategy, and the gates' limits.
RATIO_SHIFT = {"moderate": 0.0, "conservative": 0.5, "aggressive": -0.8}
MAX_SYNTHETIC_PCT = 25.0
MAX_RATIO_DIFF = 0.5
MAX_WEIGHT_RATIO = 4.0


def _whole():
    return Window.partitionBy(F.lit(1))


def counts(df: DataFrame, y: str) -> DataFrame:
    return df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, y: str) -> DataFrame:
    """Rows and share per class, and the ratio of the largest to the smallest class."""
    w = _whole()
    return counts(df, y).select(
        "class", "n", (F.col("n") / F.sum("n").over(w)).alias("share"),
        (F.max("n").over(w) / F.min("n").over(w)).alias("imbalance_ratio"))


def targets(df: DataFrame, y: str, strategy: str = "moderate", ir: float = 2.0) -> DataFrame:
    """Rows each class should reach: minorities are raised to majority/ratio, nothing is lowered."""
    base = F.floor(F.max("n").over(_whole()) / F.lit(ir + RATIO_SHIFT[strategy]))
    return counts(df, y).select("class", "n", F.greatest(F.col("n"), base).alias("target"))


def target_table(df: DataFrame, y: str, strategy: str = "moderate", ir: float = 2.0) -> dict[str, tuple[int, int]]:
    """The same as numbers: class -> (rows, target)."""
    return {r["class"]: (r["n"], r["target"]) for r in targets(df, y, strategy, ir).collect()}


def report(before: DataFrame, after: DataFrame, y: str) -> DataFrame:
    """Per class rows before and after, change, change %, and the ratios and synthetic share of the table."""
    w = _whole()
    old = counts(before, y).withColumnRenamed("n", "n_before")
    new = counts(after, y).withColumnRenamed("n", "n_after")
    # one row per class; a class that is gone from one table counts 0 rows there
    both = new.join(old, "class", "full").fillna(0, ["n_before", "n_after"])
    change = F.col("n_after") - F.col("n_before")
    return both.select(
        "class", "n_before", "n_after", change.alias("change"),
        F.coalesce(F.try_divide(change * F.lit(100.0), F.col("n_before")), F.lit(0.0)).alias("change_pct"),
        F.try_divide(F.max("n_before").over(w), F.min("n_before").over(w)).alias("ir_before"),
        F.try_divide(F.max("n_after").over(w), F.min("n_after").over(w)).alias("ir_after"),
        F.try_divide(F.sum(change).over(w) * F.lit(100.0), F.sum("n_after").over(w)).alias("synthetic_pct"))


def class_weights(df: DataFrame, y: str, manual: Mapping[str, float] | None = None) -> DataFrame:
    """Balanced weights n/(k n_c) divided by their mean, or a given table."""
    if manual is not None:
        return df.sparkSession.createDataFrame(list(manual.items()), "class string, weight double")
    w = _whole()
    raw = counts(df, y).withColumn(
        "raw_weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))
    return raw.select("class", "n", "raw_weight", (F.col("raw_weight") / F.avg("raw_weight").over(w)).alias("weight"))


def weight_table(df: DataFrame, y: str, manual: Mapping[str, float] | None = None) -> dict[str, float]:
    return {r["class"]: r["weight"] for r in class_weights(df, y, manual).collect()}


def attach_weights(df: DataFrame, y: str, weights: Mapping[str, float], power: int = 1,
                   column: str = "weight") -> DataFrame:
    """Each row's class weight as a literal lookup: one value per class, so no join."""
    out = F.lit(None).cast("double")
    for name, value in weights.items():
        out = F.when(F.col(y) == name, F.lit(float(value) ** power)).otherwise(out)
    return df.withColumn(column, out)


def quality_checks(before: DataFrame, after: DataFrame, y: str, ir: float = 2.0, succeeded: bool = True) -> DataFrame:
    """Four gates over the resampled table."""
    table = report(before, after, y)
    w = _whole()
    weight = F.try_divide(F.sum("n_after").over(w), F.col("n_after"))
    facts = table.withColumn("weight", weight).agg(
        F.max("synthetic_pct").alias("synthetic"), F.max("ir_after").alias("ratio"),
        (F.max("weight") / F.min("weight")).alias("weights"))

    def gate(name: str, ok, otherwise: str, value):
        return F.struct(F.lit(name).alias("check"), F.when(ok, "PASS").otherwise(otherwise).alias("status"),
                        F.round(value, 6).alias("value"))

    return facts.select(F.explode(F.array(
        gate("synthetic_share", F.col("synthetic") <= MAX_SYNTHETIC_PCT, "FAIL", F.col("synthetic")),
        gate("imbalance_ratio", F.abs(F.col("ratio") - ir) <= MAX_RATIO_DIFF, "WARN", F.col("ratio")),
        gate("weight_ratio", F.col("weights") <= MAX_WEIGHT_RATIO, "WARN", F.col("weights")),
        gate("sampler", F.lit(succeeded), "FAIL", F.lit(float(succeeded))),
    )).alias("g")).select("g.*")
