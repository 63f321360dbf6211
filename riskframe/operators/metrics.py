"""Classification metrics.

Rows are read once into a confusion table (classes x classes per group, combined map-side); every
threshold metric is a projection of that table, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .schema import rows

# Bands of the train-validation gap.
GAP_GOOD = 0.05
GAP_OK = 0.07


def counts(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Sparse confusion counts ``(by..., y, p, n)``."""
    return (df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
            .groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n")))


def confusion(df: DataFrame, y: str, p: str, classes: Sequence[str]) -> DataFrame:
    """Every (true, predicted) cell, zeros included, with its share of the true class."""
    cells = counts(df, y, p)
    grid = [F.struct(F.lit(a).alias("y"), F.lit(b).alias("p"), F.coalesce(F.sum(F.when(
        (F.col("y") == a) & (F.col("p") == b), F.col("n"))), F.lit(0)).alias("n")) for a in classes for b in classes]
    full = cells.agg(F.array(*grid).alias("g")).select(F.explode("g").alias("c")).select("c.*")
    return full.withColumn("row_share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("y"))))


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, predicted, hits, precision, recall, F1 per class from confusion counts."""
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = cells.select(*by, rows(
        {"class": F.col("y"), "support": F.col("n"), "predicted": none, "hits": hit.cast("bigint")},
        {"class": F.col("p"), "support": none, "predicted": F.col("n"), "hits": none}).alias("s")).select(*by, "s.*")
    sums = sides.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    hits = F.col("hits") * F.lit(1.0)

    def share(c):
        return F.coalesce(F.try_divide(hits, c), F.lit(0.0))

    return sums.withColumns({
        "precision": share(F.col("predicted")), "recall": share(F.col("support")),
        "f1": F.coalesce(F.try_divide(hits * 2, F.col("predicted") + F.col("support")), F.lit(0.0))})


def from_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted F1 and Matthews correlation per group."""
    # counts as doubles: products of counts overflow integers on large tables
    t, q, h = (F.col(c).cast("double") for c in ("support", "predicted", "hits"))
    sums = per_class(cells, by).groupBy(*by).agg(
        F.sum("support").alias("n"), F.sum(h).alias("h"), F.sum(t * q).alias("tq"), F.sum(t * t).alias("tt"),
        F.sum(q * q).alias("qq"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"), F.sum(F.col("f1") * t).alias("wf"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * n - F.col("qq")) * F.sqrt(n * n - F.col("tt"))
    return sums.select(
        *by, "n", (F.col("h") / n).alias("accuracy"), "balanced_accuracy", "macro_f1",
        (F.col("wf") / n).alias("weighted_f1"),
        F.coalesce(F.try_divide(F.col("h") * n - F.col("tq"), spread), F.lit(0.0)).alias("mcc"))


def summary(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return from_counts(counts(df, y, p, by), by)


def report(df: DataFrame, y: str, p: str, scores: Mapping[str, str] | None = None) -> DataFrame:
    """Precision, recall, F1, support per class, with one-vs-rest AUC when score columns are given."""
    table = per_class(counts(df, y, p)).select("class", "precision", "recall", "f1", "support")
    if scores:
        from .curves import auc

        table = table.join(F.broadcast(auc(df, y, scores)), "class", "left")  # one row per class
    return table


def gaps(df: DataFrame, y: str, p: str, split: str, first: str = "train", second: str = "validation") -> DataFrame:
    """Train minus validation metrics in one row, with a band for the accuracy gap."""
    s = summary(df, y, p, [split])
    wanted = [(name, m) for name in (first, second) for m in ("accuracy", "balanced_accuracy", "macro_f1")]
    row = s.agg(*[F.max(F.when(F.col(split) == name, F.col(m))).alias(f"{name}_{m}") for name, m in wanted])
    gap = F.col(f"{first}_accuracy") - F.col(f"{second}_accuracy")
    return row.withColumns({
        "accuracy_gap": gap,
        "balanced_gap": F.col(f"{first}_balanced_accuracy") - F.col(f"{second}_balanced_accuracy"),
        "band": F.when(gap < GAP_GOOD, "GOOD").when(gap < GAP_OK, "OK").otherwise("HIGH")})


def brier(df: DataFrame, y: str, scores: Mapping[str, str]) -> DataFrame:
    """Mean squared distance of each class's probability from its 0/1 outcome; one scan."""
    row = df.agg(*[F.avg(F.pow(F.col(c) - (F.col(y) == name).cast("double"), 2)).alias(name)
                   for name, c in scores.items()])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("class"), F.col(name).alias("brier")) for name in scores])).alias("r")).select("r.*")


def crosstab(df: DataFrame, y: str, p: str) -> DataFrame:
    """Counts by true and predicted class with 'All' margins, taken from the confusion table."""
    cells = counts(df, y, p)
    return cells.cube("y", "p").agg(F.sum("n").alias("n"), F.grouping("y").alias("gy"), F.grouping("p").alias("gp")
                                    ).select(F.when(F.col("gy") == 1, "All").otherwise(F.col("y")).alias("y_true"),
                                             F.when(F.col("gp") == 1, "All").otherwise(F.col("p")).alias("y_pred"), "n")


class BalancedAccuracy(Evaluator):
    """Mean recall over the classes present, for model tuning."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return summary(dataset, self.label, self.prediction).first()["balanced_accuracy"]

    def isLargerBetter(self) -> bool:
        return True
