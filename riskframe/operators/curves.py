"""Score curves: ROC, AUC, precision-recall, calibration.

Rows collapse to distinct scores per class first (map-side combined); running sums over the distinct
scores are range-partitioned, see ``prefix``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running_sums


def score_counts(df: DataFrame, y: str, scores: Mapping[str, str]) -> DataFrame:
    """(class, score, pos, neg): one-vs-rest outcomes per distinct score."""
    cells = F.array(*[F.struct(F.lit(name).alias("class"), F.col(c).alias("score"),
                               (F.col(y) == name).cast("bigint").alias("hit")) for name, c in scores.items()])
    return (df.where(F.col(y).isNotNull()).select(F.explode(cells).alias("c")).select("c.*")
            .where(F.col("score").isNotNull()).groupBy("class", "score")
            .agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg")))


def _descending(df: DataFrame, y: str, scores: Mapping[str, str], peek: bool = False) -> DataFrame:
    marked = score_counts(df, y, scores).withColumn("order", -F.col("score"))
    return running_sums(marked, ["class"], "order", ["pos", "neg"], peek)


def _anchor(points: DataFrame, scores: Mapping[str, str], **values: float) -> DataFrame:
    """One starting point per class, above every score, with a NULL threshold."""
    names = [c for c in points.columns if c not in ("class", "threshold")]
    rows = [(name, None, *[values[c] for c in names]) for name in scores]
    return points.unionByName(points.sparkSession.createDataFrame(rows, points.schema))


def auc(df: DataFrame, y: str, scores: Mapping[str, str]) -> DataFrame:
    """One-vs-rest area per class: positives above each negative, ties counting half."""
    marked = running_sums(score_counts(df, y, scores), ["class"], "score", ["pos", "neg"])
    below = F.col("neg_upto") - F.col("neg") / 2.0
    sums = marked.groupBy("class").agg(F.sum(F.col("pos") * below).alias("wins"), F.max("pos_all").alias("p"),
                                       F.max("neg_all").alias("n"))
    return sums.select("class", F.try_divide(F.col("wins"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def macro_auc(df: DataFrame, y: str, scores: Mapping[str, str]) -> DataFrame:
    return auc(df, y, scores).agg(F.avg("auc").alias("macro_auc"))


def roc_curve(df: DataFrame, y: str, scores: Mapping[str, str], drop_collinear: bool = True) -> DataFrame:
    """(class, threshold, fpr, tpr) from the highest score down, starting at (0, 0).

    ``drop_collinear`` leaves out a point when the step to the next one repeats the step that led to it.
    """
    points = _descending(df, y, scores, drop_collinear)
    if drop_collinear:
        first = F.col("pos_upto") + F.col("neg_upto") == F.col("pos") + F.col("neg")
        turns = (F.col("pos") != F.col("pos_next")) | (F.col("neg") != F.col("neg_next"))
        points = points.where(first | F.col("pos_next").isNull() | turns)
    points = points.select("class", F.col("score").alias("threshold"),
                           F.try_divide(F.col("neg_upto"), F.col("neg_all")).alias("fpr"),
                           F.try_divide(F.col("pos_upto"), F.col("pos_all")).alias("tpr"))
    return _anchor(points, scores, fpr=0.0, tpr=0.0)


def pr_curve(df: DataFrame, y: str, scores: Mapping[str, str]) -> DataFrame:
    """(class, threshold, precision, recall) at every distinct score, with the (1, 0) end point."""
    points = _descending(df, y, scores).select(
        "class", F.col("score").alias("threshold"),
        (F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))).alias("precision"),
        F.try_divide(F.col("pos_upto"), F.col("pos_all")).alias("recall"))
    return _anchor(points, scores, precision=1.0, recall=0.0)


def average_precision(df: DataFrame, y: str, scores: Mapping[str, str]) -> DataFrame:
    """Recall steps weighted by precision, per class."""
    d = _descending(df, y, scores)
    step = F.col("pos") / F.col("pos_all") * F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))
    return d.groupBy("class").agg(F.sum(step).alias("average_precision"))


def calibration(df: DataFrame, y: str, scores: Mapping[str, str], bins: int = 10) -> DataFrame:
    """Mean predicted probability against the observed share in uniform bins; upper edges inclusive."""
    cells = F.array(*[F.struct(F.lit(name).alias("class"), F.col(c).alias("score"),
                               (F.col(y) == name).cast("double").alias("hit")) for name, c in scores.items()])
    place = F.greatest(F.ceil(F.col("score") * bins), F.lit(1)) - 1
    return (df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("score").isNotNull())
            .groupBy("class", place.cast("int").alias("bin"))
            .agg(F.avg("score").alias("mean_predicted"), F.avg("hit").alias("fraction_positive"),
                 F.count(F.lit(1)).alias("n")))
