"""Reference predictors a model has to beat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clinical as C
from . import models

# Total early-warning points that call for each class.
RED_FROM, YELLOW_FROM = 6, 3


def majority(df: DataFrame, y: str) -> str:
    """Most frequent class, smallest name on a tie."""
    return df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), y).first()[0]


def dummy(train: DataFrame, df: DataFrame, y: str, prediction: str = "prediction") -> DataFrame:
    return df.withColumn(prediction, F.lit(majority(train, y)))


def rule() -> Column:
    """Class by early-warning points."""
    points = C.hr_points() + C.sbp_points() + C.spo2_points() + C.temp_points()
    return F.when(points >= RED_FROM, "RED").when(points >= YELLOW_FROM, "YELLOW").otherwise("GREEN")


def rules(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return df.withColumn(prediction, rule())


def learned(train: DataFrame, features, y: str) -> dict[str, models.Fitted]:
    """Logistic regression and a single tree."""
    return {"logistic": models.logistic(train, features, y, max_iter=100), "tree": models.tree(train, features, y)}
