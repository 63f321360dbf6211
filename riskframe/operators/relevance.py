"""How much a feature says about the class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import f_tail
from . import quantiles


def anova_f(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """One-way F of each feature against the class; one scan, classes x features moments.

    Group means and variances are merged from running moments, which stays accurate where raw sums of
    squares would cancel.
    """
    moments = df.where(F.col(y).isNotNull()).groupBy(y).agg(
        *[F.count(F.col(f)).alias(f"{f}_n") for f in features],
        *[F.avg(f).cast("double").alias(f"{f}_m") for f in features],
        *[F.var_pop(f).alias(f"{f}_v") for f in features])
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}_n").alias("n"), F.col(f"{f}_m").alias("m"),
                               F.col(f"{f}_v").alias("v")) for f in features])
    long = moments.select(F.explode(cells).alias("c")).select("c.*").where(F.col("n") > 0)
    mean = F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("feature")) / F.sum("n").over(
        Window.partitionBy("feature"))
    sums = long.withColumn("gm", mean).groupBy("feature").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return sums.select("feature", F.try_divide(
        F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1)).alias("f_score"),
        (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def anova_p(table: DataFrame) -> DataFrame:
    """The F table with tail probabilities (one row per feature, so worked out on the driver)."""
    rows = [(r["feature"], r["f_score"], None if r["f_score"] is None
             else f_tail(r["f_score"], r["df_between"], r["df_within"])) for r in table.collect()]
    return table.sparkSession.createDataFrame(rows, "feature string, f_score double, p_value double")


def mutual_info(df: DataFrame, features: Sequence[str], y: str, bins: int = 10,
                accuracy: int | None = None) -> DataFrame:
    """Plug-in mutual information (nats) of each feature's equal-frequency bins with the class."""
    rows = df.where(F.col(y).isNotNull())
    edges = quantiles.quantiles(rows, features, [i / bins for i in range(1, bins)], accuracy)
    cells = []
    for f in features:
        place = F.lit(0)
        for e in sorted({e for e in edges[f] if e is not None}):
            place = place + (F.col(f) > F.lit(e)).cast("int")
        cells.append(F.struct(F.lit(f).alias("feature"), F.when(F.col(f).isNotNull(), place).alias("bin")))
    joint = (rows.select(F.col(y).alias("class"), F.explode(F.array(*cells)).alias("c"))
             .select("class", "c.*").where(F.col("bin").isNotNull())
             .groupBy("feature", "bin", "class").agg(F.count(F.lit(1)).cast("double").alias("n")))
    total = F.sum("n").over(Window.partitionBy("feature"))
    by_bin = F.sum("n").over(Window.partitionBy("feature", "bin"))
    by_class = F.sum("n").over(Window.partitionBy("feature", "class"))
    return (joint.select("feature", "n", total.alias("t"), by_bin.alias("b"), by_class.alias("c"))
            .groupBy("feature").agg(F.sum(
                F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("b") * F.col("c")))
            ).alias("mi_score")))


def rank(df: DataFrame, features: Sequence[str], y: str, bins: int = 10, n: int | None = None,
         accuracy: int | None = None) -> DataFrame:
    """Both scores, each scaled to 0-1 over the features, and their mean, best first."""
    both = anova_f(df, features, y).select("feature", "f_score").join(
        F.broadcast(mutual_info(df, features, y, bins, accuracy)), "feature")  # one row per feature
    every = Window.partitionBy(F.lit(1))

    def unit(c: str):
        low = F.min(c).over(every)
        return F.try_divide(F.col(c) - low, F.max(c).over(every) - low)

    out = both.withColumns({"f_norm": unit("f_score"), "mi_norm": unit("mi_score")}).withColumn(
        "combined", (F.col("f_norm") + F.col("mi_norm")) / 2).orderBy(F.desc("combined"), "feature")
    return out.limit(n) if n else out
