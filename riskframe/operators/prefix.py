"""Running sums over an order that may span the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranges(df: DataFrame, order: str) -> DataFrame:
    """Adds ``_range``: about equal slices of the order, cut at sketched quantiles.

    Ranges only decide where rows are worked on, so the sketch's error does not matter.
    """
    slices = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    edges = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(edges) < 3:
        return df.withColumn("_range", F.lit(0.0))
    return Bucketizer(splits=edges, inputCol=order, outputCol="_range").transform(df)


def running_sums(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], peek: bool = False) -> DataFrame:
    """Adds ``<name>_upto`` (inclusive running sum) and ``<name>_all`` (group total) per ``by`` group.

    ``order`` is a double, unique inside a group. One window per group would put a whole class into one
    task; so range totals (ranges x groups, a bounded table) are accumulated first, and the row-level
    window runs inside each range. ``peek`` adds ``<name>_next``, the following row's value (NULL last).
    """
    ranged = _ranges(df, order)
    first = F.min_by(F.struct(*sums), order)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_{s}") for s in sums], first.alias("_first"))
    across = Window.partitionBy(*by).orderBy("_range")
    ahead = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(
        *by, "_range", F.lead("_first").over(across).alias("_beyond"),
        *[F.coalesce(F.sum(f"_{s}").over(ahead), F.lit(0)).alias(f"_{s}_ahead") for s in sums],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_all") for s in sums],
    )
    inside = Window.partitionBy(*by, "_range").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(totals), [*by, "_range"]).select(
        *df.columns,
        *[(F.sum(s).over(upto) + F.col(f"_{s}_ahead")).alias(f"{s}_upto") for s in sums],
        *[f"{s}_all" for s in sums],
        *([F.coalesce(F.lead(s).over(inside), F.col(f"_beyond.{s}")).alias(f"{s}_next") for s in sums] if peek else []),
    )
