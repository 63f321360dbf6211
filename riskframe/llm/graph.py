"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that the links ``a``-``b`` reach, for every node that has a link.

    Each round takes the smallest label of the neighbours and then the label of that label, so that long chains
    shorten by half at least; it ends when no label changes. A node's links are aggregated before the shuffle.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                    .select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        nearest = (both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b")
                   .groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other")))
        closer = labels.join(nearest, "node").select("node", F.least("label", "other").alias("near"), "label")
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = stored(closer.join(jump, "near", "left")
                       .select("node", F.least("near", F.coalesce("far", "near")).alias("label"),
                               (F.least("near", F.coalesce("far", "near")) != F.col("label")).alias("changed")), "labels")
        labels = after.select("node", "label")
        if after.where("changed").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
