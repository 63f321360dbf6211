"""Boosting rounds look at their rows once."""

import numpy as np
from pyspark.sql import functions as F

from riskframe.operators import boosters, summed


def test_a_round_draws_its_rows_once(spark, monkeypatch):
    """Every level of a round reads the same stored rows: the view is called once a block and round, not once a level."""
    df = spark.range(600).select(*[(F.xxhash64("id", F.lit(f)) % 20).cast("double").alias(f) for f in "abc"],
                                 F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("y"))
    calls, whole = spark.sparkContext.accumulator(0), boosters._view

    def counted(*args):
        view = whole(*args)

        def run(state):
            calls.add(1)
            return view(state)
        return run

    monkeypatch.setattr(boosters, "_view", counted)
    monkeypatch.setattr(boosters, "PENDING", 2)
    model = boosters.grow(df.repartition(2), list("abc"), "y", 2, None, 4, 0.1, 3, 1, 0.8, 3, 7)
    assert model.nodes.depth == 4 and calls.value == 3 * spark.sparkContext.defaultParallelism


def test_rows_drawn_once_each_are_counted(spark):
    r = np.random.default_rng(1)
    x, w, goal = r.integers(0, 30, (3, 500)).astype(np.uint8), r.random(500), r.normal(size=500)
    blocks = spark.sparkContext.parallelize([0], 1)
    grown = [summed.grow(blocks, lambda _, c=c: [(x, c, w, goal)], 1, 3, 4, 5, 3, 1, 1)[0] for c in (None, np.ones(500))]
    assert len(grown[0].child) > 10
    for k in ("feature", "cut", "child", "value"):
        assert (getattr(grown[0], k) == getattr(grown[1], k)).all()
