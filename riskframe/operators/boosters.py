"""Boosted trees of any number of rows: the boosters of all classes grow side by side, a pass a level for all of them.

The steps are MLlib's (trees on the pseudo-residuals of the log loss, the first on the labels and at full weight), so a round
depends on the one before. But a pass reads cached blocks of bins with the margins so far, and costs one small job for all classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import forests, summed

#: Rounds whose trees every round adds to the cached margins; then the margins are cached anew.
PENDING = 2
#: Blocks of a task: fewer tasks mean less to add up, and a pass has little to do for a row.
TASK_BLOCKS = 16


def _added(margin: np.ndarray, x: np.ndarray, rounds: Sequence[tuple[float, summed.Nodes]]) -> np.ndarray:
    for rate, nodes in rounds:
        margin = margin + rate * np.array([nodes.values(k, x) for k in range(len(margin))])
    return margin


@dataclass
class Boosters:
    """A booster per class: round r, class k is tree r * classes + k."""

    classes: int
    cuts: list[list[float]]
    rates: list[float]
    nodes: summed.Nodes
    gains: np.ndarray  # classes x features

    @property
    def featureImportances(self) -> DenseVector:
        """As MLlib has it for a booster, gains as shares; their mean over the classes."""
        total = self.gains.sum(1, keepdims=True)
        mean = np.where(total > 0, self.gains / np.where(total > 0, total, 1.0), 0.0).mean(0)
        return Vectors.dense(mean / mean.sum() if mean.sum() > 0 else mean)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.classes, x.shape[1]))
        for tree in range(len(self.nodes.roots)):
            out[tree % self.classes] += self.rates[tree // self.classes] * self.nodes.values(tree, x)
        return out

    def scoring(self, spark: SparkSession, features: Sequence[str]) -> Callable:
        """What scores columns of doubles in a task: each row's probability of every class against the others, as an array."""
        sent, names, cuts = spark.sparkContext.broadcast(self), list(features), self.cuts

        def shares(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for columns in batches:
                found = 1.0 / (1.0 + np.exp(-2.0 * sent.value.margins(forests.bins(names, cuts, columns))))
                yield pa.ListArray.from_arrays(np.arange(found.shape[1] + 1, dtype=np.int32) * len(found), found.T.ravel())

        return shares

    def scored(self, df: DataFrame, features: Sequence[str], column: str) -> DataFrame:
        """Adds each row's probability of every class against the others, as an array. A null or NaN is an error."""
        # a filter on the result is not moved below it, which would score twice
        scores = F.arrow_udf(self.scoring(df.sparkSession, features), "array<double>").asNondeterministic()
        return df.withColumn(column, scores(*[F.col(f).cast("double") for f in features]))

    def save(self, spark: SparkSession, root: str, name: str) -> None:
        tables.save_state(spark, {"classes": self.classes, "cuts": self.cuts, "rates": self.rates, "nodes": self.nodes.state(),
                                  "gains": self.gains.tolist()}, root, f"{name}-boosters")

    @classmethod
    def load(cls, spark: SparkSession, root: str, name: str) -> Boosters:
        s = tables.load_state(spark, root, f"{name}-boosters")
        return cls(s["classes"], s["cuts"], s["rates"], summed.Nodes.of(s["nodes"]), np.array(s["gains"]))


def _view(rounds: Sequence[tuple[float, summed.Nodes]], turn: int, subsample: float, seed: int) -> Callable:
    """What the booster of each class sees of a block in a round: drawn rows, their weights and pseudo-residuals."""

    def view(state: tuple) -> Iterator[summed.View]:
        at, x, y, w, margin = state
        own = np.flatnonzero(np.random.default_rng([seed, at, turn]).random(len(y)) < subsample) if subsample < 1 else np.arange(len(y))
        x, y, w = x[:, own], y[own], w[own]
        margin = _added(margin[:, own], x, rounds)
        for k in range(len(margin)):
            sign = np.where(y == k, 1.0, -1.0)
            yield x, None, w, sign if turn == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin[k]))

    return view


def grow(df: DataFrame, features: Sequence[str], label: str, classes: int, weight: str | None, depth: int, rate: float, rounds: int, leaf: int,
         subsample: float, picks: int, seed: int) -> Boosters:
    """The boosters of all classes (``label`` is a code from 0). A gap in any of the columns is an error."""
    context = df.sparkSession.sparkContext
    cuts = forests.bounds(df, features)
    rows, sizes = forests.blocks(df, features, label, cuts, weight, parts=lambda n: max(context.defaultParallelism, n // (TASK_BLOCKS * forests.BLOCK)))
    if not sizes:
        raise ValueError("no rows to learn from")

    def opened(r) -> tuple:
        x = np.frombuffer(bytes(r["x"]), np.uint8).reshape(-1, r["n"])
        return r["block"], x, np.frombuffer(bytes(r["y"]), np.uint8), np.frombuffer(bytes(r["w"]), np.float64), np.zeros((classes, r["n"]))

    def onward(pending: list) -> Callable:
        return lambda s: (*s[:4], _added(s[4], s[1], pending))

    state = rows.select("block", "n", "x", "y", "w").rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    old, seen, pending, grown, gains = None, None, [], [], np.zeros((classes, len(features)))
    try:
        for turn in range(rounds):
            # drawn and compared with the margins once for all levels of a round
            view = _view(pending, turn, subsample, seed)
            seen = state.map(lambda s, view=view: list(view(s))).persist(StorageLevel.MEMORY_AND_DISK)
            nodes, gain = summed.grow(seen, iter, classes, len(features), depth, leaf, picks, seed + 7919 * turn, context.defaultParallelism)
            seen.unpersist()
            if old is not None:  # the new margins are cached by now
                old = old.unpersist() and None
            gains += gain
            grown.append((rate if turn else 1.0, nodes))
            pending = [*pending, grown[-1]]
            if len(pending) == PENDING:
                old, state, pending = state, state.map(onward(pending)).persist(StorageLevel.MEMORY_AND_DISK), []
    finally:
        for s in (old, seen, state):
            if s is not None:
                s.unpersist()
    return Boosters(classes, [list(c) for c in cuts], [r for r, _ in grown], summed.Nodes.joined(n for _, n in grown), gains)
