"""A regression forest with MLlib's parameters whose trees grow side by side from summed histograms."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame

from . import summed
from .forests import BLOCK

BLOCKS = "block long, n int, x binary, y binary"


def _binned(names: Sequence[str], cuts: Mapping[str, Sequence[float]], values: Mapping[str, np.ndarray]) -> np.ndarray:
    """Bins, features x rows. A NaN is an error, as in MLlib's assembler."""
    for name in names:
        if np.isnan(values[name]).any():
            raise ValueError(f"{name} must be filled")
    return np.array([np.searchsorted(cuts[f], values[f], "left") for f in names], np.uint8).reshape(len(names), -1)


@dataclass
class Model:
    names: list[str]
    cuts: dict[str, list[float]]
    nodes: summed.Nodes
    centre: float

    def predict(self, values: Mapping[str, np.ndarray]) -> np.ndarray:
        """The mean of the trees' answers."""
        x = _binned(self.names, self.cuts, values)
        trees = len(self.nodes.roots)
        return self.centre + sum(self.nodes.values(t, x) for t in range(trees)) / trees


class SummedForest(RandomForestRegressor):
    """Fits on plain columns ``names``, cut at ``cuts``; ``centre`` is any value near the label's mean."""

    def __init__(self, names: Sequence[str], cuts: Mapping[str, Sequence[float]], centre: float, **params) -> None:
        super().__init__(**params)
        self.names, self.cuts, self.centre = list(names), {c: list(cuts[c]) for c in names}, centre

    def _picks(self) -> int:
        """MLlib's "auto": a third of the features, or all for a single tree."""
        return len(self.names) if self.getNumTrees() == 1 else math.ceil(len(self.names) / 3)

    def _fit(self, dataset: DataFrame) -> Model:
        label, names, cuts, trees, seed, centre = self.getLabelCol(), self.names, self.cuts, self.getNumTrees(), self.getSeed() % (1 << 63), self.centre

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, at = [], 0, TaskContext.get().partitionId() << 32

            def done() -> pa.RecordBatch:
                values = {c: np.concatenate([b[c] for b in held]) for c in (*names, label)}
                if np.isnan(values[label]).any():
                    raise ValueError(f"{label} must be filled")
                cells = [at, n, _binned(names, cuts, values).tobytes(), (values[label] - centre).tobytes()]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["block", "n", "x", "y"])

            for batch in batches:
                held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*names, label)})
                n += batch.num_rows
                if n >= BLOCK:
                    yield done()
                    held, n, at = [], 0, at + n
            if n:
                yield done()

        def opened(r) -> tuple:
            draws = np.random.default_rng([seed, r["block"]]).poisson(1.0, (trees, r["n"])).astype(np.uint8)
            return np.frombuffer(bytes(r["x"]), np.uint8).reshape(-1, r["n"]), np.frombuffer(bytes(r["y"]), np.float64), draws

        def view(block: tuple) -> Iterator[summed.View]:
            x, y, draws = block
            for drawn in draws:
                own = np.flatnonzero(drawn)
                c = drawn[own].astype(np.float64)
                yield x.take(own, 1), c, c, y.take(own)

        lean = dataset.select(*names, label)
        blocks = lean.mapInArrow(pack, BLOCKS).rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            nodes, _ = summed.grow(blocks, view, trees, len(names), self.getMaxDepth(), self.getMinInstancesPerNode(), self._picks(), seed,
                                   dataset.sparkSession.sparkContext.defaultParallelism)
        finally:
            blocks.unpersist()
        return Model(names, cuts, nodes, centre)


def filled(state: DataFrame, models: Sequence[tuple[str, Model]]) -> DataFrame:
    """Each model in turn fills its column where ``_gap_<column>`` holds, from the values that those before have filled."""
    if not models:
        return state
    names = list(dict.fromkeys([*models[0][1].names, *(c for c, _ in models)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in names}
            for c, model in models:
                gap = batch.column(f"_gap_{c}").to_numpy(zero_copy_only=False)
                if gap.any():
                    values[c][gap] = model.predict({o: values[o][gap] for o in model.names})
            yield pa.RecordBatch.from_arrays([pa.array(values[c]) if c in values else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return state.mapInArrow(run, state.schema)
