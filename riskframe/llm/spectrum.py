"""Whitening by spectrum slicing: leading eigenpairs of a covariance, isolated and numbered by inertia counts.

A symmetric matrix less a shift factors into L D Lᵀ, and D has as many negative values as there are eigenvalues below the shift.
Counts at a few shifts part each leading eigenvalue from the others; Rayleigh quotient iteration then converges cubically, and
counts on both sides of the value found certify its number. The covariance itself is a sum of products that tasks make in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.shared import stored

#: How an entry becomes a whole number.
SCALE, SHIFT = 64, 1_000_000
#: Entries whose whole number would leave +-2^45 count as not finite: sums of 2^17 such rows still fit 63 bits.
LARGEST = float(2**45)
#: Rows of a block whose products are made at once.
ROWS = 4096


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows whose vector is not null and holds only finite entries, as whole numbers.

    A table has one dimension, that of most of these rows (of several, the largest); empty vectors and rows of another dimension
    are left out, as are rows with an entry beyond LARGEST.
    """
    entry: Column = F.col(column)
    fits = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(F.floor(c.cast("double") * SCALE).cast("double")) <= LARGEST))
    rows = vectors.where(entry.isNotNull() & (F.size(entry) > 0)).where(fits)
    whole = F.transform(entry, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    rows = stored(rows.select(F.col("vec_id"), whole.alias("x")), "whole")
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (most["d"] if most else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _products(center: np.ndarray, offset: np.ndarray, basis: np.ndarray | None = None):
    """Per task, the sum and the products of its rows, centred before multiplying: a row per row of the matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = (_matrix(batch.slice(at, ROWS)) - center).astype(np.float64) - offset
                y = y if basis is None else y @ basis
                own = np.vstack([y.T @ y, y.sum(0)])
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.arange(len(total)), pa.int32()),
                                              "data": pa.array([r.tobytes() for r in total], pa.binary())})

    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """The sum of the tasks' rows, smallest first: the same whatever order they come in."""
    parts = np.sort(np.array([np.frombuffer(b.as_py(), np.float64) for b in table.column("data")]), axis=0)
    return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([parts.sum(0).tobytes()], pa.binary())})


def covariance(fit: DataFrame, center: np.ndarray, offset: np.ndarray, n: int, basis: np.ndarray | None = None) -> np.ndarray:
    """The covariance, divisor n, of x - center - offset (projected on ``basis`` if there is one) over the rows of ``fit``."""
    parts = fit.select("x").mapInArrow(_products(center, offset, basis), "row int, data binary")
    rows = parts.groupBy("row").applyInArrow(_added, "row int, data binary").orderBy("row").collect()  # d + 1 rows of d numbers
    table = np.array([np.frombuffer(r.data, np.float64) for r in rows])
    mean = table[-1] / n
    out = table[:-1] / n - np.outer(mean, mean)
    return (out + out.T) / 2


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues below ``shift``: the negative ones of D in the LDLᵀ factors of ``matrix`` less the shift.

    Pivots are 1 x 1 or 2 x 2, chosen so that no factor grows (Bunch and Kaufman); a pivot of exactly 0 counts as positive.
    """
    a = matrix - shift * np.eye(len(matrix))
    bound, below = (1 + 17**0.5) / 8, 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if len(column) else 0
        most = column[r - 1] if len(column) else 0.0
        if most == 0.0:
            below += bool(a[0, 0] < 0)
            a = a[1:, 1:]
            continue
        size = 1
        if abs(a[0, 0]) < bound * most:
            beside = np.abs(a[r]).copy()
            beside[r] = 0.0
            other = beside.max()
            if abs(a[0, 0]) * other >= bound * most * most:
                pass
            elif abs(a[r, r]) >= bound * other:
                a[[0, r]] = a[[r, 0]]
                a[:, [0, r]] = a[:, [r, 0]]
            else:
                size = 2
                a[[1, r]] = a[[r, 1]]
                a[:, [1, r]] = a[:, [r, 1]]
        head, side = a[:size, :size], a[size:, :size]
        if size == 1:
            below += bool(head[0, 0] < 0)
            a = a[1:, 1:] - np.outer(side[:, 0], side[:, 0] / head[0, 0])
        else:  # a 2 x 2 pivot has one value of each sign
            below += 1
            a = a[2:, 2:] - side @ np.linalg.solve(head, side.T)
        a = (a + a.T) / 2
    return below


def _converged(matrix: np.ndarray, rho: float, start: np.ndarray, found: np.ndarray, floor: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from ``start``, kept orthogonal to the vectors ``found`` so far."""
    v, best = start, np.inf
    for _ in range(40):
        v = v - found @ (found.T @ v)
        v /= np.linalg.norm(v)
        rho = float(v @ matrix @ v)
        rest = float(np.linalg.norm(matrix @ v - rho * v))
        if rest <= floor or (rest <= 64 * floor and rest >= best / 2):
            break
        best = min(best, rest)
        shift = rho
        while True:
            try:
                w = np.linalg.solve(matrix - shift * np.eye(len(matrix)), v)
                if np.isfinite(w).all():
                    break
            except np.linalg.LinAlgError:
                pass
            shift += floor
        v = w / np.linalg.norm(w)
    return rho, v


def leading(matrix: np.ndarray, count: int = 16, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues in falling order, ``count`` at most, and their unit vectors as columns.

    Values at or below rounding error of the largest one are left out: what has no variance can't be whitened. Equal values have
    any orthogonal vectors of their space.
    """
    d = len(matrix)
    size = float(np.abs(matrix).sum(1).max()) if d else 0.0
    floor = np.finfo(float).eps * size
    least = 8 * d * floor
    values, vectors, rng = [], np.zeros((d, 0)), np.random.default_rng(seed)
    known = {-floor: 0, size * (1 + 1e-9) + floor: d}  # shifts and the eigenvalues below them

    def count_below(x: float) -> int:
        if x not in known:
            known[x] = inertia(matrix, x)
        return known[x]

    if size <= 0 or not np.isfinite(size):
        return np.zeros(0), vectors
    for k in range(1, min(count, d) + 1):
        rank = d - k  # eigenvalues below the wanted one
        low = max(x for x, below in known.items() if below <= rank)
        high = min(x for x, below in known.items() if below > rank)
        while True:
            alone = count_below(low) == rank and count_below(high) == rank + 1
            if alone or high - low <= 4 * floor:
                start = rng.standard_normal(d)
                center = (low + high) / 2
                for _ in range(3 if alone else 8):  # turn towards the slice before the quotient is free to move
                    start = start - vectors @ (vectors.T @ start)
                    try:
                        start = np.linalg.solve(matrix - center * np.eye(d), start)
                    except np.linalg.LinAlgError:
                        start = np.linalg.solve(matrix - (center + floor) * np.eye(d), start)
                    start /= np.linalg.norm(start)
                rho, v = _converged(matrix, center, start, vectors, floor)
                margin = max(16 * floor, 4 * float(np.linalg.norm(matrix @ v - rho * v)))
                # the counts on both sides say that this is the wanted one
                if low - margin <= rho <= high + margin and count_below(rho - margin) <= rank < count_below(rho + margin):
                    break
                if high - low <= 4 * floor:
                    raise ArithmeticError(f"eigenvalue {k} could not be certified")
            middle = (low + high) / 2
            low, high = (middle, high) if count_below(middle) <= rank else (low, middle)
        if rho <= least:
            break
        values.append(rho)
        vectors = np.column_stack([vectors, v])
    return np.array(values), vectors


def _whitened(center: np.ndarray, rest: np.ndarray, n: int, basis: np.ndarray, explained: np.ndarray, error: float):
    offset, k = rest / n, basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own = _matrix(part) - center
                away = own * n - rest  # n * x - S, whole numbers
                far = np.square(away.astype(np.float64)).sum(1) < 2.0**62
                deviation = pa.array([int(v) if ok else (w if (w := sum(int(c) * int(c) for c in row)) < 2**63 else None)
                                      for v, ok, row in zip(np.square(away).sum(1), far, away, strict=True)], pa.int64())
                out = (own.astype(np.float64) - offset) @ basis
                rows = pa.array(np.repeat(np.arange(part.num_rows), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                     pa.array(np.full(len(rows), n, np.int64)), deviation.take(rows), pa.array(out.ravel()),
                     pa.array(np.tile(explained, part.num_rows)), pa.array(np.full(len(rows), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row with a whole vector.

    The fit list holds each distinct vector once. Rows without a vector, or with a null or not finite entry, have no result;
    equal rows have equal results, null ids stay, other columns are not read. There are fewer than ``components`` rows a vector
    where the dimension or the rank of the covariance is lower, none for an empty table or where all vectors are equal.
    ``deviation`` is null where it passes 63 bits.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors.select("vec_id", "embedding"))
    fit = stored(rows.select("x").distinct(), "fit")  # equal vectors are dropped before the shuffle, too
    sums = fit.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
    sums = sums.orderBy("at").collect()  # a row per dimension
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not sums:
        return spark.createDataFrame([], schema)
    n, total = sums[0]["n"], [int(r["total"]) for r in sums]
    center = np.array([t // n for t in total], np.int64)
    rest = np.array([t - n * (t // n) for t in total], np.int64)  # S - n * center, exact
    matrix = covariance(fit, center, rest / n, n)
    values, basis = leading(matrix, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    basis = basis / np.sqrt(values)
    error = float(np.abs(covariance(fit, center, rest / n, n, basis) - np.eye(len(values))).max())
    return rows.mapInArrow(_whitened(center, rest, n, basis, values / np.trace(matrix), error), schema)
