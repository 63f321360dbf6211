"""Chained-equation imputation, and forest imputation of categories."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import exists, remove, spread, work_folder
from . import encode, forests, impute, quantiles, regressor

MIN_KNOWN = 10
MIN_FEATURES = 3


def _order(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], dict[str, float], dict[str, int]]:
    """Columns with gaps by ascending number of gaps, column means (0 without a value), counts of known values: one scan."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"{c}_n") for c in columns],
                 *[F.avg(c).alias(f"{c}_m") for c in columns]).first()
    known = {c: row[f"{c}_n"] for c in columns}
    means = {c: row[f"{c}_m"] if row[f"{c}_m"] is not None else 0.0 for c in columns}
    return sorted((c for c in columns if known[c] < row["_n"]), key=lambda c: (-known[c], list(columns).index(c))), means, known


def _start(df: DataFrame, columns: Sequence[str], means: Mapping[str, float]) -> DataFrame:
    """Mean-filled columns next to marks of what was missing."""
    return df.withColumns({f"_gap_{c}": F.col(c).isNull() for c in columns}).withColumns(
        {c: F.coalesce(F.col(c), F.lit(means[c])) for c in columns})


TABLE_COLUMNS = 8  # up to here every pattern's filling equation fits a small literal table


@dataclass(frozen=True)
class ChainedLinear:
    """Fitted chain: start means, then one linear equation per column and round, in order.

    In a row with a given set of gaps every filled value is an affine function of the values present, in
    every round. So the products of the present values, summed per gap pattern in one scan, hold all that
    any later regression needs: the rounds themselves are small matrix algebra, however many rows there are.
    """

    columns: Sequence[str]
    means: Mapping[str, float]
    steps: Sequence[tuple[int, np.ndarray]]  # column, weights over (1, centred columns)

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], rounds: int = 10) -> ChainedLinear:
        columns, d = list(columns), len(columns)
        order, means, _ = _order(df, columns)
        products = _pattern_products(df, columns, means)
        views = {p: cls._view(p, d) for p in products}
        steps: list[tuple[int, np.ndarray]] = []
        for c in [columns.index(c) for c in order] * rounds:
            total = np.zeros((d + 1, d + 1))
            for p, g in products.items():
                if not p >> c & 1:
                    total += views[p] @ g @ views[p].T
            keep = [i for i in range(d + 1) if i != c + 1]
            weights = np.zeros(d + 1)
            weights[keep] = np.linalg.lstsq(total[np.ix_(keep, keep)], total[keep, c + 1], rcond=None)[0]
            steps.append((c, weights))
            for p, view in views.items():
                if p >> c & 1:
                    view[c + 1] = weights @ view
        return cls(columns, means, steps)

    @staticmethod
    def _view(pattern: int, d: int) -> np.ndarray:
        """Rows of (1, columns) as functions of (1, present centred values); gaps start at the mean, 0."""
        view = np.eye(d + 1)
        for c in range(d):
            if pattern >> c & 1:
                view[c + 1] = 0.0
        return view

    def equations(self, pattern: int) -> np.ndarray:
        """What the whole chain makes of a row with these gaps."""
        view = self._view(pattern, len(self.columns))
        for c, weights in self.steps:
            if pattern >> c & 1:
                view[c + 1] = weights @ view
        return view[1:]

    def apply(self, df: DataFrame) -> DataFrame:
        """A pure projection, also for new rows or a stream."""
        d = len(self.columns)
        if d > TABLE_COLUMNS:
            return self._apply_steps(df)
        # higher-order functions: d * (d + 1) sums written out make code too long to be compiled
        present = F.array(F.lit(1.0), *[F.coalesce(F.col(c) - F.lit(self.means[c]), F.lit(0.0)) for c in self.columns])
        table = np.stack([self.equations(p) for p in range(1 << d)])
        filled = {}
        for i, c in enumerate(self.columns):
            row = F.slice(F.lit(table[:, i].ravel()), F.col("_gaps") * (d + 1) + 1, d + 1)  # this row's equation
            terms = F.zip_with(row, "_present", lambda w, x: w * x)
            value = F.aggregate(terms, F.lit(self.means[c]).cast("double"), lambda total, term: total + term)
            filled[c] = F.when(F.col(c).isNull(), value).otherwise(F.col(c))
        return df.withColumns({"_gaps": _gap_pattern(self.columns), "_present": present}).withColumns(filled).drop("_gaps", "_present")

    def _apply_steps(self, df: DataFrame) -> DataFrame:
        out = _start(df, self.columns, self.means)
        for i, weights in self.steps:
            c = self.columns[i]
            value = F.lit(self.means[c] + float(weights[0]))
            for o, w in zip(self.columns, weights[1:], strict=True):
                if o != c:
                    value = value + F.lit(float(w)) * (F.col(o) - F.lit(self.means[o]))
            out = out.withColumn(c, F.when(F.col(f"_gap_{c}"), value).otherwise(F.col(c)))
        return out.drop(*[f"_gap_{c}" for c in self.columns])


def _gap_pattern(columns: Sequence[str]):
    mask = F.lit(0)
    for i, c in enumerate(columns):
        mask = mask + F.when(F.col(c).isNull(), 1 << i).otherwise(0)
    return mask


def _pattern_products(df: DataFrame, columns: Sequence[str], means: Mapping[str, float]) -> dict[int, np.ndarray]:
    """Sums of products of (1, centred values, gaps as 0) per gap pattern: one scan, combined map-side."""
    d = len(columns)
    x = [F.lit(1.0), *[F.coalesce(F.col(c) - F.lit(means[c]), F.lit(0.0)) for c in columns]]
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    sums = df.groupBy(_gap_pattern(columns).alias("_gaps")).agg(*[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs])
    out = {}
    for row in sums.collect():  # as many rows as patterns occur
        g = np.zeros((d + 1, d + 1))
        for i, j in pairs:
            g[i, j] = g[j, i] = row[f"p{i}_{j}"]
        out[row["_gaps"]] = g
    return out


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``; one that an earlier run finished is used again."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def chained_forest(df: DataFrame, columns: Sequence[str], rounds: int = 10, trees: int = 10, depth: int = 5,
                   seed: int = 42, key: str | None = None, root: str | None = None) -> DataFrame:
    """The same chain with a forest per column and round; the columns come out as doubles.

    Trees grow from summed histograms over cuts at quantiles of the values present (see ``regressor``).

    Only rows with gaps ever change, and inside a round each column is a projection on the round's first rows. So a round writes
    one file: the rows with gaps, with their key and the chained columns alone. The file of the round before is then deleted, and
    the disk holds the narrow table and at most two such files, for any number of rounds or other columns.

    ``key`` names a column with a value of its own in every row. Without one, the table is written once with row numbers. A run that
    was stopped goes on after its last whole round if it gets the same ``root`` (files of other columns, counts or settings have
    another name there). A column without any value is 0, a single column is filled with its mean.
    """
    columns, spark = list(columns), df.sparkSession
    order, means, known = _order(df, columns)
    plain = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})
    learned = [c for c in order if known[c]]
    if not learned or rounds < 1 or len(columns) < 2:
        return plain
    job = repr((columns, sorted(known.items()), df.count(), trees, depth, seed, key))
    home = f"{root.rstrip('/')}/chain-{hashlib.sha256(job.encode()).hexdigest()[:16]}" if root else work_folder(spark, "chain")
    if key is None:
        key = "_row"
        while key in df.columns:
            key += "_"
        df = _written(df.withColumn(key, F.monotonically_increasing_id()), f"{home}/rows")
    narrow = _written(spread(df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])), f"{home}/narrow")
    if narrow.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} does not tell rows apart")
    gap = F.greatest(*[F.col(c).isNull() for c in columns])
    whole = narrow.where(~gap).select(*columns)
    cuts = dict(zip(columns, forests.bounds(narrow, columns), strict=True))
    last = 0
    for done in range(1, rounds + 1):
        if exists(spark, f"{home}/round_{done}/_SUCCESS"):
            last = done
    for turn in range(last + 1, rounds + 1):
        state = spark.read.parquet(f"{home}/round_{turn - 1}") if turn > 1 else _start(narrow.where(gap), columns, means)
        models: list[tuple[str, regressor.Model]] = []
        for c in learned:
            forest = regressor.SummedForest([o for o in columns if o != c], cuts, means[c], labelCol=c, numTrees=trees, maxDepth=depth, seed=seed)
            present = regressor.filled(state, models).where(~F.col(f"_gap_{c}")).select(*columns)
            models.append((c, forest.fit(whole.unionByName(present))))
        state = regressor.filled(state, models)
        state.write.mode("overwrite").parquet(f"{home}/round_{turn}")
        if turn > 1:
            remove(spark, f"{home}/round_{turn - 1}")
    filled = spark.read.parquet(f"{home}/round_{rounds}").select(key, *[F.col(c).alias(f"_filled_{c}") for c in columns])
    values = {c: F.coalesce(F.col(f"_filled_{c}"), F.col(c).cast("double")) for c in columns}
    return df.join(filled, key, "left").withColumns(values).select(*plain.columns)


def chained(df: DataFrame, columns: Sequence[str], rounds: int = 10, estimator: str = "linear", trees: int = 10,
            seed: int = 42, depth: int = 5, key: str | None = None, root: str | None = None) -> DataFrame:
    if estimator == "linear":
        return ChainedLinear.fit(df, columns, rounds).apply(df)
    return chained_forest(df, columns, rounds, trees, depth, seed, key, root)


def forest_category(df: DataFrame, column: str, target: str | None = None, keys: Sequence[str] = (),
                    trees: int = 50, depth: int = 5, seed: int = 42, learn: Column | None = None) -> tuple[DataFrame, str]:
    """Gaps of a text column predicted by a forest from well-filled columns; the mode when that cannot work.

    Returns the table and the method used. The target never serves as predictor. ``learn`` marks the rows that everything is fitted
    on, as the training rows; all rows are by default.
    """
    from .schema import roles

    found = roles(df, target, keys)
    base = df if learn is None else df.where(learn)
    n, gaps = impute.missing_counts(base)
    numeric = [c for c in found.numeric if n - gaps[c] > 0.8 * n]
    text = [c for c in found.text if c != column and gaps[c] / n < 0.1] if n else []
    values = {c: encode.levels(base, c) for c in text}
    dummies = [f"{c}_{v}" for c in text for v in values[c]]
    if n - gaps[column] <= MIN_KNOWN or len(numeric) + len(dummies) < MIN_FEATURES:
        return impute.fit_mode(base, [column]).apply(df), "mode"
    fills = {c: 0.0 if m is None else m for c, m in quantiles.medians(base, numeric).items()}
    classes = encode.LabelCodec.fit(base, column)

    def packed(rows: DataFrame) -> DataFrame:
        ready = encode.one_hot(rows, text, values) if text else rows
        names = []
        for i, c in enumerate(numeric):
            ready = ready.withColumn(f"_n{i}", F.coalesce(F.col(c), F.lit(fills[c])))
            names.append(f"_n{i}")
        return VectorAssembler(inputCols=[*names, *dummies], outputCol="_x").transform(ready).drop(*names, *dummies)

    known, unknown = df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull())
    forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", numTrees=trees,
                                    maxDepth=depth, seed=seed)
    model = forest.fit(packed(spread(base.where(F.col(column).isNotNull()))).withColumn("_y", classes.encode(column).cast("double")))
    filled = model.transform(packed(unknown)).withColumn(column, classes.decode("_p")).select(*df.columns)
    return known.unionByName(filled), "forest"
