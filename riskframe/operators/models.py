"""Distributed training: boosted trees, forest, multinomial logistic, single tree; tuning, voting, calibration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, slices, spread
from ..sources import tables
from . import boosters, forests, grown, metrics
from .encode import LabelCodec

# The full search grids, weights of the vote and of the blended importance.
GRIDS = {
    "boosted": {
        "max_depth": [4, 5, 6], "learning_rate": [0.03, 0.05, 0.1], "n_estimators": [150, 200, 250],
        "min_child_weight": [3, 5, 7], "subsample": [0.7, 0.8], "colsample": [0.7, 0.8],
    },
    "forest": {
        "n_estimators": [150, 200, 250], "max_depth": [15, 18, 20, 30], "min_samples_leaf": [5, 8, 10],
        "max_features": ["sqrt", "log2"], "max_samples": [0.7, 0.8, 0.9],
    },
    "logistic": {"C": [0.1, 0.5, 1.0, 2.0]},
}
VOTE_WEIGHTS = (2.0, 2.0, 1.0)
BLEND = {"boosted": 0.4, "forest": 0.4, "logistic": 0.2}
#: Models that are not MLlib's.
OWN = (forests.Forest, boosters.Boosters)
LOADERS = {"forest": forests.Forest.load, "boosted": boosters.Boosters.load}


def pack(df: DataFrame, features: Sequence[str], column: str = "features") -> DataFrame:
    """Feature vector. Gaps must be filled before: a NULL stops the job instead of being guessed."""
    return VectorAssembler(inputCols=list(features), outputCol=column, handleInvalid="error").transform(df)


def arg_max(scores: Mapping[str, Column]) -> Column:
    """Name with the highest score, the first one on a tie."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.lit(None).cast("string")
    for name in reversed(list(scores)):
        out = F.when(scores[name] == best, name).otherwise(out)
    return out


@dataclass(frozen=True)
class Fitted:
    """A trained classifier: one multi-class model, or one binary model per class."""

    kind: str
    classes: tuple[str, ...]
    features: tuple[str, ...]
    parts: tuple

    def probabilities(self, df: DataFrame, prefix: str = "p") -> DataFrame:
        """Adds ``<prefix>_<class>`` columns; several binary models are normalised to sum 1."""
        out = pack(df, self.features, "_x")
        for i, m in enumerate(self.parts):
            if isinstance(m, OWN):
                out = m.scored(out, self.features, f"_prob{i}")
                continue
            m = m.copy()
            m.setFeaturesCol("_x").setProbabilityCol(f"_prob{i}").setRawPredictionCol(f"_raw{i}").setPredictionCol(
                f"_pred{i}")
            out = m.transform(out).drop(f"_raw{i}", f"_pred{i}")
        if len(self.parts) == 1:
            votes = isinstance(self.parts[0], OWN)
            share = F.col("_prob0") if votes else vector_to_array(F.col("_prob0"))
            total = reduce(lambda a, b: a + b, [share[i] for i in range(len(self.classes))]) if votes else F.lit(1.0)
            cells = {c: F.coalesce(F.try_divide(share[i], total), F.lit(1.0 / len(self.classes))) for i, c in enumerate(self.classes)}
        else:
            out = out.withColumns({f"_one{i}": vector_to_array(F.col(f"_prob{i}"))[1] for i in range(len(self.parts))})
            total = reduce(lambda a, b: a + b, [F.col(f"_one{i}") for i in range(len(self.parts))])
            even = F.lit(1.0 / len(self.classes))
            cells = {c: F.coalesce(F.try_divide(F.col(f"_one{i}"), total), even) for i, c in enumerate(self.classes)}
        added = [v.alias(f"{prefix}_{c}") for c, v in cells.items()]
        return out.select(*df.columns, *added)

    def score(self, df: DataFrame, prefix: str = "p", prediction: str = "prediction") -> DataFrame:
        """Probabilities and the most likely class."""
        out = self.probabilities(df, prefix)
        return out.withColumn(prediction, arg_max({c: F.col(f"{prefix}_{c}") for c in self.classes}))

    def save(self, spark: SparkSession, root: str, name: str) -> None:
        for i, part in enumerate(self.parts):
            if isinstance(part, OWN):
                part.save(spark, root, f"{name}-{i}")
            else:
                tables.save_model(part, root, f"{name}-{i}")
        tables.save_state(spark, {"kind": self.kind, "classes": self.classes, "features": self.features,
                                  "parts": len(self.parts)}, root, name)

    @classmethod
    def load(cls, spark: SparkSession, root: str, name: str) -> Fitted:
        s = tables.load_state(spark, root, name)
        return cls(s["kind"], tuple(s["classes"]), tuple(s["features"]),
                   tuple(LOADERS[s["kind"]](spark, root, f"{name}-{i}") if s["kind"] in LOADERS else tables.load_model(spark, root, f"{name}-{i}")
                         for i in range(s["parts"])))


def _labelled(df: DataFrame, features: Sequence[str], y: str, codec: LabelCodec, weight: str | None) -> DataFrame:
    """Label, vector and weight in even cached parts: every training iteration reads them."""
    cols = [codec.encode(y).cast("double").alias("label"), "features"] + ([weight] if weight else [])
    lean = df.select(*features, y, *([weight] if weight else []))
    return pack(spread(lean), features).select(*cols).persist()


def boosted(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, max_depth: int = 4,
            learning_rate: float = 0.1, n_estimators: int = 200, min_child_weight: int = 3, subsample: float = 0.8,
            colsample: float = 0.8, seed: int = 42, codec: LabelCodec | None = None) -> Fitted:
    """Gradient-boosted trees, one binary booster per class, all grown by the same passes (see ``boosters``).

    ``colsample`` is the share of the features that a node tries.
    """
    codec = codec or LabelCodec.fit(df, y)
    lean = spread(df.select(*features, codec.encode(y).alias("_label"), *([weight] if weight else []))).persist()
    try:
        model = boosters.grow(lean, features, "_label", len(codec.classes), weight, max_depth, learning_rate, n_estimators, min_child_weight, subsample,
                              max(math.ceil(colsample * len(features)), 1), seed)
    finally:
        lean.unpersist()
    return Fitted("boosted", codec.classes, tuple(features), (model,))


def _single(kind: str, estimator, df, features, y, weight, codec) -> Fitted:
    codec = codec or LabelCodec.fit(df, y)
    if weight:
        estimator = estimator.setWeightCol(weight)
    data = _labelled(df, features, y, codec, weight)
    try:
        return Fitted(kind, codec.classes, tuple(features), (estimator.fit(data),))
    finally:
        data.unpersist()


def forest(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, n_estimators: int = 200,
           max_depth: int = 18, min_samples_leaf: int = 5, max_features: str = "sqrt", max_samples: float = 0.8,
           seed: int = 42, codec: LabelCodec | None = None) -> Fitted:
    """Trees whose large nodes are split by summed histograms and whose small ones are grown where their rows meet (see ``forests``)."""
    codec = codec or LabelCodec.fit(df, y)
    lean = spread(df.select(*features, codec.encode(y).alias("_label"), *([weight] if weight else []))).persist()
    try:
        cuts = forests.bounds(lean, features)
        rows, sizes = forests.blocks(lean, features, "_label", cuts, weight)
    finally:
        lean.unpersist()
    plot = grown.Plot(0, -1, 0, min_samples_leaf, grown.picked(max_features, len(features)), max_samples, (n_estimators,), (max_depth,))
    model = forests.grow(rows, sizes, plot, cuts, len(codec.classes), seed)
    return Fitted("forest", codec.classes, tuple(features), (model,))


def logistic(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, C: float = 1.0,
             max_iter: int = 1000, codec: LabelCodec | None = None) -> Fitted:
    """Multinomial logistic with an L2 penalty of strength 1/C over the summed loss."""
    total = df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    return _single("logistic", LogisticRegression(
        family="multinomial", elasticNetParam=0.0, regParam=1.0 / (C * max(total, 1)), maxIter=max_iter,
        standardization=False), df, features, y, weight, codec)


def tree(df: DataFrame, features: Sequence[str], y: str, weight: str | None = None, max_depth: int = 5,
         seed: int = 42, codec: LabelCodec | None = None) -> Fitted:
    return _single("tree", DecisionTreeClassifier(maxDepth=max_depth, seed=seed), df, features, y, weight, codec)


TRAINERS: dict[str, Callable[..., Fitted]] = {"boosted": boosted, "forest": forest, "logistic": logistic, "tree": tree}


#: What a forest setting means where the grid does not name it.
FOREST_DEFAULTS = {"n_estimators": 200, "max_depth": 18, "min_samples_leaf": 5, "max_features": "sqrt", "max_samples": 0.8}


def forest_plots(settings: Sequence[Mapping], folds: Sequence[int], features: int) -> tuple[list[grown.Plot], dict[int, list[tuple[int, int, int]]]]:
    """One fit per fold and way to grow trees, and for each fit the settings read from it: (setting, trees, depth).

    Settings that differ in their number of trees or depth only, or in the name of the same number of features, share a fit.
    """
    ways: dict[tuple, list] = {}
    for at, given in enumerate(settings):
        s = {**FOREST_DEFAULTS, **given}
        way = (s["min_samples_leaf"], grown.picked(s["max_features"], features), s["max_samples"])
        ways.setdefault(way, []).append((at, s["n_estimators"], s["max_depth"]))
    plots, read = [], {}
    for way, members in ways.items():
        for fold in folds:
            read[len(plots)] = members
            plots.append(grown.Plot(len(plots), fold, 0, *way, tuple(sorted({m[1] for m in members})), tuple(sorted({m[2] for m in members}))))
    return plots, read


def _tuned_together(data: DataFrame, settings: Sequence[Mapping], folds: Sequence[int], features, y: str, fold: str, weight: str | None,
                    codec: LabelCodec, evaluate: Callable[..., DataFrame]) -> list[tuple]:
    """(setting, fold, held-out score, training score) of every forest setting, from shared fits."""
    plots, read = forest_plots(settings, folds, len(features))
    rows = data.where(F.col(y).isNotNull()).withColumn("_label", codec.encode(y))
    cells = evaluate(rows, features, "_label", plots, fold, weight=weight, classes=len(codec.classes))
    found = {(r["plot"], r["trees"], r["depth"], r["held"]): r["balanced_accuracy"]
             for r in metrics.from_counts(cells, ["plot", "trees", "depth", "held"]).collect()}  # a row per fit, prefix and depth
    return [(at, p.fold, found.get((p.at, trees, depth, True)), found.get((p.at, trees, depth, False)))
            for p in plots for at, trees, depth in read[p.at]]


def tune(df: DataFrame, kind: str, features: Sequence[str], y: str, fold: str, weight: str | None = None,
         grid: Mapping[str, Sequence] | None = None, parallelism: int = 3, shared_rows: int = grown.ROWS) -> DataFrame:
    """Grid search over stratified folds by balanced accuracy: one row per setting, best first. Without a grid, all of GRIDS.

    Forests share fits: over at most ``shared_rows`` rows a fit is a task (see ``grown``), over more all tasks work on it (see
    ``forests``). Other kinds have a distributed fit per setting and fold, whose one scoring pass yields both the held-out and
    the training score.
    """
    grid = grid or GRIDS[kind]
    settings = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    data = spread(df.select(*features, y, fold, *([weight] if weight else []))).persist()
    codec = LabelCodec.fit(data, y)
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())

    def run(task):
        at, held = task
        model = TRAINERS[kind](data.where(F.col(fold) != held), features, y, weight, codec=codec, **settings[at])
        scored = model.score(data.select(*features, y, fold)).withColumn("_held", F.col(fold) == held)
        found = {r["_held"]: r["balanced_accuracy"] for r in metrics.summary(scored, y, "prediction", ["_held"]).collect()}
        return at, held, found.get(True), found.get(False)

    try:
        if kind == "forest" and set(grid) <= set(FOREST_DEFAULTS):
            evaluate = grown.evaluate if data.count() <= shared_rows else forests.evaluate
            rows = _tuned_together(data, settings, folds, features, y, fold, weight, codec, evaluate)
        else:
            with ThreadPool(parallelism) as pool:  # several Spark jobs at once; the fits themselves run on executors
                rows = pool.map(run, list(product(range(len(settings)), folds)))
    finally:
        data.unpersist()
    long = df.sparkSession.createDataFrame(
        [(kind, str(settings[a]), a, h, float(v), float(t)) for a, h, v, t in rows],
        "model string, params string, setting int, fold int, score double, train_score double")
    return (long.groupBy("model", "setting", "params").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"),
        F.avg("train_score").alias("mean_train_score")).orderBy(F.desc("mean_score"), "setting"))


def best_settings(table: DataFrame, grid: Mapping[str, Sequence]) -> dict:
    at = table.orderBy(F.desc("mean_score"), "setting").first()["setting"]
    return dict(zip(grid, list(product(*grid.values()))[at], strict=True))


def search(df: DataFrame, kind: str, features: Sequence[str], y: str, fold: str, weight: str | None = None,
           grid: Mapping[str, Sequence] | None = None, parallelism: int = 3) -> tuple[DataFrame, Fitted]:
    """The table of ``tune``, and the model refitted on all folds with the best setting."""
    grid = grid or GRIDS[kind]
    table = tune(df, kind, features, y, fold, weight, grid, parallelism)
    return table, TRAINERS[kind](df, features, y, weight, **best_settings(table, grid))


# ---- combining and calibrating scores -------------------------------------------------------------------


def soft_vote(df: DataFrame, models: Sequence[str], classes: Sequence[str],
              weights: Sequence[float] = VOTE_WEIGHTS, prefix: str = "p") -> DataFrame:
    """Weighted mean of ``<model>_<class>`` columns, and the winning class."""
    total = float(sum(weights))
    mean = {c: reduce(lambda a, b: a + b, [F.col(f"{m}_{c}") * F.lit(float(w)) for m, w in zip(models, weights, strict=True)])
            / F.lit(total) for c in classes}
    out = df.withColumns({f"{prefix}_{c}": v for c, v in mean.items()})
    return out.withColumn("prediction", arg_max({c: F.col(f"{prefix}_{c}") for c in classes}))


def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pools of rising means of (class, low, high, hits, weight) rows sorted by class and low: a pool joins the one before as long as its mean is not above.

    Pooling is associative: the pools of several ranges, pooled again, are those of all their rows.
    """
    name, stack = None, []

    def done() -> pa.RecordBatch:
        columns = list(zip(*stack, strict=True)) if stack else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(stack), pa.string()), *[pa.array(c, pa.float64()) for c in columns]],
                                          ["class", "low", "high", "hits", "weight"])

    for batch in batches:
        for c, low, high, hits, weight in zip(*(batch.column(k).to_pylist() for k in ("class", "low", "high", "hits", "weight")), strict=True):
            if c != name:
                if stack:
                    yield done()
                name, stack = c, []
            while stack and stack[-1][2] * weight >= hits * stack[-1][3]:  # counts are whole, so the comparison is exact
                low, hits, weight = stack[-1][0], stack[-1][2] + hits, stack[-1][3] + weight
                stack.pop()
            stack.append((low, high, hits, weight))
    if stack:
        yield done()


POOLS = "class string, low double, high double, hits double, weight double"


def isotonic_pools(df: DataFrame, y: str, scores: Mapping[str, str]) -> DataFrame:
    """POOLS of every class: the isotonic regression of ``y == class`` on its score, in one job for all classes.

    Rows collapse to distinct scores; ranges of them are pooled in their tasks, and what is left, a few thousand pools for any
    number of rows (0/1 labels leave at most about n^(2/3)), is pooled once more in one task per class. No pool passes the driver.
    """
    long = df.where(F.col(y).isNotNull()).select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("class"), F.col(c).cast("double").alias("low"), (F.col(y) == name).cast("double").alias("hit"))
        for name, c in scores.items()])).alias("r")).select("r.*").where(F.col("low").isNotNull() & ~F.isnan("low"))
    steps = long.groupBy("class", "low").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).cast("double").alias("weight"))
    steps = durable(steps.select("class", "low", F.col("low").alias("high"), "hits", "weight"))
    ranges = steps.repartitionByRange(slices(df.sparkSession), "class", "low").sortWithinPartitions("class", "low").mapInArrow(pooled, POOLS)
    return ranges.repartition(len(scores), "class").sortWithinPartitions("class", "low").mapInArrow(pooled, POOLS)


@dataclass(frozen=True)
class Calibrator:
    """One isotonic step function per class."""

    classes: tuple[str, ...]
    parts: tuple

    @classmethod
    def fit(cls, df: DataFrame, y: str, scores: Mapping[str, str]) -> Calibrator:
        """The pools of all classes come first; MLlib's model is then made from their ends, which rise already."""
        pools = durable(isotonic_pools(df, y, scores))
        ends = pools.select("class", F.explode(F.array_distinct(F.array("low", "high"))).alias("features"), F.try_divide("hits", "weight").alias("label"),
                            "weight")

        def model(name: str):
            return IsotonicRegression(weightCol="weight").fit(ends.where(F.col("class") == name).coalesce(1))

        with ThreadPool(len(scores)) as pool:
            return cls(tuple(scores), tuple(pool.map(model, scores)))

    def apply(self, df: DataFrame, scores: Mapping[str, str], prefix: str = "cal") -> DataFrame:
        """Calibrated, renormalised probabilities; equal shares where every class gets 0."""
        out = df
        for i, (name, model) in enumerate(zip(self.classes, self.parts, strict=True)):
            model = model.copy()
            model.setFeaturesCol(scores[name]).setPredictionCol(f"_iso{i}")
            out = model.transform(out)
        total = reduce(lambda a, b: a + b, [F.col(f"_iso{i}") for i in range(len(self.classes))])
        even = F.lit(1.0 / len(self.classes))
        out = out.withColumns({
            f"{prefix}_{c}": F.when(total > 0, F.try_divide(F.col(f"_iso{i}"), total)).otherwise(even)
            for i, c in enumerate(self.classes)})
        return out.drop(*[f"_iso{i}" for i in range(len(self.classes))])


# ---- reading models -------------------------------------------------------------------------------------


def importance_values(model: Fitted) -> dict[str, float]:
    """Shares per feature that sum to 1."""
    if model.kind == "logistic":
        coef = model.parts[0].coefficientMatrix.toArray()
        raw = abs(coef).mean(axis=0)
    else:
        raw = sum(p.featureImportances.toArray() for p in model.parts) / len(model.parts)
    total = float(raw.sum())
    return {f: float(v) / total if total else 0.0 for f, v in zip(model.features, raw, strict=True)}


def importance(spark: SparkSession, models: Mapping[str, Fitted], blend: Mapping[str, float] | None = None) -> DataFrame:
    """(source, feature, importance) per model, and their blend when weights are given."""
    rows = []
    mixed: dict[str, float] = {}
    for name, m in models.items():
        for f, v in importance_values(m).items():
            rows.append((name, f, v))
            mixed[f] = mixed.get(f, 0.0) + (blend or {}).get(name, 0.0) * v
    if blend:
        rows += [("ensemble", f, v) for f, v in mixed.items()]
    return spark.createDataFrame(rows, "source string, feature string, importance double").orderBy(
        "source", F.desc("importance"), "feature")


def detailed_predictions(df: DataFrame, y: str, p: str, scores: Mapping[str, str], key: str) -> DataFrame:
    """One row per scored row: true and predicted label, whether they agree, probability per class."""
    return df.select(key, F.col(y).alias("true_label"), F.col(p).alias("predicted_label"),
                     (F.col(y) == F.col(p)).alias("correct"),
                     *[F.col(c).alias(f"prob_{name}") for name, c in scores.items()])
