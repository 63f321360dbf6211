"""The whole study: raw visits to a selected, calibrated, explained model, stage by stage.

Every stage writes its table under ``root`` and the next one reads it, so a failed run resumes from the
last written stage and no plan spans the whole study.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    auto_impute,
    balance,
    baselines,
    chained,
    curves,
    encode,
    errors,
    explain,
    features,
    impute,
    metrics,
    models,
    outliers,
    profile,
    relevance,
    scaling,
    schema,
    selection,
    smote,
    split,
    study,
)
from ..sources import tables


@dataclass(frozen=True)
class Study:
    """What to study and how. A model kind in ``tuned`` without settings of its own is searched over its grid (``models.GRIDS`` unless
    ``grids`` has another); the boosted grid takes 1,620 fits, so it is searched only where it is asked for."""

    key: str = "visit_id"
    target: str = "triage"
    numeric: Sequence[str] = ("age", "hr", "sbp", "dbp", "spo2", "temp", "gcs", "pain")
    vitals: Sequence[str] = ("hr", "spo2", "sbp", "dbp", "temp", "gcs")
    text: Sequence[str] = ()
    seed: int = 42
    rounds: int = 10
    category_trees: int = 50
    vif_limit: float = features.VIF_LIMIT
    protect: Sequence[str] = ()  # features that collinearity never removes
    target_ratio: float = 2.0
    boosted: dict | None = None
    forest: dict | None = None
    logistic: dict | None = None
    tuned: Sequence[str] = ("forest", "logistic")
    grids: Mapping[str, Mapping] = field(default_factory=dict)
    folds: int = 5
    curve: dict = field(default_factory=dict)  # arguments of the learning curve other than its defaults
    explained_rows: int | None = None  # a repeatable sample of so many test rows; None explains all
    background: int = 100


def _fill_text(rows: DataFrame, s: Study, root: str) -> DataFrame:
    """Gaps of the text columns: the mode for few, a forest for many, both learned on training rows."""
    learn = F.col("split") == "train"
    n, gaps = impute.missing_counts(rows.where(learn), list(s.text))
    few = [c for c in s.text if n and gaps[c] / n < auto_impute.Policy().mode_below]
    rows = impute.fit_mode(rows.where(learn), few).apply(rows) if few else rows
    log = [(c, "mode", "", gaps[c]) for c in few]
    for c in [c for c in s.text if c not in few]:
        rows, method = chained.forest_category(rows, c, s.target, [s.key, "split"], s.category_trees, seed=s.seed, learn=learn)
        log.append((c, method, f"trees={s.category_trees}" if method == "forest" else "", gaps[c]))
    tables.write_report(impute.log_frame(rows, log), root, "text_fills")
    return rows


def prepare(spark: SparkSession, raw: DataFrame, root: str, s: Study = Study()) -> list[str]:
    """Coerce, split, then fit fills, bounds, scales and the choice of features on training rows only. Returns the model features."""
    rows = schema.to_numeric(raw, s.numeric)
    rows = split.stratified(rows, s.target, s.key, seed=s.seed)
    tables.write_stage(rows, root, "split")
    rows = tables.read_stage(spark, root, "split")
    train = rows.where(F.col("split") == "train")
    tables.write_report(profile.missing(train.select(*s.numeric, *s.text, s.target)), root, "missing")

    marks = impute.indicator_columns(train, columns=[*s.numeric, *s.text])
    chain = chained.ChainedLinear.fit(train, list(s.vitals), s.rounds)
    others = [c for c in s.numeric if c not in s.vitals]
    fill = impute.fit_median(train, others)
    filled = fill.apply(chain.apply(impute.indicators(rows, marks)))
    tables.write_stage(_fill_text(filled, s, root) if s.text else filled, root, "imputed")
    full = tables.read_stage(spark, root, "imputed")
    after = full.where(F.col("split") == "train")
    tables.write_report(impute.quality(train, after, list(s.numeric), list(s.text)), root, "imputation_quality")
    tables.write_report(impute.success_rate(train, after, [*s.numeric, *s.text]), root, "imputation_success")
    tables.write_report(outliers.outlier_report(after, list(s.numeric)), root, "outliers")
    winsor = outliers.Winsor.fit(after, list(s.numeric))
    tables.write_report(winsor.log(rows), root, "winsorized")
    full = winsor.apply(full)
    full, new = features.add_clinical(full, features.fit_shock_index(full.where(F.col("split") == "train")))
    tables.write_stage(full, root, "features")

    full = tables.read_stage(spark, root, "features")
    train = full.where(F.col("split") == "train")
    values = {c: encode.levels(train, c) for c in s.text}
    dummies = [f"{c}_{v}" for c in s.text for v in values[c]]
    full = encode.one_hot(full, list(s.text), values)
    kinds = dict(full.dtypes)
    plain = [c for c in [*s.numeric, *new, *[f"{m}_was_missing" for m in marks]] if kinds[c] != "string"]
    wanted = [*plain, *dummies]
    scaler = scaling.Scaler.fit(train, scaling.scalable_columns(train.select(*plain), None), "robust")
    tables.save_state(spark, scaler.state(), root, "scaler")
    scaled = scaler.apply(full).select(s.key, s.target, "split", *[F.col(f"`{c}`").cast("double").alias(c) for c in wanted])
    tables.write_stage(scaled, root, "scaled")
    train = tables.read_stage(spark, root, "scaled").where(F.col("split") == "train")
    kept, removed = features.Collinearity.fit(train, wanted).eliminate(s.vif_limit, s.protect)
    tables.write_report(spark.createDataFrame(removed, "step int, feature string, vif double"), root, "collinear")
    tables.write_report(relevance.rank(train, kept, s.target), root, "relevance")
    return kept


def resample(spark: SparkSession, root: str, feats: Sequence[str], s: Study = Study()) -> dict[str, float]:
    """Endangered-row synthesis on the training rows, gates, class weights."""
    train = tables.read_stage(spark, root, "scaled").where(F.col("split") == "train").select(s.key, s.target, *feats)
    goals = balance.target_table(train, s.target, ir=s.target_ratio)
    new = smote.borderline(train, s.target, feats, goals, s.key, seed=s.seed)
    tables.write_stage(smote.with_synthetic(train, new, s.target, feats, s.key, goals), root, "train_resampled")
    after = tables.read_stage(spark, root, "train_resampled")
    tables.write_report(balance.quality_checks(train, after, s.target, s.target_ratio), root, "quality_checks", "json")
    return balance.weight_table(after, s.target)


def settle(spark: SparkSession, root: str, feats: Sequence[str], weights: dict[str, float], s: Study = Study()) -> dict[str, dict]:
    """Settings of each model kind: those given, else the best of its grid over stratified folds of the training rows."""
    train = balance.attach_weights(tables.read_stage(spark, root, "train_resampled"), s.target, weights)
    chosen = {kind: dict(getattr(s, kind) or {}) for kind in models.TRAINERS if hasattr(s, kind)}
    for kind in chosen:
        if kind in s.tuned and getattr(s, kind) is None:
            grid = s.grids.get(kind, models.GRIDS[kind])
            folds = split.kfold(train, s.target, s.key, s.folds, s.seed)
            tables.write_report(models.tune(folds, kind, feats, s.target, "fold", "weight", grid), root, f"tuning_{kind}", "json")
            found = spark.read.schema("setting int, mean_score double").json(f"{root}/reports/tuning_{kind}.json")
            chosen[kind] = models.best_settings(found, grid)
    tables.save_state(spark, chosen, root, "settings")
    return chosen


def develop(spark: SparkSession, root: str, feats: Sequence[str], weights: dict[str, float], s: Study = Study()) -> str:
    """Fit three models, vote, calibrate on half of the validation rows, choose by score and gap on the other half."""
    train = balance.attach_weights(tables.read_stage(spark, root, "train_resampled"), s.target, weights)
    chosen = settle(spark, root, feats, weights, s)
    fitted = {kind: models.TRAINERS[kind](train, feats, s.target, "weight", **({"seed": s.seed} if kind != "logistic" else {}), **chosen[kind])
              for kind in ("boosted", "forest", "logistic")}
    classes = fitted["forest"].classes
    for name, m in fitted.items():
        m.save(spark, root, name)
    tables.write_report(models.importance(spark, fitted, models.BLEND), root, "importance")

    rows = tables.read_stage(spark, root, "scaled")
    for name, m in fitted.items():
        rows = m.score(rows, name, f"{name}_prediction")
    rows = models.soft_vote(rows, list(fitted), classes, prefix="ensemble").withColumnRenamed("prediction", "ensemble_prediction")
    tables.write_stage(rows.drop(*feats), root, "scored")
    rows = tables.read_stage(spark, root, "scored")
    held = split.halves(rows.where(F.col("split") == "validation"), s.target, s.key, column="half")
    scores = {c: f"ensemble_{c}" for c in classes}
    calibrator = models.Calibrator.fit(held.where(F.col("half") == "calibrate"), s.target, scores)
    rows = calibrator.apply(rows, scores, "calibrated")
    rows = rows.withColumn("calibrated_prediction", models.arg_max({c: F.col(f"calibrated_{c}") for c in classes}))
    chosen = rows.join(held.where(F.col("half") == "calibrate").select(s.key), s.key, "left_anti")
    tables.write_stage(chosen, root, "predictions")

    chosen = tables.read_stage(spark, root, "predictions").where(F.col("split").isin("train", "validation"))
    names = [*fitted, "ensemble", "calibrated"]
    long = chosen.select("split", F.col(s.target).alias("y"), schema.rows(
        *[{"model": n, "p": F.col(f"{n}_prediction")} for n in names]).alias("m")).select("split", "y", "m.*")
    tables.write_report(selection.compare(long, "y", "p"), root, "comparison")
    return selection.select(long, "y", "p", names).first()["model"]


def compare(spark: SparkSession, root: str, feats: Sequence[str], best: str, s: Study = Study()) -> None:
    """The chosen model against the reference predictors on the test rows: scores of each, and a paired test with each."""
    scaled, raw = tables.read_stage(spark, root, "scaled"), tables.read_stage(spark, root, "features")
    train, rows = (scaled.where(F.col("split") == part) for part in ("train", "test"))
    for name, m in baselines.learned(train, feats, s.target).items():
        rows = m.score(rows, f"_{name}", name)
    rows = baselines.dummy(train, rows, s.target, "majority").select(s.key, "majority", "logistic", "tree")
    if {"hr", "sbp", "spo2", "temp"} <= set(raw.columns):
        rows = rows.join(baselines.rules(raw, "rules").select(s.key, "rules"), s.key)
    names = [c for c in rows.columns if c != s.key]
    test = tables.read_stage(spark, root, "predictions").where(F.col("split") == "test").select(
        s.key, s.target, F.col(f"{best}_prediction").alias(best + "_chosen"))
    tables.write_stage(test.join(rows, s.key), root, "baselines")
    rows = tables.read_stage(spark, root, "baselines")
    long = rows.select(F.col(s.target).alias("y"), schema.rows(
        *[{"model": n, "p": F.col(n)} for n in [best + "_chosen", *names]]).alias("m")).select("y", "m.*")
    tables.write_report(metrics.summary(long, "y", "p", ["model"]), root, "baselines")
    pairs = [study.mcnemar(rows, rows, s.key, s.target, best + "_chosen", other=n) | {"baseline": n} for n in names]
    tables.write_report(spark.createDataFrame([(r["baseline"], r["only_a"], r["only_b"], r["statistic"], r["p_value"]) for r in pairs],
                                              "baseline string, only_chosen long, only_baseline long, statistic double, p_value double"),
                        root, "paired_tests")


def groups(feats: Sequence[str], s: Study = Study()) -> dict[str, list[str]]:
    """Feature groups for the ablation: vitals, other measurements, marks of missing values, text values, what was derived."""
    kinds = {"vitals": lambda c: c in s.vitals, "other": lambda c: c in s.numeric, "missing": lambda c: c.endswith("_was_missing"),
             "text": lambda c: any(c.startswith(f"{t}_") for t in s.text), "derived": lambda c: True}
    out: dict[str, list[str]] = {}
    for c in feats:
        out.setdefault(next(k for k, fits in kinds.items() if fits(c)), []).append(c)
    return out


def examine(spark: SparkSession, root: str, feats: Sequence[str], best: str, s: Study = Study()) -> None:
    """Who the chosen model serves worse, what more rows would bring, and what each group of features brings."""
    raw = tables.read_stage(spark, root, "features")
    dims = [c for c in ("age_category", *s.text) if c in raw.columns]
    if dims:
        test = tables.read_stage(spark, root, "predictions").where(F.col("split") == "test").select(s.key, s.target, f"{best}_prediction")
        test = test.join(raw.select(s.key, *[F.col(c).alias(f"_by_{c}") for c in dims]), s.key)
        tables.write_report(study.subgroups(test, s.target, f"{best}_prediction", {c: F.col(f"_by_{c}") for c in dims}), root, "subgroups")
    rows, settings = tables.read_stage(spark, root, "scaled"), tables.load_state(spark, root, "settings")["forest"]
    train, test = (rows.where(F.col("split") == part) for part in ("train", "test"))
    tables.write_report(study.learning_curve(train, feats, s.target, s.key, seed=s.seed, **s.curve), root, "learning_curve")
    parts = groups(feats, s)
    if len(parts) > 1:
        tables.write_report(study.ablation(train, test, parts, s.target, seed=s.seed, **settings), root, "ablation")


def evaluate(spark: SparkSession, root: str, feats: Sequence[str], best: str, s: Study = Study()) -> DataFrame:
    """Reports on the untouched test rows, and attributions of the boosted model."""
    test = tables.read_stage(spark, root, "predictions").where(F.col("split") == "test")
    p, classes = f"{best}_prediction", models.Fitted.load(spark, root, "boosted").classes
    scores = {c: f"{best}_{c}" for c in classes}
    tables.write_report(metrics.report(test, s.target, p, scores), root, "classification")
    tables.write_report(metrics.confusion(test, s.target, p, classes), root, "confusion")
    tables.write_report(curves.roc_curve(test, s.target, scores), root, "roc")
    tables.write_report(curves.pr_curve(test, s.target, scores), root, "pr")
    tables.write_report(curves.calibration(test, s.target, scores), root, "calibration")
    tables.write_report(errors.error_counts(test, s.target, p), root, "errors")
    tables.write_report(errors.high_risk(models.detailed_predictions(test, s.target, p, scores, s.key),
                                         "true_label", "predicted_label"), root, "high_risk")
    tables.write_report(study.bootstrap_from_table(test, s.target, p), root, "intervals")
    rows = tables.read_stage(spark, root, "scaled").where(F.col("split") == "test")
    phi = explain.sampled(models.Fitted.load(spark, root, "boosted"), rows, s.key, s.background, s.explained_rows, seed=s.seed)
    tables.write_stage(phi, root, "attributions")
    tables.write_report(explain.global_importance(tables.read_stage(spark, root, "attributions")), root, "attribution_ranking")
    return metrics.summary(test, s.target, p)


def run(spark: SparkSession, raw: DataFrame, root: str, s: Study = Study()) -> DataFrame:
    """The study from raw rows to the test summary of the chosen model."""
    feats = prepare(spark, raw, root, s)
    weights = resample(spark, root, feats, s)
    best = develop(spark, root, feats, weights, s)
    compare(spark, root, feats, best, s)
    examine(spark, root, feats, best, s)
    return evaluate(spark, root, feats, best, s).withColumn("model", F.lit(best))
