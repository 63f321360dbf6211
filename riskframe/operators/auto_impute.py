"""Chooses a fill per column from its share of gaps, and logs what was done."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..session import durable
from . import chained, impute, knn_impute
from .profile import missing_counts
from .schema import roles


@dataclass(frozen=True)
class Policy:
    vitals: Sequence[str] = ("hr", "spo2", "sbp", "dbp", "temp", "gcs")
    median_below: float = 0.10
    mode_below: float = 0.05
    neighbours: int = 5
    predictors: int = 6
    estimator: str = "linear"
    rounds: int = 10
    trees: int = 10
    category_trees: int = 50


def auto(df: DataFrame, target: str, key: str, policy: Policy = Policy(), skip: Sequence[str] = ()
         ) -> tuple[DataFrame, DataFrame]:
    """The filled table with missing-indicators, and the log. Target and keys are left alone."""
    df = durable(df)  # every step reads it
    found = roles(df, target, [key, *skip])
    n, gaps = missing_counts(df)
    marks = [c for c in [*found.numeric, *found.text]
             if n and gaps[c] / n > impute.INDICATOR_SHARE and f"{c}_was_missing" not in df.columns]
    out, log = impute.indicators(df, marks), []

    vitals = [c for c in policy.vitals if c in found.numeric]
    if any(gaps[c] for c in vitals):
        out = chained.chained(out, vitals, policy.rounds, policy.estimator, policy.trees)
        log += [(c, "chained", f"estimator={policy.estimator},rounds={policy.rounds}", gaps[c]) for c in vitals
                if gaps[c]]

    others = [c for c in found.numeric if c not in vitals and gaps[c]]
    simple = [c for c in others if gaps[c] / n < policy.median_below]
    for c in [c for c in others if c not in simple]:
        predictors = [r["feature"] for r in impute.correlated(
            out, c, [x for x in found.numeric if x not in vitals], policy.predictors).collect()]
        if len(predictors) >= 2:
            out = durable(knn_impute.knn(out, c, predictors, key, policy.neighbours))
            log.append((c, "knn", f"k={policy.neighbours},features={'+'.join(predictors)}", gaps[c]))
        else:
            simple.append(c)
    if simple:
        fill = impute.fit_median(out, simple)
        out = fill.apply(out)
        log += [(c, "median", f"value={fill.values[c]}", gaps[c]) for c in simple]

    text = [c for c in found.text if gaps[c]]
    modes = [c for c in text if gaps[c] / n < policy.mode_below]
    if modes:
        fill = impute.fit_mode(out, modes)
        out = fill.apply(out)
        log += [(c, "mode", f"value={fill.values[c]}", gaps[c]) for c in modes]
    for c in [c for c in text if c not in modes]:
        out, method = chained.forest_category(out, c, target, [key, *skip, *[f"{m}_was_missing" for m in marks]],
                                              policy.category_trees)
        log.append((c, method, f"trees={policy.category_trees}" if method == "forest" else "", gaps[c]))
    log += [(c, "indicator", f"share>{impute.INDICATOR_SHARE}", gaps[c]) for c in marks]
    return out, impute.log_frame(df, log)
