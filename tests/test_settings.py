"""The registered queries of the reference's operators run with its settings."""

from unittest.mock import MagicMock

import pytest

from riskframe.operators import models
from riskframe.plans import queries as Q


@pytest.fixture
def calls(spark, monkeypatch):
    """Runs a registered query over stand-ins and returns what it passed to an operator: positional and named arguments."""
    for name in ("visits", "_mixed", "_training", "_ready", "r6"):
        monkeypatch.setattr(Q, name, MagicMock())
    monkeypatch.setattr(Q.split, "stratified", MagicMock())

    def run(query, module, *names):
        found = []
        for name in names:
            operator = MagicMock()
            operator.return_value.__iter__.return_value = iter((MagicMock(), MagicMock()))
            operator.return_value.classes = ("RED",)
            monkeypatch.setattr(module, name, operator)
            found.append(operator)
        for kind in ("boosted", "forest"):
            if module is models and kind in names:
                monkeypatch.setitem(models.TRAINERS, kind, found[names.index(kind)])
        Q.QUERIES[query](None, None)
        return [operator.call_args for operator in found]

    return run


def in_grid(kind, given):
    return given["n_estimators"] in models.GRIDS[kind]["n_estimators"] and all(v in models.GRIDS[kind][k] for k, v in given.items())


def test_trained_models(calls, monkeypatch):
    assert in_grid("boosted", calls("boosted_trees", models, "boosted")[0].kwargs)
    assert in_grid("forest", calls("random_forest", models, "forest")[0].kwargs)
    monkeypatch.setattr(models, "importance", MagicMock())
    boosted, forest, logistic = calls("feature_importance", models, "boosted", "forest", "logistic")
    assert in_grid("boosted", boosted.kwargs) and in_grid("forest", forest.kwargs) and logistic.kwargs.get("max_iter", 1000) == 1000
    monkeypatch.setattr(Q.explain, "sampled", MagicMock())
    assert in_grid("forest", calls("shapley_sampled", models, "forest")[0].kwargs)


def test_study(calls):
    assert in_grid("forest", calls("ablation", Q.study, "ablation")[0].kwargs)
    assert in_grid("forest", calls("temporal_validation", Q.study, "temporal_validation")[0].kwargs)
    curve = calls("learning_curve", Q.study, "learning_curve")[0]
    assert len(curve.args) == 4 and not curve.kwargs  # the operator's defaults are the reference's ten sizes and three folds


def test_fills(calls):
    assert calls("impute_chained_forest", Q.chained, "chained")[0].kwargs == {"rounds": 10, "estimator": "forest", "trees": 10}
    assert calls("impute_forest_category", Q.chained, "forest_category")[0].kwargs == {"trees": 50}
    for query in ("impute_auto", "imputation_log"):
        policy = calls(query, Q.auto_impute, "auto")[0].args[3]
        assert (policy.rounds, policy.category_trees) == (10, 50)


def test_search_covers_the_grid_and_refits(spark, monkeypatch):
    """Without a grid every setting of GRIDS is tried on every fold, and the best is fitted again on all rows."""
    tried = []

    class Constant:
        def __init__(self, c):
            self.answer = "a" if c == 0.5 else "b"

        def score(self, df):
            return df.withColumn("prediction", Q.F.when(Q.F.col("x") > 0, "b").otherwise(self.answer))

    def trainer(df, features, y, weight, C, codec=None):
        tried.append((C, df.count()))
        return Constant(C)

    monkeypatch.setitem(models.TRAINERS, "logistic", trainer)
    rows = [(float(i % 2), "ab"[i % 2], i % 4 // 2) for i in range(8)]
    table, _ = models.search(spark.createDataFrame(rows, "x double, y string, fold int"), "logistic", ["x"], "y", "fold")
    assert table.count() == 4
    assert sorted(tried[:-1]) == sorted((c, 4) for c in models.GRIDS["logistic"]["C"] for _ in range(2))
    assert tried[-1] == (0.5, 8)


def test_registered_search(calls, monkeypatch):
    monkeypatch.setattr(Q.metrics, "summary", MagicMock())
    monkeypatch.setattr(Q.F, "broadcast", MagicMock())
    kfold = MagicMock()
    monkeypatch.setattr(Q.split, "kfold", kfold)
    got = calls("grid_search_cv", models, "search")[0]
    assert kfold.call_args.args[-1] == 5 and len(got.args) == 6 and not got.kwargs  # no grid of its own
