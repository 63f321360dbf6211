"""Forests whose large nodes are split by summed histograms and whose small ones are grown where their rows meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import forests, grown, metrics, models

FEATURES = ["f0", "f1", "f2"]


def frame(spark, n=3000, seed=0):
    r = np.random.default_rng(seed)
    x = r.integers(0, 40, (n, 3)).astype(float)
    y = ((x[:, 0] + x[:, 1] + r.integers(0, 25, n)) // 35).clip(0, 2).astype(int)
    rows = [(*map(float, v), int(k), "abc"[k], float(k + 1)) for v, k in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "f0 double, f1 double, f2 double, label int, y string, w double").repartition(6)


def small_sizes(monkeypatch):
    monkeypatch.setattr(forests, "SMALL", 300)
    monkeypatch.setattr(forests, "BLOCK", 128)
    monkeypatch.setattr(forests, "DEALT", 4000)


@pytest.mark.parametrize("small", [False, True])
def test_leaves_hold_the_shares_of_the_drawn_rows(spark, monkeypatch, small):
    if small:
        small_sizes(monkeypatch)
    df = frame(spark)
    cuts = forests.bounds(df, FEATURES)
    rows, sizes = forests.blocks(df, FEATURES, "label", cuts, "w")
    plot = grown.Plot(0, -1, 0, 5, 2, 0.8, (6,), (7,))
    model = forests.grow(rows, sizes, plot, cuts, 3)
    assert all(n <= 300 for _, n in model.upper.groups.values()) == small and sizes == {(0, 0): 3000}
    flat = model.flat(0, 6)
    kept = list(forests.opened(rows.toArrow().to_batches()))
    assert sum(len(b.y) for b in kept) == 3000 and (len(kept) > 12) == small
    for t in range(6):
        mass, drawn = np.zeros((len(flat.child), 3)), np.zeros(len(flat.child))
        for b in kept:
            own, c = b.drawn(plot, t, 42, b.learns(plot))
            at = flat.leaves(int(flat.roots[t]), b.x, own)
            np.add.at(mass, (at, b.y[own]), c * b.w[own])
            np.add.at(drawn, at, c)
        ends = np.flatnonzero(drawn)
        assert len(ends) > 30 and drawn[ends].min() >= 5 and (flat.child[ends] < 0).all() and 2200 < drawn.sum() < 2600
        assert np.allclose(flat.share[ends], mass[ends] / mass[ends].sum(1, keepdims=True), atol=1e-6)


def test_large_nodes_take_the_purest_cut(spark, monkeypatch):
    """One tree that tries all features: its first cut against brute force over the drawn rows."""
    small_sizes(monkeypatch)
    df = frame(spark, 1500, 3)
    cuts = forests.bounds(df, FEATURES)
    rows, sizes = forests.blocks(df, FEATURES, "label", cuts, "w")
    plot = grown.Plot(0, -1, 0, 20, 3, 1.0, (1,), (4,))
    flat = forests.grow(rows, sizes, plot, cuts, 3).flat(0, 1)
    drawn = [(b, *b.drawn(plot, 0, 42, b.learns(plot))) for b in forests.opened(rows.toArrow().to_batches())]
    x, y, n, w = (np.concatenate(v, axis=-1) for v in zip(*[(b.x[:, r], b.y[r], c, c * b.w[r]) for b, r, c in drawn], strict=True))

    def purity(own):
        mass = np.bincount(y[own], w[own], 3)
        return (mass**2).sum() / mass.sum()

    options = [(purity(x[f] <= c) + purity(x[f] > c), f, c) for f in range(3) for c in range(31)
               if min(n[x[f] <= c].sum(), n[x[f] > c].sum()) >= 20]
    best = max(options)
    assert any((flat.feature[0], flat.cut[0]) == o[1:] and o[0] == pytest.approx(best[0]) for o in options)


def test_sizes_do_not_change_how_well_it_learns(spark, monkeypatch):
    df = frame(spark)
    one = models.forest(df, FEATURES, "y", "w", n_estimators=20, max_depth=8)
    small_sizes(monkeypatch)
    other = models.forest(df, FEATURES, "y", "w", n_estimators=20, max_depth=8)
    a, b = (metrics.summary(m.score(df), "y", "prediction").first()["balanced_accuracy"] for m in (one, other))
    assert abs(a - b) < 0.03 and a > 0.7
    shares = [models.importance_values(m) for m in (one, other)]
    assert all(sum(s.values()) == pytest.approx(1.0) and abs(s["f0"] - s["f1"]) < 0.1 > s["f2"] for s in shares)
    again = models.forest(df.repartition(6), FEATURES, "y", "w", n_estimators=20, max_depth=8)
    assert again.parts[0].classes == 3


def test_parts_of_a_large_forest_and_a_saved_one_score_alike(spark, monkeypatch, tmp_path):
    small_sizes(monkeypatch)
    df = frame(spark, 800).withColumn("id", F.monotonically_increasing_id())
    model = models.forest(df, FEATURES, "y", n_estimators=5, max_depth=6)
    want = {r.id: (r.p_a, r.p_b, r.p_c) for r in model.score(df).collect()}
    monkeypatch.setattr(forests, "SCORED", 1)
    assert model.parts[0].ranges() == [(t, t + 1) for t in range(5)]
    model.save(spark, str(tmp_path), "m")
    for m in (model, models.Fitted.load(spark, str(tmp_path), "m")):
        got = m.score(df).collect()
        assert len(got) == 800 and all(np.allclose((r.p_a, r.p_b, r.p_c), want[r.id], atol=1e-9) for r in got)


def test_gaps_and_empty_tables_stop_the_job(spark):
    df = frame(spark, 50)
    for c in ("f1", "w"):
        with pytest.raises(Exception, match="must be filled"):
            models.forest(df.withColumn(c, F.when(F.col("f0") > 9, F.col(c))), FEATURES, "y", "w", n_estimators=2)
    with pytest.raises(ValueError, match="no rows"):
        models.forest(df.limit(0), FEATURES, "y", n_estimators=2)
    model = models.forest(df, FEATURES, "y", n_estimators=2)
    with pytest.raises(Exception, match="must be filled"):
        model.score(df.withColumn("f1", F.lit(None).cast("double"))).collect()


@pytest.mark.parametrize("scored", [128 << 20, 1])
def test_search_beyond_the_shared_rows_agrees_with_shared_fits(spark, monkeypatch, scored):
    """Prefixes, depths, folds and steps of fits by all tasks against fits of a task each, whose draws differ."""
    small_sizes(monkeypatch)
    monkeypatch.setattr(forests, "SCORED", scored)
    df = frame(spark, 1500).withColumn("fold", F.pmod(F.hash("f0", "f1", "f2"), F.lit(3))).withColumn("step", F.pmod(F.xxhash64("f0", "f1", "f2"), F.lit(2)))
    plots = [grown.Plot(0, 0, 1, 5, 2, 0.8, (6, 12), (2, 7)), grown.Plot(1, 1, 0, 5, 2, 0.8, (12,), (7,))]
    one, other = ({(r["plot"], r["trees"], r["depth"], r["held"]): r for r in
                   metrics.from_counts(run.evaluate(df, FEATURES, "label", plots, "fold", "step"), ["plot", "trees", "depth", "held"]).collect()}
                  for run in (grown, forests))
    assert one.keys() == other.keys() and len(one) == 10
    assert all(one[k]["n"] == other[k]["n"] and abs(one[k]["balanced_accuracy"] - other[k]["balanced_accuracy"]) < 0.08 for k in one)


def test_large_searches_have_no_fit_per_setting(spark, monkeypatch):
    """A table beyond ``shared_rows`` shares its fits: nine settings that differ in trees and depth are one fit a fold."""
    grown_plots = []
    whole = forests.grow
    monkeypatch.setattr(forests, "grow", lambda rows, sizes, plot, *a: grown_plots.append(plot) or whole(rows, sizes, plot, *a))
    df = frame(spark, 600).withColumn("fold", F.pmod(F.hash("f0", "f1", "f2"), F.lit(2)))
    table = models.tune(df, "forest", FEATURES, "y", "fold", "w", {"n_estimators": [2, 4, 6], "max_depth": [2, 3, 4]}, shared_rows=0)
    assert table.count() == 9 and len(grown_plots) == 2 and table.first()["mean_score"] > 0.5


def test_a_filter_on_the_result_does_not_score_twice(spark):
    """Metrics drop rows without a prediction; that filter must not be moved below the scoring, which would then run for it, too."""
    df = frame(spark, 300)
    for model in (models.forest(df, FEATURES, "y", n_estimators=3, max_depth=3), models.boosted(df, FEATURES, "y", n_estimators=2, max_depth=2)):
        plan = metrics.summary(model.score(df), "y", "prediction")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_parts_are_read_for_many_batches_at_a_time(spark, monkeypatch):
    """Four parts and batches of 30 rows: each part's tables are read once for all of a task's rows, and again for the next 100."""
    small_sizes(monkeypatch)
    df = frame(spark, 800).coalesce(1).withColumn("id", F.monotonically_increasing_id())
    model = models.forest(df, FEATURES, "y", n_estimators=4, max_depth=6)
    want = {r.id: (r.p_a, r.p_b, r.p_c) for r in model.score(df).collect()}
    monkeypatch.setattr(forests, "SCORED", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        for held in (1 << 19, 100):
            monkeypatch.setattr(forests, "HELD", held)
            got = model.score(df)
            assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
            assert {r.id: (r.p_a, r.p_b, r.p_c) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
