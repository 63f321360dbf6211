"""Shared forest fits, additive bootstrap draws and pooling by ranges."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from riskframe.operators import grown, metrics, models, study
from riskframe.plans import queries as Q


def rows(n=1500, seed=0):
    r = np.random.default_rng(seed)
    x = r.integers(0, 40, (n, 4)).astype(float)
    y = ((x[:, 0] + x[:, 1] + r.integers(0, 25, n)) // 35).clip(0, 2)
    return x, y.astype(int), r.integers(0, 3, n)


def frame(spark, x, y, fold):
    return spark.createDataFrame([(*map(float, v), "abc"[k], int(f), 1.0) for v, k, f in zip(x, y, fold, strict=True)],
                                 "f0 double, f1 double, f2 double, f3 double, y string, fold int, weight double").repartition(5)


FEATURES = ["f0", "f1", "f2", "f3"]


def cells(df):
    return {(r.plot, r.trees, r.depth, r.held, r.y, r.p): r.n for r in df.collect()}


def test_prefixes_and_depths_are_fits_of_their_own(spark):
    df = frame(spark, *rows()).withColumn("label", F.ascii("y") - 97)
    whole = cells(grown.evaluate(df, FEATURES, "label", [grown.Plot(0, 1, 0, 5, 2, 0.8, (5, 12), (3, 9))], "fold"))
    short = cells(grown.evaluate(df, FEATURES, "label", [grown.Plot(0, 1, 0, 5, 2, 0.8, (5,), (3,))], "fold"))
    assert short and short == {k: n for k, n in whole.items() if k[1:3] == (5, 3)}
    assert sum(n for k, n in short.items() if k[3]) == df.where("fold = 1").count()
    again = cells(grown.evaluate(df.repartition(2), FEATURES, "label", [grown.Plot(0, 1, 0, 5, 2, 0.8, (5, 12), (3, 9))], "fold"))
    assert again == whole


def test_a_tree_takes_the_purest_cut():
    """One tree, all features tried, each row drawn once: the first cut against brute force."""
    x, y, _ = rows(300, 4)
    bins = (x[:, :3] % 32).astype(np.uint8)
    w = np.random.default_rng(1).random(300) + 0.5
    t = grown.Trees(bins, y, w, 3, np.ones((1, 300), int), 20, 3, 1, np.random.default_rng(0))

    def purity(own):
        mass = np.bincount(y[own], w[own], 3)
        return (mass**2).sum() / mass.sum()

    options = [(purity(bins[:, f] <= c) + purity(bins[:, f] > c), f, c) for f in range(3) for c in range(31)
               if min((bins[:, f] <= c).sum(), (bins[:, f] > c).sum()) >= 20]
    assert (t.feature[0], t.cut[0]) == max(options)[1:]
    left = bins[:, t.feature[0]] <= t.cut[0]
    assert np.allclose(t.share[1], np.bincount(y[left], w[left], 3) / w[left].sum())


def test_search_agrees_with_distributed_fits(spark, sf_dir):
    folds = Q._folds(spark, sf_dir, 3)
    grid = {"n_estimators": [40], "max_depth": [6], "min_samples_leaf": [5], "max_features": ["sqrt"], "max_samples": [0.8]}
    one, other = (models.tune(folds, "forest", Q.MODEL_FEATURES, "triage", "fold", "weight", grid, shared_rows=n).first() for n in (10**6, 0))
    assert abs(one.mean_score - other.mean_score) < 0.02 and abs(one.mean_train_score - other.mean_train_score) < 0.02


def test_settings_share_fits():
    grid = models.GRIDS["forest"]
    settings = [dict(zip(grid, v, strict=True)) for v in models.product(*grid.values())]
    plots, read = models.forest_plots(settings, range(5), 7)
    assert len(settings) == 216 and len(plots) == 5 * 9  # the two feature rules pick 3 of 7
    assert sorted(at for p in plots if p.fold == 0 for at, _, _ in read[p.at]) == list(range(216))
    assert len(models.forest_plots(settings, [0], 30)[0]) == 18 or grown.picked("sqrt", 30) == grown.picked("log2", 30)


def test_gaps_stop_the_job(spark):
    df = spark.createDataFrame([(1.0, 0, 0), (None, 1, 1)], "x double, y int, fold int")
    with pytest.raises(Exception, match="must be filled"):
        grown.evaluate(df, ["x"], "y", [grown.Plot(0, 0, 0, 1, 1, 1.0, (2,), (2,))], "fold").collect()


def test_poisson_is_inverted():
    u = np.random.default_rng(3).random(4000)
    for mean in (1.0, 2.0, 7.0, 60.0):
        term, upto, table = math.exp(-mean), 0.0, []
        for k in range(400):
            upto += term
            table.append(upto)
            term *= mean / (k + 1)
        want = [next((k for k, c in enumerate(table) if c > v), 399) for v in u]
        assert study.poisson_at(np.full(len(u), mean), u).tolist() == want
    many = study.poisson_at(np.full(4000, 1e8), u)
    assert abs(many.mean() - 1e8) < 1e3 and abs(many.std() - 1e4) < 400
    assert study.poisson_at(np.zeros(2), np.array([0.0, 0.99])).tolist() == [0, 0]


def test_bootstrap_cost_does_not_grow_with_rows(spark):
    df = spark.range(40_000).select("id", F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("y"), F.lit("a").alias("p"))
    reps = study.bootstrap_counts(df, "y", "p", "id", 50)
    assert reps.groupBy("y").agg(F.stddev("n")).count() == 2
    got = {r.y: (r.m, r.s) for r in reps.groupBy("y").agg(F.avg("n").alias("m"), F.stddev("n").alias("s")).collect()}
    assert abs(got["a"][0] - 28_000) < 120 and 110 < got["a"][1] < 240  # the deviation of Poisson(28,000) is 167
    assert study.bootstrap(df.limit(0), "y", "p", "id", n=10).collect()[0]["low"] is None


def test_pools_are_those_of_the_library(spark):
    r = np.random.default_rng(5)
    data = [(float(s), "a" if r.random() < s / 60 else "b") for s in r.integers(0, 60, 3000)] + [(None, "a"), (3.0, None)]
    df = spark.createDataFrame(data, "s double, y string").repartition(7)
    got = models.isotonic_pools(df, "y", {"a": "s"}).orderBy("low").collect()
    model = IsotonicRegression().fit(df.where("s is not null and y is not null").select(F.col("s").alias("features"), (F.col("y") == "a").cast("double").alias("label")))
    ends = sorted({(e, round(p.hits / p.weight, 9)) for p in got for e in (p.low, p.high)})
    assert ends == sorted({(a, round(b, 9)) for a, b in zip(model.boundaries, model.predictions, strict=True)})
    fitted = models.Calibrator.fit(df, "y", {"a": "s", "b": "s"})
    out = fitted.apply(df.where("s is not null"), {"a": "s", "b": "s"})
    assert out.where("abs(cal_a + cal_b - 1) > 1e-9").isEmpty()
    assert models.isotonic_pools(df.limit(0), "y", {"a": "s"}).count() == 0
    assert metrics.summary(out.withColumn("p", models.arg_max({c: F.col(f"cal_{c}") for c in "ab"})).where("y is not null"), "y", "p").count() == 1


def test_bootstrap_draws_every_row(spark):
    """Each row has its own draw in each replicate: two rows of one cell weigh what their keys' digests say."""
    from hashlib import md5

    df = spark.createDataFrame([(7, "a", "a"), (8, "a", "a"), (9, "b", "a"), (9, "b", "a"), (None, "b", "b"), (1, None, "a")], "id long, y string, p string")
    steps = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406, 0.999917)

    def draw(rep, key):
        u = int(md5(f"42|{rep // 4}|{key}".encode()).hexdigest()[8 * (rep % 4):8 * (rep % 4) + 8], 16) / 2**32
        return sum(u >= s for s in steps)

    got = {(r.rep, r.y, r.p): r.n for r in study.bootstrap_counts(df, "y", "p", "id", 30).collect()}
    want = {}
    for rep in range(30):
        want |= {(rep, "a", "a"): draw(rep, 7) + draw(rep, 8), (rep, "b", "a"): 2 * draw(rep, 9)}
    assert got == {k: v for k, v in want.items() if v}


def test_nodes_that_cannot_be_split_are_left_out(monkeypatch):
    """Pure nodes and those with too few rows are not looked at again, nor are their rows; parts of a level change nothing."""
    x, y, _ = rows(2000, 7)
    bins, w, draws = (x % 32).astype(np.uint8), np.random.default_rng(2).random(2000), np.random.default_rng(1).poisson(0.8, (3, 2000))
    seen, whole = [], grown._split

    def watched(part, size, mass, drawn, *more):
        seen.append((int(drawn.min()), int((mass > 0).sum(1).min()), len(part[1]) == size.sum()))
        return whole(part, size, mass, drawn, *more)

    monkeypatch.setattr(grown, "_split", watched)
    trees = [grown.Trees(bins, y, w, 3, draws, 5, 2, 9, np.random.default_rng(0))]
    assert min(s[0] for s in seen) >= 10 and min(s[1] for s in seen) >= 2 and all(s[2] for s in seen)
    monkeypatch.setattr(grown, "PART_NODES", 3)
    monkeypatch.setattr(grown, "WALKED", 64)
    trees.append(grown.Trees(bins, y, w, 3, draws, 5, 2, 9, np.random.default_rng(0)))
    for name in ("feature", "cut", "child", "share"):
        assert (getattr(trees[0], name) == getattr(trees[1], name)).all()
    one, other = (t.votes(bins, (2, 9)) for t in trees)
    assert all((one[d] == other[d]).all() for d in (2, 9))
    # every row's way, a node at a time
    at = np.zeros(2000, np.int64)
    for _ in range(9):
        child = trees[0].child[at]
        at = np.where(child < 0, at, child + (bins[np.arange(2000), trees[0].feature[at]] > trees[0].cut[at]))
    walk = grown.Walk(trees[0].feature, trees[0].cut, trees[0].child)
    assert (next(walk.steps(0, bins, (9,)))[1] == at).all() and (trees[0].child[at] < 0).all()


def test_masses_of_weighted_classes_tell_the_rows():
    """With one weight a class, and with any weights, no leaf has fewer rows than asked for."""
    x, y, _ = rows(1500, 8)
    bins, draws = (x % 32).astype(np.uint8), np.random.default_rng(3).poisson(0.8, (1, 1500))
    for w in (np.ones(1500), np.array([0.3, 1.7, 5.1])[y], np.random.default_rng(4).random(1500)):
        t = grown.Trees(bins, y, w, 3, draws, 7, 3, 12, np.random.default_rng(0))
        ends = next(grown.Walk(t.feature, t.cut, t.child).steps(0, bins, (99,)))[1]
        drawn = np.bincount(ends, draws[0])
        assert drawn[drawn > 0].min() >= 7 and (drawn > 0).sum() > 20
        for c in range(3):
            mass = np.bincount(ends, draws[0] * w * (y == c), len(t.child))
            total = np.bincount(ends, draws[0] * w, len(t.child))
            assert np.allclose(t.share[drawn.nonzero(), c], mass[drawn.nonzero()] / total[drawn.nonzero()])
