"""Boosters of all classes from one pass a level, against their definition over the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_forests import FEATURES, frame

from riskframe.operators import boosters, forests, models, summed


def test_a_round_is_a_small_number_of_jobs(spark):
    """A job a level for all classes together; MLlib's boosters took several a level and class."""
    df = frame(spark, 600)
    tracker, group = spark.sparkContext.statusTracker(), "boosters"
    jobs = []
    for rounds in (2, 8):
        spark.sparkContext.setJobGroup(f"{group}-{rounds}", "")
        models.boosted(df, FEATURES, "y", "w", n_estimators=rounds, max_depth=3)
        jobs.append(len(tracker.getJobIdsForGroup(f"{group}-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 6 * 3


@pytest.mark.parametrize("direct", [32 << 20, 0])
def test_trees_follow_the_pseudo_residuals(spark, monkeypatch, direct):
    """Every leaf holds the weighted mean of its rows' pseudo-residuals and at least the least number of rows, in cached and pending rounds."""
    monkeypatch.setattr(summed, "DIRECT", direct)
    monkeypatch.setattr(boosters, "PENDING", 2)
    df = frame(spark, 900)
    model = models.boosted(df, FEATURES, "y", "w", n_estimators=5, max_depth=3, min_child_weight=7, subsample=1.0, colsample=1.0).parts[0]
    got = df.toPandas()
    x = np.array([np.searchsorted(c, got[f], "left") for f, c in zip(FEATURES, model.cuts, strict=True)]).astype(np.uint8)
    y, w, margin = got["label"].to_numpy(), got["w"].to_numpy(), np.zeros((3, 900))
    for tree in range(15):
        turn, k = divmod(tree, 3)
        sign = np.where(y == k, 1.0, -1.0)
        r = sign if turn == 0 else 4 * sign / (1 + np.exp(2 * sign * margin[k]))
        at = model.nodes.leaves(tree, x)
        for leaf in np.unique(at):
            own = at == leaf
            assert own.sum() >= 7 and model.nodes.value[leaf] == pytest.approx(np.average(r[own], weights=w[own]), abs=1e-9)
        root = model.nodes.roots[tree]

        def spread_left(f, b, r=r):
            return sum((w[s] * r[s]).sum()**2 / w[s].sum() for s in (x[f] <= b, x[f] > b))

        best = max(spread_left(f, b) for f in range(3) for b in range(31) if 7 <= (x[f] <= b).sum() <= 893)
        assert spread_left(model.nodes.feature[root], model.nodes.cut[root]) == pytest.approx(best)
        margin[k] += (0.1 if turn else 1.0) * model.nodes.value[at]
    assert np.allclose(model.margins(x), margin)


def test_scores_agree_with_mllib(spark):
    """Without draws both grow the same trees, but for where a cut lies between two values."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    df = frame(spark, 1200).select(*[F.floor(F.col(f) / 2).cast("double").alias(f) for f in FEATURES], "label", "y", "w")
    model = models.boosted(df, FEATURES, "y", "w", n_estimators=10, max_depth=3, subsample=1.0, colsample=1.0)
    packed = models.pack(df, FEATURES)
    want = []
    for k in range(3):
        gbt = GBTClassifier(maxDepth=3, stepSize=0.1, maxIter=10, minInstancesPerNode=3, weightCol="w", seed=1)
        mine = packed.withColumn("label", (F.col("label") == k).cast("double"))
        want.append([r[0] for r in gbt.fit(mine).transform(mine).select(vector_to_array("probability")[1]).collect()])
    rows = [(*r[:3],) for r in df.select(*FEATURES).collect()]
    binned = np.array([np.searchsorted(c, [r[i] for r in rows], "left") for i, c in enumerate(model.parts[0].cuts)]).astype(np.uint8)
    got = 1 / (1 + np.exp(-2 * model.parts[0].margins(binned)))
    assert np.abs(got - np.array(want)).mean() < 0.01
    assert np.allclose(np.sum([list(r) for r in model.probabilities(df).select("p_a", "p_b", "p_c").collect()], axis=1), 1)


def test_saved_boosters_score_alike_and_gaps_stop(spark, tmp_path):
    df = frame(spark, 400).withColumn("id", F.monotonically_increasing_id())
    model = models.boosted(df, FEATURES, "y", n_estimators=4)
    model.save(spark, str(tmp_path), "m")
    want = {r.id: (r.p_a, r.p_b, r.p_c) for r in model.score(df).collect()}
    got = models.Fitted.load(spark, str(tmp_path), "m").score(df).collect()
    assert len(got) == 400 and all(np.allclose((r.p_a, r.p_b, r.p_c), want[r.id]) for r in got)
    assert sum(models.importance_values(model).values()) == pytest.approx(1.0)
    for c in ("f1", "w", "y"):
        with pytest.raises(Exception, match="must be filled"):
            models.boosted(df.withColumn(c, F.when(F.col("f0") > 9, F.col(c))), FEATURES, "y", "w", n_estimators=2)
    with pytest.raises(ValueError, match="no rows"):
        models.boosted(df.limit(0), FEATURES, "y", n_estimators=2)
    assert forests.bins(["a"], [[1.0]], [__import__("pyarrow").array([0.0, 2.0])]).tolist() == [[0, 1]]
