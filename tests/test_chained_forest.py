"""The forest chain: rounds as small files, and going on after a stop."""

import os
import re

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from riskframe.operators import auto_impute, chained, forests, regressor, summed
from riskframe.session import remove


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(3)
    a, b = draw.normal(size=3000), draw.normal(size=3000)
    truth = np.stack([a, b, 2 * a - b, a * a])
    gaps = draw.random((4, 3000)) < np.array([0.05, 0.0, 0.2, 0.1])[:, None]
    rows = [(i, *[None if gaps[j, i] else float(truth[j, i]) for j in range(4)], "x" * 400) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, note string")
    return df, truth, gaps


def filled(out):
    return out.orderBy("id").toPandas()[list("abcd")].to_numpy().T


def test_values(table):
    df, truth, gaps = table
    out = chained.chained(df, list("abcd"), rounds=3, estimator="forest", key="id")
    assert out.columns == df.columns
    got = filled(out)
    assert np.array_equal(got[~gaps], truth[~gaps])
    for j in (2, 3):  # well told by the others: most of the variance is found
        assert np.mean((got[j] - truth[j])[gaps[j]] ** 2) < 0.35 * truth[j].var()


def test_disk_of_ten_rounds(table, tmp_path, monkeypatch):
    df, _, _ = table
    seen = []

    def measured(spark, path):
        seen.append(size(tmp_path))
        remove(spark, path)

    monkeypatch.setattr(chained, "remove", measured)
    chained.chained(df, list("abcd"), rounds=10, estimator="forest", trees=2, key="id", root=str(tmp_path))
    job = tmp_path / os.listdir(tmp_path)[0]
    assert len(seen) == 9 and sorted(os.listdir(job)) == ["narrow", "round_10"]
    assert max(seen) <= 3 * size(job / "narrow")


def test_goes_on_after_a_stop(table, tmp_path, monkeypatch):
    df, _, _ = table
    fits = []
    fit = RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, *rows: (fits.append(1), fit(self, *rows))[1])
    run = lambda rounds, root: filled(chained.chained(df, list("abcd"), rounds, "forest", 3, key="id", root=str(root)))
    run(2, tmp_path / "a")
    assert len(fits) == 6
    resumed = run(3, tmp_path / "a")
    assert len(fits) == 9
    assert np.array_equal(resumed, run(3, tmp_path / "a")) and len(fits) == 9
    assert run(1, tmp_path / "b").shape == resumed.shape and len(fits) == 12


def test_edges(spark):
    df = spark.createDataFrame([(1, 1, None, 2.0, 9), (1, 3, None, None, 9), (2, None, None, 4.0, 9)],
                               "id long, a int, b double, c double, _row int")
    out = chained.chained(df, ["a", "b", "c"], 1, "forest", 2)
    assert out.columns == df.columns and out.count() == 3
    assert out.where("a IS NULL OR b IS NULL OR c IS NULL").count() == 0 and {r.b for r in out.collect()} == {0.0}
    assert [r.a for r in chained.chained(df.orderBy("id"), ["a"], 2, "forest").collect()] == [1.0, 3.0, 2.0]
    with pytest.raises(ValueError):
        chained.chained(df, ["a", "c"], 1, "forest", 2, key="id")
    assert chained.chained(df.limit(0), ["a", "c"], 1, "forest").count() == 0
    assert chained.chained(df, ["_row"], 1, "forest").count() == 3


def test_forest_of_summed_histograms(spark):
    """It tells as much as MLlib's from the same rows, and a fit is at most a job a level."""
    draw, names = np.random.default_rng(5), list("abcdef")  # two of six are tried, and most of them tell something
    a, b, c = draw.normal(size=(3, 4000))
    rows = [tuple(map(float, r)) for r in zip(a, b, c, a + b, a - b, a * b, a * b + 2 * a + 40, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in [*names, "y"])).repartition(4)
    cuts = dict(zip(names, forests.bounds(df, names), strict=True))
    spark.sparkContext.setJobGroup("summed-forest", "")
    model = regressor.SummedForest(names, cuts, 40.0, labelCol="y", numTrees=20, maxDepth=5, seed=42).fit(df)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("summed-forest")) <= 6
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = df.toPandas()
    mine = np.mean((model.predict({k: got[k].to_numpy() for k in names}) - got["y"].to_numpy())**2)
    packed = VectorAssembler(inputCols=names, outputCol="_x").transform(df)
    other = RandomForestRegressor(featuresCol="_x", labelCol="y", numTrees=20, maxDepth=5, seed=42).fit(packed).transform(packed).toPandas()
    theirs = np.mean((other["prediction"] - other["y"])**2)
    assert mine < 1.4 * theirs < 0.6 * got["y"].var()
    with pytest.raises(Exception, match="must be filled"):
        regressor.SummedForest(names, cuts, 40.0, labelCol="y").fit(df.withColumn("c", F.lit(float("nan"))))


def test_fills_in_turn(spark):
    """A later column is filled from what an earlier one was filled with; rows without gaps stay."""
    cuts = {"a": [0.5], "b": [0.5]}
    nodes = summed.Nodes(np.array([0]), np.zeros(3, int), np.array([0, 32, 32]), np.array([1, 1, 2]), np.array([0.0, -1.0, 1.0]), 1)
    one, two = regressor.Model(["b"], cuts, nodes, 0.0), regressor.Model(["a"], cuts, nodes, 10.0)
    df = spark.createDataFrame([("x", 0.0, 0.0, True, True), ("y", 0.0, 1.0, True, True), ("z", 5.0, 5.0, False, False)],
                               "id string, a double, b double, _gap_a boolean, _gap_b boolean")
    got = {r.id: (r.a, r.b) for r in regressor.filled(df, [("a", one), ("b", two)]).collect()}
    assert got == {"x": (-1.0, 9.0), "y": (1.0, 11.0), "z": (5.0, 5.0)}


def test_linear_chain_fills_in_compiled_code(spark, capsys):
    """Six columns; methods above 8,000 bytes of code are interpreted by the JVM."""
    names = list("abcdef")
    df = spark.range(200).select("id", *[F.when(F.col("id") % (i + 3) != 0, (F.col("id") * (i + 2) % 31).cast("double")).alias(c) for i, c in enumerate(names)])
    chain = chained.ChainedLinear.fit(df, names, 3)
    out = chain.apply(df)
    wide = {r.id: r for r in chain._apply_steps(df).collect()}
    assert all(abs(r[c] - wide[r.id][c]) < 1e-9 for r in out.collect() for c in names)
    out.explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_auto_reads_its_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    df = spark.range(120).selectExpr("id", "cast(id % 7 as double) as hr", "case when id % 5 != 1 then cast(id % 11 as double) end as spo2",
                                     "case when id % 6 != 0 then cast(id % 4 as string) end as c", "cast(id % 2 as string) as y")
    filled, _ = auto_impute.auto(df.mapInPandas(counted, df.schema), "y", "id", auto_impute.Policy(category_trees=2))
    assert filled.where("spo2 is null or c is null").count() == 0
    assert seen.value == 120
