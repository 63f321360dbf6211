"""Codes of columns with many values, and approximate neighbours."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import encode, knn_impute, lsh, neighbors


def test_codes_follow_the_sorted_values(spark, monkeypatch):
    values = [f"v{i * 7919 % 20011:05d}" for i in range(20011)]
    df = spark.createDataFrame([(v,) for v in [*values, *values[:50]]] + [(None,)], "c string").repartition(6)
    with pytest.raises(ValueError, match="code_table"):
        encode.levels(df, "c")
    table = encode.code_table(df, "c")
    assert [(r.value, r.code) for r in table.orderBy("code").collect()] == [(v, k) for k, v in enumerate(sorted(values))]
    monkeypatch.setattr(encode, "BROADCAST_CODES", 10)  # joined by a shuffle
    coded = encode.with_codes(df, "c", table)
    assert coded.count() == 20062 and coded.where("c is null and code is null").count() == 1 and coded.where("c is not null and code is null").count() == 0


def test_sparse_one_hot(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "c string")
    table = encode.code_table(df.where("c != 'c'"), "c")
    out = encode.one_hot_sparse(df, "c", table).select("c", vector_to_array("vector").alias("v")).collect()
    assert sorted((r.c or "", r.v) for r in out) == [("", [0, 0]), ("a", [1, 0]), ("b", [0, 1]), ("b", [0, 1]), ("c", [0, 0])]
    numbers = spark.createDataFrame([(float("nan"),), (2.5,), (-1.0,)], "c double")
    assert [(r.value, r.code) for r in encode.code_table(numbers, "c").orderBy("code").collect()] == [(-1.0, 0), (2.5, 1)]
    assert encode.code_table(df.limit(0), "c").count() == 0
    with pytest.raises(ValueError):
        encode.one_hot_sparse(df, "c", table.limit(0))


def points(seed, n, gaps=0.1):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(0, [20, 15, 3, 2], (n, 4)) + 60 * r.integers(0, 4, (n, 1)), 0)
    return [[None if r.random() < gaps else float(v) for v in row] for row in x]


def frame(spark, rows, start=0):
    return spark.createDataFrame([(start + i, *p, float(i % 9)) for i, p in enumerate(rows)], "id long, a double, b double, c double, d double, v double").repartition(4)


def test_lsh_finds_nearly_all_neighbours(spark):
    dims = ["a", "b", "c", "d"]
    donors, queries = frame(spark, points(1, 4000, 0.02)), frame(spark, points(2, 300, 0.02), 10_000)
    true = {r.id: r.near for r in neighbors.nearest(queries, donors, dims, 5, carry=["v"]).collect()}
    got = {r.id: r.near for r in lsh.nearest_lsh(queries, donors, dims, 5, carry=["v"]).collect()}
    assert set(got) == set(true)
    hits = sum(sum(p.d2 <= near[-1].d2 + 1e-9 for p in got[i]) for i, near in true.items())
    assert hits >= 0.95 * sum(map(len, true.values()))
    carried = {r.id: r.v for r in donors.collect()}
    assert all(p.v == carried[p.did] for near in got.values() for p in near)
    assert all(abs(a.d2 - b.d2) < 1e-9 for i in true for a, b in zip(true[i], got[i], strict=True) if a.did == b.did)


def test_lsh_answers_odd_rows_exactly(spark):
    """Gaps, few donors, copies of one point, repeated questions, no donors."""
    dims = ["a", "b", "c", "d"]
    rows = [[1.0, 1.0, 1.0, 1.0]] * 50 + [[900.0, 900.0, 0.0, 0.0], [None, 2.0, None, 1.0], [None, None, None, None]]
    donors = frame(spark, rows)
    queries = frame(spark, [[1.0, 1.0, 1.0, 1.0], [1.0, 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0], [900.0, 900.0, 0.0, 0.0]], 100)
    true, got = ({r.id: [p.did for p in r.near] for r in f(queries, donors, dims, 5).collect()} for f in (neighbors.nearest, lsh.nearest_lsh))
    assert got == true and got[100] == got[101] == [0, 1, 2, 3, 4]
    assert lsh.nearest_lsh(queries, donors.limit(0), dims, 3).count() == neighbors.nearest(queries, donors.limit(0), dims, 3).count()
    with pytest.raises(ValueError):
        knn_impute.knn(donors, "v", ["v", *dims], "id", method="other")
    full = knn_impute.knn(donors.withColumn("v", F.when(F.col("id") != 3, F.col("v"))), "v", ["v", *dims], "id", method="lsh")
    assert full.where("v is null").isEmpty() and full.count() == donors.count()


def test_lsh_plan_does_not_grow_with_the_cuts(spark):
    """Cells of many cuts are searched in the tasks; the plan held a comparison per cut before."""
    dims = ["a", "b"]
    df = frame(spark, [[float(i), float(i * i % 97), 0.0, 0.0] for i in range(200)])
    sizes = []
    for parts in (4, 300):
        edges = {(t, x): [k / 2 - 40 for k in range(parts - 1)] for t in range(2) for x in "xy"}
        cells, _ = lsh._cells(df, dims, 2, parts, 42, {"a": 1.0, "b": 2.0}, edges)
        out = df.select("a", "b", cells.alias("c"))
        sizes.append(len(out._jdf.queryExecution().analyzed().toString()))
    assert sizes[1] < 1.5 * sizes[0]
    first = np.random.default_rng(42).standard_normal((2, 2))[0]
    for r in out.collect():
        assert r.c[0]["x"] == sum(r.a * first[0] + r.b * first[1] > e for e in edges[0, "x"])


def test_lsh_blocks_hold_all_cells_around(spark, monkeypatch):
    """Cells of a few rows make many blocks: a probe at the edge of its block still meets the cells beyond."""
    monkeypatch.setattr(lsh, "CELL_ROWS", 4)
    dims = ["a", "b", "c", "d"]
    donors, queries = frame(spark, points(3, 600, 0)), frame(spark, points(4, 60, 0), 10_000)
    got = {}
    for block, most in ((3, 4096), (64, 3)):
        monkeypatch.setattr(lsh, "BLOCK", block)
        monkeypatch.setattr(lsh, "DONORS", most)
        got[block] = sorted((r.id, [tuple(p) for p in r.near]) for r in lsh.nearest_lsh(queries, donors, dims, 5).collect())
    assert got[3] == got[64] and len(got[3]) == 60
