"""Order statistics, running sums, splits and neighbours against plain computation."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.operators import neighbors, prefix, quantiles, split
from riskframe.sources.visits import table, visits

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.mark.parametrize("whole, bracket", [(200_000, 2_000_000), (10, 2_000_000), (10, 50)])
def test_quantiles_exact_on_every_path(spark, sf_dir, monkeypatch, whole, bracket):
    monkeypatch.setattr(quantiles, "FEW_VALUES", 0)
    monkeypatch.setattr(quantiles, "WHOLE_ROWS", whole)
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", bracket)
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = quantiles._ranked_quantiles(li, li.columns, probs)
    pdf = li.toPandas()
    for c in li.columns:
        assert np.allclose(found[c], np.quantile(pdf[c], probs), rtol=0, atol=1e-9)


def test_quantiles_of_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 2.0)], "a double, b double")
    assert quantiles.quantiles(df, ["a", "b"], [0.25, 0.5]) == {"a": [None, None], "b": [2.0, 2.0]}


def test_sketch_switch(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    exact = quantiles.quantiles(li, ["l_extendedprice"], [0.5])["l_extendedprice"][0]
    assert quantiles.quantiles(li, ["l_extendedprice"], [0.5], accuracy=1000)["l_extendedprice"][0] == pytest.approx(
        exact, rel=0.02)


@FEW
@given(st.lists(st.integers(0, 400), min_size=1, max_size=120, unique=True), st.integers(1, 3))
def test_running_sums(spark, orders, groups):
    pdf = pd.DataFrame({"g": [str(o % groups) for o in orders], "o": [float(o) for o in orders],
                        "n": [o % 7 for o in orders]})
    got = prefix.running_sums(spark.createDataFrame(pdf), ["g"], "o", ["n"], peek=True).toPandas()
    want = pdf.sort_values("o")
    want["n_upto"] = want.groupby("g")["n"].cumsum()
    want["n_all"] = want.groupby("g")["n"].transform("sum")
    want["n_next"] = want.groupby("g")["n"].shift(-1)
    a = got.sort_values("o")[["g", "o", "n_upto", "n_all", "n_next"]].reset_index(drop=True)
    pd.testing.assert_frame_equal(a, want[["g", "o", "n_upto", "n_all", "n_next"]].reset_index(drop=True), check_dtype=False)


def test_split_covers_and_keeps_class_shares(spark, sf_dir):
    v = visits(spark, sf_dir, ["visit_id", "triage"])
    s = split.stratified(v, "triage", "visit_id").toPandas()
    assert len(s) == v.count() and s["split"].notna().all()
    for _, part in s.groupby("triage"):
        share = part["split"].value_counts()
        assert abs(share["test"] - 0.15 * len(part)) <= 1 and abs(share["validation"] - 0.15 * len(part)) <= 1


def test_split_does_not_depend_on_partitions(spark, sf_dir):
    v = visits(spark, sf_dir, ["visit_id", "triage"])
    a = {r[0]: r[1] for r in split.stratified(v, "triage", "visit_id").select("visit_id", "split").collect()}
    b = {r[0]: r[1] for r in split.stratified(v.repartition(13), "triage", "visit_id").select("visit_id", "split").collect()}
    assert a == b


def test_split_with_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(split, "hash32", lambda seed, key: F.col(key) % 3)  # heavy collisions
    df = spark.range(100).select(F.col("id"), F.lit("a").alias("y"))
    s = split.stratified(df, "y", "id").toPandas()
    assert s["split"].value_counts().to_dict() == {"train": 70, "test": 15, "validation": 15}
    assert sorted(s[s["split"] == "test"]["id"]) == [3 * i for i in range(15)]


def test_folds_are_even(spark, sf_dir):
    f = split.kfold(visits(spark, sf_dir, ["visit_id", "triage"]), "triage", "visit_id", 4).toPandas()
    sizes = f.groupby(["triage", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_grouped_split_keeps_groups_whole(spark, sf_dir):
    s = split.grouped(visits(spark, sf_dir, ["visit_id", "patient_id"]), "patient_id").toPandas()
    assert (s.groupby("patient_id")["split"].nunique() == 1).all()


def brute(q, d, dims, k, by=None, exclude=False):
    out = {}
    for _, row in q.iterrows():
        rows = d[d[by] == row[by]] if by else d
        rows = rows[rows["id"] != row["id"]] if exclude else rows
        total, shared = np.zeros(len(rows)), np.zeros(len(rows))
        for c in dims:
            diff = (row[c] - rows[c].to_numpy(float)) ** 2
            shared += ~np.isnan(diff)
            total += np.nan_to_num(diff)
        ok = shared > 0
        d2 = len(dims) / shared[ok] * total[ok]
        ids = rows["id"].to_numpy()[ok]
        best = np.lexsort((ids, d2))[:k]
        if len(best):
            out[row["id"]] = [(d2[i], ids[i]) for i in best]
    return out


@pytest.mark.parametrize("k, exclude, by, box, part", [
    (3, False, None, 16, 512), (5, True, "g", 8, 4), (1, True, None, 10_000, 512), (4, True, None, 10_000, 6)])
def test_nearest_is_exact(spark, monkeypatch, k, exclude, by, box, part):
    monkeypatch.setattr(neighbors, "PART_ROWS", part)
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({c: rng.integers(0, 12, n).astype(float) for c in "abc"})
    pdf.loc[: n // 3, ["a", "b", "c"]] = [5.0, 5.0, 5.0]  # a third of the rows are one point
    for c in "abc":
        pdf.loc[rng.random(n) < 0.15, c] = np.nan
    pdf["id"], pdf["g"] = np.arange(n), rng.choice(["x", "y"], n)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, id long, g string")
    half = pdf if exclude else pdf[pdf["id"] % 2 == 0]
    rest = pdf if exclude else pdf[pdf["id"] % 2 == 1]
    q, d = (df, df) if exclude else (df.where("id % 2 = 0"), df.where("id % 2 = 1"))
    got = {r["id"]: [(p["d2"], p["did"]) for p in r["near"]]
           for r in neighbors.nearest(q, d, list("abc"), k, by=by, exclude_self=exclude, box_rows=box).collect()}
    assert {i: v for i, v in got.items() if v} == brute(half, rest, list("abc"), k, by, exclude)


def test_nearest_with_fewer_donors_than_k(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "id long, a double")
    got = {r["id"]: [p["did"] for p in r["near"]] for r in neighbors.nearest(df, df, ["a"], 5, exclude_self=True).collect()}
    assert got == {1: [2, 3], 2: [1, 3], 3: [2, 1]}


def test_nearest_splits_busy_boxes(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "SLICE_QUERIES", 20)
    df = spark.range(300).select("id", (F.col("id") * 7 % 101).cast("double").alias("a"))
    got = {r["id"]: [(p["d2"], p["did"]) for p in r["near"]]
           for r in neighbors.nearest(df, df, ["a"], 3, exclude_self=True, box_rows=50).collect()}
    assert got == brute(df.toPandas(), df.toPandas(), ["a"], 3, exclude=True)


def test_nearest_searches_large_boxes_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PART_DONORS", 40)
    df = spark.range(300).select("id", (F.col("id") * 7 % 101).cast("double").alias("a"))
    got = {r["id"]: [(p["d2"], p["did"]) for p in r["near"]]
           for r in neighbors.nearest(df, df, ["a"], 3, exclude_self=True, box_rows=200).collect()}
    assert got == brute(df.toPandas(), df.toPandas(), ["a"], 3, exclude=True)


def test_stored_index_within_and_across_groups(spark, tmp_path):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(400), "a": rng.integers(0, 9, 400).astype(float), "b": rng.normal(size=400),
                        "g": rng.choice(["x", "y", "z"], 400, p=[0.8, 0.15, 0.05])})
    pdf.loc[:150, ["a", "b"]] = [3.0, 0.0]
    df = spark.createDataFrame(pdf)
    neighbors.Index.fit(df, ["a", "b"], 7, "g", ["b"], box_rows=16).save(str(tmp_path), "index")
    index = neighbors.Index.load(spark, str(tmp_path), "index")
    for k, everywhere in ((6, True), (4, False), (2, True)):
        rows = index.nearest(df, k, exclude_self=True, everywhere=everywhere).collect()
        got = {r["id"]: [(p["d2"], p["did"]) for p in r["near"]] for r in rows}
        assert got == brute(pdf, pdf, ["a", "b"], k, None if everywhere else "g", True)
        assert all(p["b"] == pdf["b"][p["did"]] for r in rows for p in r["near"])
    with pytest.raises(ValueError):
        index.nearest(df, 7, exclude_self=True)


@pytest.mark.parametrize("whole_rows", [0, 200_000])
def test_split_of_numeric_and_missing_classes(spark, monkeypatch, whole_rows):
    """Class names that look like numbers, one class large and one small, and rows without a class."""
    from riskframe.operators import quantiles, split

    monkeypatch.setattr(quantiles, "WHOLE_ROWS", whole_rows)
    rows = [(i, None if i % 50 == 3 else int(i % 10 == 0)) for i in range(3000)]
    out = split.stratified(spark.createDataFrame(rows, "id long, y int"), "y", "id").groupBy("y", "split").count().collect()
    got = {(r.y, r.split): r["count"] for r in out}
    assert got == {(None, "test"): 9, (None, "validation"): 9, (None, "train"): 42, (1, "test"): 45, (1, "validation"): 45, (1, "train"): 210,
                   (0, "test"): 396, (0, "validation"): 396, (0, "train"): 1848}


@pytest.mark.parametrize("bounds", [(0, 0, 50), (200_000, 50_000, 2_000_000)])
def test_quantiles_do_not_depend_on_the_size_limits(spark, monkeypatch, bounds):
    import numpy as np

    from riskframe.operators import quantiles

    for name, value in zip(("WHOLE_ROWS", "FEW_VALUES", "BRACKET_ROWS"), bounds, strict=True):
        monkeypatch.setattr(quantiles, name, value)
    x = [float((i * 7919) % 4001) for i in range(4001)]
    got = quantiles.quantiles(spark.createDataFrame([(v, v % 3) for v in x], "a double, b double"), ["a", "b"], [0.0, 0.1, 0.5, 0.99])
    assert np.allclose(got["a"], np.quantile(x, [0, 0.1, 0.5, 0.99]))
    assert np.allclose(got["b"], np.quantile([v % 3 for v in x], [0, 0.1, 0.5, 0.99]))


def test_inflation_of_dependent_columns():
    import numpy as np

    from riskframe.operators.features import Collinearity, vif_from_gram

    rng = np.random.default_rng(1)
    a, b, z = rng.normal(2, 1, 500), rng.normal(1, 1, 500), np.zeros(500)
    x = np.column_stack([a, b, 2 * b, z])
    found = vif_from_gram(x.T @ x)
    y = np.column_stack([a, b])
    alone = np.linalg.inv(y.T @ y).diagonal() * (y * y).sum(0)
    assert np.isinf(found[1:]).all() and abs(found[0] - alone[0]) < 1e-9
    keep, gone = Collinearity(["a", "b", "twice"], x[:, :3].T @ x[:, :3]).eliminate()
    assert keep == ["a", "twice"] and [g[1] for g in gone] == ["b"]


def test_new_ids_do_not_overflow(spark):
    from riskframe.operators.smote import with_synthetic

    rows = spark.createDataFrame([(10**17, "A", 1.0), (5, "B", 2.0)], "id long, y string, x double")
    new = spark.createDataFrame([("A", 10**17, 0, 1.5), ("A", 10**17, 1, 1.5), ("B", 5, 0, 2.5)], "y string, seed_id long, copy int, x double")
    ids = [r.id for r in with_synthetic(rows, new, "y", ["x"], "id", {"A": (1, 10**9), "B": (1, 2)}).collect()]
    assert len(set(ids)) == 5 and sum(i < 0 for i in ids) == 3


def test_every_column_is_filled_from_the_table_as_it_came(spark):
    from riskframe.operators.knn_impute import knn, knn_values

    rows = spark.createDataFrame([(i, float(i % 7) if i % 5 else None, float(i % 11) if i % 4 else None, float(i)) for i in range(60)],
                                 "id long, a double, b double, c double")
    both = knn(rows, "a", ["a", "b", "c"], "id", 3, fill_all=True).orderBy("id").collect()
    for column in ("a", "b"):
        want = {r.id: r.value for r in knn_values(rows, column, ["a", "b", "c"], "id", 3).collect()}
        assert all(abs(r[column] - want[r.id]) < 1e-9 for r in both if r.id in want)


def test_queries_pass_by_most_boxes():
    rng = np.random.default_rng(0)
    side = 64  # 4,096 boxes in tree order along a space-filling grid
    cells = sorted(((i, j) for i in range(side) for j in range(side)), key=lambda c: sum(((c[0] >> b & 1) * 2 + (c[1] >> b & 1)) << 2 * b for b in range(6)))
    rects = pd.DataFrame({"box": range(len(cells)), "g": "", "pattern": 3, "n": 100, "a_lo": [i for i, _ in cells], "a_hi": [i + 1 for i, _ in cells],
                          "b_lo": [j for _, j in cells], "b_hi": [j + 1 for _, j in cells]})
    found = neighbors._Rectangles(rects, "g", ["a", "b"])
    x = rng.random((500, 2)) * side
    home = found.home("", 3, x, 5)
    limit = np.full(len(x), 0.01)
    got = {(int(r), int(b)) for rows, boxes in found.within("", 3, x, limit) for r, b in zip(rows, boxes, strict=True)}
    gap = neighbors._gaps(x, 3, rects[["a_lo", "b_lo"]].to_numpy(float), rects[["a_hi", "b_hi"]].to_numpy(float), np.full(len(cells), 3))
    assert got == {(int(r), int(b)) for r, b in zip(*np.nonzero(gap <= 0.01), strict=True)}
    assert (gap[np.arange(len(x)), home] == 0).all()
    assert found.tests < len(x) * len(cells) / 10


def test_first_search_passes_by_the_wide_boxes_of_rare_patterns():
    cells = [(i, j) for i in range(8) for j in range(8)]
    rects = pd.DataFrame({"box": range(64), "g": "", "pattern": 3, "n": 4000, "a_lo": [10.0 * i for i, _ in cells], "a_hi": [10.0 * i + 10 for i, _ in cells],
                          "b_lo": [10.0 * j for _, j in cells], "b_hi": [10.0 * j + 10 for _, j in cells]})
    few = pd.DataFrame({"box": [64], "g": "", "pattern": 1, "n": 20, "a_lo": 0.0, "a_hi": 80.0, "b_lo": np.nan, "b_hi": np.nan})
    found = neighbors._Rectangles(pd.concat([rects, few], ignore_index=True), "g", ["a", "b"])
    x = np.random.default_rng(0).random((200, 2)) * 80  # each inside one small box, and inside the wide one
    assert (found.home("", 3, x, 5) == np.floor(x[:, 0] / 10) * 8 + np.floor(x[:, 1] / 10)).all()
