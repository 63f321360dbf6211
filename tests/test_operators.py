"""Hand-computed answers for edges: NULL, ties, empty classes, zero width, thresholds."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.functions import tails
from riskframe.functions.scalars import clip, cut, to_number
from riskframe.operators import (
    auto_impute,
    balance,
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
    scaling,
    schema,
    smote,
    study,
)
from riskframe.sources import tables
from riskframe.sources.visits import rename_source, visits
from riskframe.streaming.features import apply_fitted, read_visits


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_to_number(spark):
    df = spark.createDataFrame([("36,5",), (" 12 ",), ("NaN",), ("n/a",), (None,), ("-3.5",)], "s string")
    assert column(df.select(to_number("s").alias("x")), "x") == [None, 12.0, None, None, None, -3.5]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (1.0,), (99.0,)], "x double")
    assert column(df.select(clip("x", 5.0, 10.0).alias("y")), "y") == [None, 5.0, 10.0]


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (18.0,), (18.5,), (40.0,), (65.0,), (100.0,), (101.0,), (None,)], "age double")
    got = column(features.age_band(df), "age_category")
    assert got == [None, "Young", "Adult", "Adult", "Middle", "Elderly", None, None]
    assert column(df.select(cut("age", [0, 18], ["x"]).alias("b")), "b")[:3] == [None, "x", None]


@pytest.mark.parametrize("name, value, points", [
    *[("hr", v, p) for v, p in [(40, 3), (40.5, 2), (50, 2), (51, 0), (100, 0), (110, 1), (130, 2), (131, 3), (None, 0)]],
    *[("sbp", v, p) for v, p in [(70, 3), (80, 2), (100, 1), (101, 0), (199, 0), (200, 2), (None, 0)]],
    *[("spo2", v, p) for v, p in [(84, 3), (85, 2), (89, 2), (90, 1), (91, 1), (92, 0), (None, 0)]],
    *[("temp", v, p) for v, p in [(34.9, 2), (35, 1), (36, 0), (38, 0), (38.1, 1), (39, 1), (39.1, 2), (None, 0)]],
])
def test_early_warning_edges(spark, name, value, points):
    row = {"hr": None, "sbp": None, "spo2": None, "temp": None, "gcs": None, name: None if value is None else float(value)}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
    got = features.early_warning(df).first()
    assert got[f"{name}_risk_score"] == points and got["clinical_risk_score"] == points


def test_early_warning_needs_all_vitals(spark):
    df = spark.createDataFrame([(80.0,)], "hr double")
    assert features.early_warning(df).columns == ["hr"]


def test_shock_index_zero_pressure_and_cap(spark):
    df = spark.createDataFrame([(90.0, 0.0), (100.0, 100.0), (600.0, 100.0), (None, 80.0), (90.0, 100.0)], "hr double, sbp double")
    fill = features.fit_shock_index(df)
    assert fill == 1.0  # median of 1, 5 (capped), 0.9
    got = features.shock_index(df, fill).toPandas()
    assert got["shock_index"].tolist() == [1.0, 1.0, 5.0, 1.0, 0.9]
    assert got["shock_index_high"].tolist() == [1, 1, 1, 1, 0]


def test_one_scan_for_flags_of_missing_values(spark):
    df = spark.createDataFrame([(None, None, None, None)], "hr double, sbp double, spo2 double, temp double")
    assert features.abnormal_count(df).first()["abnormal_vitals_count"] == 0


def test_mode_ties_and_all_missing(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None), ("a", None), ("b", None)], "x string, y string")
    fill = impute.fit_mode(df, ["x", "y"])
    assert fill.values == {"x": "a", "y": "Unknown"}
    assert column(fill.apply(df), "x") == ["b", "a", "a", "a", "b"]


def test_indicator_threshold_is_strict(spark):
    df = spark.range(100).select(F.when(F.col("id") >= 5, 1.0).alias("five"), F.when(F.col("id") >= 6, 1.0).alias("six"))
    assert impute.indicator_columns(df) == ["six"]


def test_success_rate_without_gaps(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert impute.success_rate(df, df).first()["success_pct"] == 100.0


def test_scaling_zero_width(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    for method in ("robust", "standard", "minmax", "anything"):
        assert column(scaling.Scaler.fit(df, ["x"], method).apply(df), "x") == [0.0, 0.0, None]


def test_scalable_columns(spark):
    df = spark.createDataFrame([(1, 0.0, None, 1.0, "a"), (2, 1.0, None, 2.0, "b"), (3, 1.0, None, 3.0, "c")],
                               "k int, two double, none double, three double, y string")
    assert scaling.scalable_columns(df, "y", ["k"]) == ["three"]


def test_variance_filter(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, 1.0, None)], "a double, b double, c double")
    assert features.variance_filter(df, df.columns) == ["a"]


def test_vif_singular_is_infinite(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 3)) for i in range(1, 20)], "a double, b double, c double")
    got = {r["feature"]: (r["vif"], r["vif_category"]) for r in features.vif(df, df.columns).collect()}
    assert got["a"] == (float("inf"), "Severe (>100)")


def test_elimination_skips_protected(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(10, 1, 300)
    pdf = pd.DataFrame({"a": x, "b": x + rng.normal(0, 0.01, 300), "c": rng.normal(0, 1, 300)})
    kept, log = features.drop_collinear(spark.createDataFrame(pdf), ["a", "b", "c"], protect=["a"])
    assert kept.columns == ["a", "c"] and column(log, "feature") == ["b"]


def test_gram_wide_path(spark, monkeypatch):
    pdf = pd.DataFrame(np.random.default_rng(1).normal(size=(50, 4)), columns=list("abcd"))
    df = spark.createDataFrame(pdf)
    a = features.gram(df, list("abcd"))
    monkeypatch.setattr(features, "GRAM_IN_SQL", 1)
    assert np.allclose(a, features.gram(df, list("abcd"))) and np.allclose(a, pdf.T @ pdf)


def test_log_only_when_all_positive(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (2.0, 1.0, None)], "a double, b double, c double")
    out, log = outliers.log1p_if_positive(df, ["a", "b", "c"])
    assert {r["feature"]: r["transformed"] for r in log.collect()} == {"a": True, "b": False, "c": False}
    assert column(out, "a") == pytest.approx([np.log(2), np.log(3)])


def test_winsorize_only_over_threshold(spark):
    df = spark.createDataFrame([(float(i), 1000.0 if i % 8 == 0 else float(i)) for i in range(1, 101)], "a double, b double")
    fitted = outliers.Winsor.fit(df, ["a", "b"], p=0.8)
    assert list(fitted.bounds) == ["b"] and fitted.log(df).count() == 1


def test_patterns_and_profile(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, "x")], "a double, b string")
    assert {r["pattern"]: r["n"] for r in profile.missing_patterns(df).collect()} == {"01": 1, "11": 1, "00": 1}
    worst = profile.missing(df).first()
    assert (worst["column"], worst["missing_count"], worst["critical"], worst["distinct_values"]) == ("b", 2, True, 1)


def test_label_codec_round_trip(spark):
    df = spark.createDataFrame([("Sarı",), ("Kırmızı",), (None,), ("Yeşil",)], "y string")
    codec = encode.LabelCodec.fit(df, "y")
    out = df.withColumn("c", codec.encode("y")).withColumn("d", codec.decode("c"))
    assert column(out, "d") == ["Sarı", "Kırmızı", None, "Yeşil"] and column(out, "c") == [1, 0, None, 2]


def test_source_names(spark):
    df = spark.createDataFrame([(70.0, "Kırmızı")], "`YAŞ` double, Triaj string")
    assert rename_source(df).first().asDict() == {"age": 70.0, "triage": "RED"}


def test_align(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b double, extra double")
    assert schema.align(df, ["a", "b"]).first().asDict() == {"a": 0.0, "b": 1.0}


def test_targets_never_lower(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 60 + [("c",)] * 10, "y string")
    assert balance.target_table(df, "y") == {"a": (90, 90), "b": (60, 60), "c": (10, 45)}
    assert balance.target_table(df, "y", "conservative")["c"] == (10, 36)
    assert balance.target_table(df, "y", "aggressive")["c"] == (10, 75)


def test_weights_average_one(spark):
    df = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2, "y string")
    w = balance.weight_table(df, "y")
    assert sum(w.values()) / 2 == pytest.approx(1.0) and w["b"] / w["a"] == pytest.approx(4.0)


def test_quality_gates(spark):
    before = spark.createDataFrame([("a",)] * 90 + [("b",)] * 10, "y string")
    after = spark.createDataFrame([("a",)] * 90 + [("b",)] * 60, "y string")
    got = {r["check"]: r["status"] for r in balance.quality_checks(before, after, "y", 2.0, succeeded=False).collect()}
    assert got == {"synthetic_share": "FAIL", "imbalance_ratio": "PASS", "weight_ratio": "PASS", "sampler": "FAIL"}


def test_metrics_with_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a")] * 6 + [("b", "a")] * 2 + [("c", "c")] * 2, "y string, p string")
    s = metrics.summary(df, "y", "p").first()
    assert s["accuracy"] == 0.8 and s["balanced_accuracy"] == pytest.approx(2 / 3)
    assert s["macro_f1"] == pytest.approx((12 / 14 + 0 + 1) / 3)
    cells = metrics.confusion(df, "y", "p", ["a", "b", "c"]).collect()
    assert len(cells) == 9 and sum(c["n"] for c in cells) == 10


def test_mcc_of_constant_prediction_is_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    assert metrics.summary(df, "y", "p").first()["mcc"] == 0.0


def test_auc_ties_and_monotone_maps(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert curves.auc(df.withColumn("y", F.col("y").cast("string")), "y", {"1": "s"}).first()["auc"] == 0.875
    cubed = df.select(F.col("y").cast("string").alias("y"), F.pow("s", 3).alias("s"))
    assert curves.auc(cubed, "y", {"1": "s"}).first()["auc"] == 0.875


def test_error_kinds(spark):
    pairs = [("RED", "GREEN"), ("RED", "YELLOW"), ("YELLOW", "GREEN"), ("GREEN", "RED"), ("GREEN", "GREEN"), ("YELLOW", "RED")]
    df = spark.createDataFrame(pairs, "y string, p string")
    got = {r["kind"]: r["n"] for r in errors.error_counts(df, "y", "p").collect()}
    assert got == {"critical": 2, "important": 1, "over_triage": 1, "under_triage": 3}


def test_tails():
    assert tails.chi2_1_tail(3.841458820694124) == pytest.approx(0.05, abs=1e-12)
    assert tails.binomial_two_sided(2, 10) == pytest.approx(0.109375)
    assert tails.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    x = np.linspace(0.0, 3.3, 400_001)  # integrate the density of F(5, 10)
    d1, d2 = 5, 10
    scale = math.gamma(7.5) / (math.gamma(2.5) * math.gamma(5.0)) * (d1 / d2) ** 2.5
    density = scale * x**1.5 * (1 + d1 * x / d2) ** -7.5
    assert tails.f_tail(3.3, d1, d2) == pytest.approx(1 - np.trapezoid(density, x), abs=1e-9)


def test_mcnemar_exact_for_few_disagreements(spark):
    a = spark.createDataFrame([(i, "x", "x" if i < 8 else "y") for i in range(10)], "k int, y string, p string")
    b = spark.createDataFrame([(i, "x", "x") for i in range(10)], "k int, y string, p string")
    r = study.mcnemar(a, b, "k", "y", "p")
    assert (r["only_a"], r["only_b"]) == (0, 2) and r["p_value"] == 0.5


def test_bootstrap_variants_agree(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"),
                                  F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("p"))
    rows = {r["metric"]: r for r in study.bootstrap(df, "y", "p", "id", n=200).collect()}
    cells = {r["metric"]: r for r in study.bootstrap_from_table(df, "y", "p", n=400).collect()}
    for m in rows:
        assert rows[m]["mean"] == pytest.approx(cells[m]["mean"], abs=0.005)
        assert rows[m]["high"] - rows[m]["low"] == pytest.approx(cells[m]["high"] - cells[m]["low"], rel=0.25)


def chain_by_hand(x, rounds):
    gaps = np.isnan(x)
    mean = np.nanmean(x, axis=0)
    out = np.where(gaps, mean, x)
    order = sorted((c for c in range(x.shape[1]) if gaps[:, c].any()), key=lambda c: gaps[:, c].sum())
    for _ in range(rounds):
        for c in order:
            rest = [j for j in range(x.shape[1]) if j != c]
            known = ~gaps[:, c]
            design = np.c_[np.ones(len(out)), out[:, rest]]
            beta = np.linalg.lstsq(design[known], out[known, c], rcond=None)[0]
            out[~known, c] = design[~known] @ beta
    return out


@pytest.mark.parametrize("table_columns", [8, 1])
def test_chained_linear_rounds(spark, monkeypatch, table_columns):
    monkeypatch.setattr(chained, "TABLE_COLUMNS", table_columns)
    rng = np.random.default_rng(5)
    x = rng.normal(50, 5, (300, 1)) + rng.normal(0, 2, (300, 4))
    x[rng.random(x.shape) < [0.05, 0.0, 0.2, 0.1]] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(id=range(300))
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, id long")
    got = chained.chained(df, list("abcd"), rounds=4).orderBy("id").toPandas()[list("abcd")].to_numpy()
    assert np.allclose(got, chain_by_hand(x, 4), atol=1e-8)
    assert np.array_equal(got[~np.isnan(x)], x[~np.isnan(x)])


def test_auto_impute_leaves_no_gap_and_no_known_cell_changed(spark, sf_dir):
    v = visits(spark, sf_dir, ["visit_id", "age", "hr", "sbp", "spo2", "temp", "complaint", "triage"])
    v = v.withColumns({"lab": F.when(F.col("visit_id") % 5 != 0, F.col("sbp") + F.col("age")), "lab2": F.col("sbp") * 1.0})
    out, log = auto_impute.auto(v, "triage", "visit_id", auto_impute.Policy(rounds=2, category_trees=3))
    methods = {r["column"]: r["method"] for r in log.collect() if r["method"] != "indicator"}
    assert methods["lab"] == "knn" and methods["complaint"] == "forest" and methods["temp"] == "chained"
    a, b = v.toPandas().set_index("visit_id").sort_index(), out.toPandas().set_index("visit_id").sort_index()
    assert not b.drop(columns="triage").isna().any().any()
    for c in a.columns:
        known = a[c].notna()
        assert (a[c][known] == b[c][known]).all()


def test_smote_points_lie_between_class_members(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(120), "x": rng.normal(size=120), "z": rng.normal(size=120),
                        "y": ["a"] * 80 + ["b"] * 30 + ["c"] * 10})
    df = spark.createDataFrame(pdf)
    goals = balance.target_table(df, "y")
    new = smote.regular(df, "y", ["x", "z"], goals, "id").toPandas()
    assert new["y"].value_counts().to_dict() == {"b": 10, "c": 30}
    for _, r in new.iterrows():
        own = pdf[pdf["y"] == r["y"]]
        s = own[own["id"] == r["seed_id"]][["x", "z"]].to_numpy()[0]
        step, lines = r[["x", "z"]].to_numpy(float) - s, own[own["id"] != r["seed_id"]][["x", "z"]].to_numpy() - s
        cross = np.abs(lines[:, 0] * step[1] - lines[:, 1] * step[0])
        along = (lines @ step) / (lines**2).sum(axis=1)
        assert ((cross < 1e-9) & (along >= -1e-9) & (along <= 1)).any()


def test_tomek_cleaning_by_brute_force(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(90), "x": rng.normal(size=90), "z": rng.normal(size=90), "y": ["a"] * 60 + ["b"] * 30})
    df = spark.createDataFrame(pdf)
    goals = {"a": (60, 60), "b": (30, 45)}
    full = smote.with_synthetic(df, smote.regular(df, "y", ["x", "z"], goals, "id"), "y", ["x", "z"], "id", goals).toPandas()
    left = smote.combined(df, "y", ["x", "z"], goals, "id").toPandas()
    p = full[["x", "z"]].to_numpy()
    d = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = d.argmin(axis=1)
    linked = [i for i in range(len(p)) if near[near[i]] == i and full["y"][i] != full["y"][near[i]]]
    assert linked and set(left["id"]) == set(full["id"]) - set(full["id"][linked])


def test_calibration_is_monotone_and_sums_to_one(spark):
    rng = np.random.default_rng(6)
    s = rng.random(500)
    pdf = pd.DataFrame({"y": np.where(rng.random(500) < s**2, "a", "b"), "pa": s, "pb": 1 - s})
    df = spark.createDataFrame(pdf)
    scores = {"a": "pa", "b": "pb"}
    out = models.Calibrator.fit(df, "y", scores).apply(df, scores).toPandas().sort_values("pa")
    assert np.allclose(out["cal_a"] + out["cal_b"], 1.0)
    assert (np.diff(out["cal_a"]) >= -1e-12).all()


def test_shapley_adds_up_and_models_round_trip(spark, sf_dir, tmp_path):
    feats = ["age", "sbp", "spo2"]
    v = visits(spark, sf_dir, ["visit_id", *feats, "triage"]).na.drop()
    model = models.forest(v, feats, "triage", n_estimators=5, max_depth=5)
    scored = model.score(v)
    assert metrics.summary(scored, "triage", "prediction").first()["balanced_accuracy"] > 0.5
    again = models.forest(v, feats, "triage", n_estimators=5, max_depth=5).score(v)
    assert scored.select("visit_id", "prediction").exceptAll(again.select("visit_id", "prediction")).count() == 0
    model.save(spark, str(tmp_path), "forest")
    loaded = models.Fitted.load(spark, str(tmp_path), "forest")
    assert loaded.score(v).select("visit_id", "prediction").exceptAll(scored.select("visit_id", "prediction")).count() == 0
    phi = explain.sampled(model, v, "visit_id", rows=20, background=1, n_perm=2).toPandas()
    base = explain.sample_n(v, 1, "visit_id", 43)
    zero = model.probabilities(base).first()
    rows = {r["visit_id"]: r for r in model.probabilities(v).collect()}
    for (i, c), part in phi.groupby(["visit_id", "class"]):
        assert part["phi"].sum() == pytest.approx(rows[i][f"p_{c}"] - zero[f"p_{c}"], abs=1e-9)


def test_boosted_beats_majority(spark, sf_dir):
    feats = ["age", "sbp", "spo2"]
    v = visits(spark, sf_dir, ["visit_id", *feats, "triage"]).na.drop()
    out = models.boosted(v, feats, "triage", n_estimators=3, max_depth=3).score(v)
    total = sum(out.select("p_GREEN", "p_RED", "p_YELLOW").first())
    assert total == pytest.approx(1.0)
    assert metrics.summary(out, "triage", "prediction").first()["balanced_accuracy"] > 1 / 3 + 0.1


def test_io_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, float("nan"), None)], "id int, x double, s string")
    root = str(tmp_path)
    for fmt in ("parquet", "csv"):
        tables.write_stage(df, root, "clean", fmt)
        back = tables.read_stage(spark, root, "clean", fmt, df.schema)
        assert back.count() == 2 and back.columns == df.columns
    path = tables.write_report(df, root, "facts", "json")
    assert '"x":null' in "".join(r[0] for r in spark.read.text(path).collect())
    tables.write_report(df, root, "facts")
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{root}/x.xlsx")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, f"{root}/none.csv", df.schema)
    tables.save_state(spark, scaling.Scaler.fit(df.na.drop(), ["x"]).state(), root, "scaler")
    assert tables.load_state(spark, root, "scaler")["center"] == {"x": 2.5}


def test_fitted_steps_run_on_a_stream(spark, sf_dir, tmp_path):
    v = visits(spark, sf_dir, ["visit_id", "age", "hr", "sbp", "dbp", "spo2", "temp", "gcs"])
    v.write.parquet(str(tmp_path / "in"))
    fill = impute.fit_median(v, ["hr"])
    shock = features.fit_shock_index(v)
    stream = read_visits(spark, str(tmp_path / "in"), v.schema)
    out = apply_fitted(stream, [fill], shock)
    q = (out.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    batch = features.add_clinical(fill.apply(v), shock)[0]
    assert spark.table("seen").exceptAll(batch).count() == 0 and spark.table("seen").count() == v.count()
