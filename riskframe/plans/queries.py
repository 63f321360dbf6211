"""One query per operator over the given tables. Keys match ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions.scalars import clip, finite, flag, ratio, to_number
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
    knn_impute,
    lsh,
    metrics,
    models,
    neighbors,
    outliers,
    profile,
    rank,
    relevance,
    scaling,
    schema,
    selection,
    smote,
    split,
    study,
)
from ..session import durable, spread, work_folder
from ..sources import tables
from ..sources.visits import CLASSES, VITALS, preds, table, visits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

KEYS = ("visit_id", "patient_id")
SCORES = {"RED": "p_red", "YELLOW": "p_yellow", "GREEN": "p_green"}
PROFILED = ("arrival_mode", "complaint", "hr", "sbp", "dbp", "spo2", "temp", "gcs", "triage")
NEAR = ("hr", "sbp", "spo2", "gcs")
MODEL_FEATURES = ("age", "hr", "sbp", "dbp", "spo2", "temp", "gcs")
PRICES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded doubles without negative zero, for comparison across engines."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


# ---- scans, projections, filters ------------------------------------------------------------------------


@query
def scan_visits(spark, d):
    return visits(spark, d)


@query
def scan_table(spark, d):
    return tables.read_table(spark, f"{d}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_returnflag")


@query
def dataset_info(spark, d):
    return profile.dataset_info(visits(spark, d))


@query
def coerce_numeric(spark, d):
    v = visits(spark, d, ["visit_id", "pain_raw"])
    return schema.to_numeric(v.withColumn("pain", F.col("pain_raw")), ["pain", "absent"]).select("visit_id", "pain")


@query
def select_numeric(spark, d):
    v = visits(spark, d)
    return v.select("visit_id", *schema.roles(v, "triage", KEYS).numeric)


@query
def align_schema(spark, d):
    v = visits(spark, d, ["visit_id", "age", "hr", "sbp", "spo2"])
    return schema.align(v, ["sbp", "by_ambulance", "hr", "age"], keep=["visit_id"])


@query
def complete_cases(spark, d):
    return visits(spark, d, ["visit_id", *VITALS, "complaint"]).na.drop()


@query
def high_risk_cases(spark, d):
    return errors.high_risk(preds(spark, d, ["visit_id", "y_true", "y_pred"]), "y_true", "y_pred")


@query
def variance_filter(spark, d):
    v = visits(spark, d, ["age", *VITALS]).withColumn("site", F.lit(1.0))
    kept = features.variance_filter(v, v.columns)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query
def clean_numeric(spark, d):
    v = visits(spark, d, ["visit_id", "hr", "sbp", "dbp"]).select(
        "visit_id", F.when(F.col("sbp") == 61, F.lit(float("inf"))).otherwise(F.col("hr")).alias("hr"), "dbp")
    return r6(features.clean_numeric(v, features.fit_clean(v, ["hr", "dbp"])), "hr", "dbp")


@query
def age_category(spark, d):
    return features.age_band(visits(spark, d, ["visit_id", "age"])).select("visit_id", "age_category", "elderly_flag")


@query
def label_encode(spark, d):
    v = visits(spark, d, ["visit_id", "triage"])
    codec = encode.LabelCodec.fit(v, "triage")
    return v.withColumn("code", codec.encode("triage")).withColumn("decoded", codec.decode("code"))


@query
def one_hot(spark, d):
    v = visits(spark, d, ["visit_id", "arrival_mode", "complaint"])
    return encode.one_hot(v, ["arrival_mode", "complaint"]).drop("arrival_mode", "complaint")


@query
def binarize_label(spark, d):
    return encode.binarize(visits(spark, d, ["visit_id", "triage"]), "triage", CLASSES)


@query
def row_weights(spark, d):
    v = visits(spark, d, ["visit_id", "triage"])
    return r6(balance.attach_weights(v, "triage", balance.weight_table(v, "triage")), "weight")


@query
def concat_splits(spark, d):
    s = split.stratified(visits(spark, d, ["visit_id", "triage"]), "triage", "visit_id")
    return s.where(F.col("split") == "train").unionByName(s.where(F.col("split") == "validation"))


@query
def top_n(spark, d):
    return rank.top_n(visits(spark, d, ["visit_id", "hr", "sbp"]), "hr", 20, "visit_id")


@query
def scalar_math(spark, d):
    v = visits(spark, d, ["visit_id", "hr", "sbp", "temp"])
    return r6(v.select(
        "visit_id", F.abs(F.col("temp") - 37.0).alias("from_normal"), clip("hr", 60.0, 150.0).alias("hr_clipped"),
        ratio("hr", F.nullif(F.col("sbp"), F.lit(61.0))).alias("hr_per_sbp"),
        flag(finite(F.when(F.col("sbp") == 61, F.lit(float("inf"))).otherwise(F.col("sbp"))).isNull()).alias("was_inf"),
    ), "from_normal", "hr_clipped", "hr_per_sbp")


# ---- missing data ---------------------------------------------------------------------------------------


@query
def missing_profile(spark, d):
    return r6(profile.missing(visits(spark, d, PROFILED)), "missing_pct")


@query
def missing_profile_added(spark, d):
    """The profile of all visits from the stored cells of two parts."""
    v, root = visits(spark, d, ["visit_id", *PROFILED]), work_folder(spark, "out")
    for i in (0, 1):
        tables.write_stage(profile.cells(v.where(F.col("visit_id") % 2 == i).select(*PROFILED)), root, f"cells_{i}")
    stored = profile.merged(*[tables.read_stage(spark, root, f"cells_{i}") for i in (0, 1)])
    return r6(profile.missing_from(stored, v.select(*PROFILED).schema), "missing_pct")


@query
def missing_totals(spark, d):
    return r6(profile.missing_totals(visits(spark, d, PROFILED)), "missing_pct")


@query
def missing_patterns(spark, d):
    return profile.missing_patterns(visits(spark, d, PROFILED))


@query
def nullity_corr(spark, d):
    return r6(profile.nullity_corr(visits(spark, d, ["hr", "dbp", "spo2", "temp", "gcs", "sbp"])), "corr")


@query
def missing_indicators(spark, d):
    v = visits(spark, d, ["visit_id", *VITALS, "complaint"])
    marks = impute.indicator_columns(v)
    return impute.indicators(v, marks).select("visit_id", *[f"{c}_was_missing" for c in marks])


@query
def impute_median(spark, d):
    v = visits(spark, d, ["visit_id", *VITALS])
    return impute.fit_median(v, VITALS).apply(v)


@query
def impute_mode(spark, d):
    v = visits(spark, d, ["visit_id", "complaint"])
    return impute.fit_mode(v, ["complaint"]).apply(v)


@query
def correlated_features(spark, d):
    v = visits(spark, d, ["age", *VITALS])
    return r6(impute.correlated(v, "dbp", ["age", *VITALS]), "corr")


@query
def impute_knn(spark, d):
    v = visits(spark, d, ["visit_id", "dbp", "hr", "sbp", "spo2", "gcs", "age"])
    return r6(knn_impute.knn(v, "dbp", ["dbp", "hr", "sbp", "spo2", "gcs", "age"], "visit_id"), "dbp")


_KNN = ["dbp", "hr", "sbp", "spo2", "gcs", "age"]


@query
def impute_knn_lsh(spark, d):
    """The approximate search; ``impute_knn_lsh_checked`` measures it against the exact one."""
    return r6(knn_impute.knn(visits(spark, d, ["visit_id", *_KNN]), "dbp", _KNN, "visit_id", method="lsh"), "dbp")


@query
def impute_knn_lsh_checked(spark, d):
    """Visits without a value, those with five neighbours, and whether 95 % of these neighbours are as near as the true ones."""
    rows = durable(visits(spark, d, ["visit_id", *_KNN]).select(F.col("visit_id").alias("id"), *_KNN))
    queries, donors, dims = rows.where("dbp is null"), rows.where("dbp is not null"), _KNN[1:]
    true = neighbors.nearest(queries, donors, dims, 5).select("id", F.element_at("near", -1)["d2"].alias("limit"), F.size("near").alias("true"))
    both = true.join(lsh.nearest_lsh(queries, donors, dims, 5).select("id", "near"), "id", "left")
    hits = F.coalesce(F.size(F.filter("near", lambda p: p["d2"] <= F.col("limit") + 1e-9)), F.lit(0))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("near") == 5).alias("answered"),
                    (F.sum(hits) >= 0.95 * F.sum("true")).alias("recalled"))


@query
def label_encode_customers(spark, d):
    """Codes of a column with a value for every few rows: customers of orders."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return encode.with_codes(orders, "o_custkey", encode.code_table(orders, "o_custkey"))


@query
def one_hot_customers(spark, d):
    """The sum of the sparse one-hot vectors: a count per place of the vector."""
    orders = table(spark, d, "orders").select("o_custkey")
    codes = encode.code_table(orders, "o_custkey")
    hot = encode.one_hot_sparse(orders, "o_custkey", codes)
    total = hot.select(Summarizer.sum(F.col("vector")).alias("s"))
    return total.select(F.posexplode(vector_to_array("s")).alias("code", "value")).select(F.col("code").cast("bigint").alias("code"), F.col("value").cast("bigint").alias("n"))


@query
def impute_chained_linear(spark, d):
    v = visits(spark, d, ["visit_id", "hr", "spo2", "temp"])
    return r6(chained.ChainedLinear.fit(v, ["hr", "spo2", "temp"], rounds=1).apply(v), "hr", "spo2", "temp")


@query
def impute_chained_rounds(spark, d):
    v = visits(spark, d, ["visit_id", *VITALS])
    return r6(chained.chained(v, VITALS, rounds=10), *VITALS)


@query
def impute_chained_forest(spark, d):
    v = visits(spark, d, ["visit_id", *VITALS])
    return r6(chained.chained(v, VITALS, rounds=10, estimator="forest", trees=10), *VITALS)


@query
def impute_forest_category(spark, d):
    v = visits(spark, d, ["visit_id", "complaint", "arrival_mode", "age", "sbp", "gcs", "triage"])
    filled, _ = chained.forest_category(v, "complaint", "triage", ["visit_id"], trees=50)
    return filled.select("visit_id", "complaint")


def _mixed(spark, d):
    v = visits(spark, d)
    return schema.to_numeric(v.withColumn("pain", F.col("pain_raw")), ["pain"]).drop("pain_raw")


@query
def impute_auto(spark, d):
    filled, _ = auto_impute.auto(_mixed(spark, d), "triage", "visit_id", auto_impute.Policy(), ["patient_id", "arrival_ts"])
    return filled


@query
def imputation_log(spark, d):
    v = _mixed(spark, d).select("visit_id", "pain", "complaint", "hr", "sbp", "triage")
    policy = auto_impute.Policy(mode_below=0.10)
    _, log = auto_impute.auto(v, "triage", "visit_id", policy)
    return log.select("column", "method", "missing_before")


def _median_mode(spark, d):
    v = visits(spark, d, ["visit_id", *VITALS, "complaint", "arrival_mode"])
    return v, impute.fit_mode(v, ["complaint"]).apply(impute.fit_median(v, VITALS).apply(v))


@query
def imputation_quality(spark, d):
    before, after = _median_mode(spark, d)
    q = impute.quality(before, after, VITALS, ["complaint", "arrival_mode"])
    return r6(q, *[c for c, t in q.dtypes if t == "double"])


@query
def imputation_success(spark, d):
    before, after = _median_mode(spark, d)
    return r6(impute.success_rate(before, after, [*VITALS, "complaint"]), "success_pct")


@query
def improvement_table(spark, d):
    before, after = _median_mode(spark, d)
    return r6(impute.improvement(before, after), "change_pct")


# ---- features -------------------------------------------------------------------------------------------


@query
def vif(spark, d):
    return r6(features.vif(visits(spark, d, ["hr", "sbp"]), ["hr", "sbp"]), "vif")


@query
def vif_bands(spark, d):
    return features.vif_bands(visits(spark, d, ["hr", "sbp"]), ["hr", "sbp"])


@query
def drop_collinear(spark, d):
    _, log = features.drop_collinear(visits(spark, d, ["hr", "sbp", "spo2"]), ["hr", "sbp", "spo2"])
    return r6(log, "vif")


@query
def outliers_iqr(spark, d):
    q = outliers.outliers_iqr(visits(spark, d, ["age", *VITALS]), ["age", *VITALS])
    return r6(q, "q1", "q3", "lower", "upper", "iqr_pct")


@query
def outliers_iqr_prices(spark, d):
    q = outliers.outliers_iqr(table(spark, d, "lineitem").select(*PRICES), PRICES)
    return r6(q, "q1", "q3", "lower", "upper", "iqr_pct")


@query
def outliers_zscore(spark, d):
    return r6(outliers.outliers_z(visits(spark, d, ["age", *VITALS]), ["age", *VITALS]), "z_pct")


@query
def outlier_report(spark, d):
    return r6(outliers.outlier_report(visits(spark, d, VITALS), VITALS), "iqr_pct", "z_pct")


@query
def winsorize(spark, d):
    v = visits(spark, d, ["visit_id", *VITALS])
    return r6(outliers.Winsor.fit(v, VITALS, over_pct=1.0).apply(v), *VITALS)


@query
def log_transform(spark, d):
    v = visits(spark, d, ["visit_id", "age", "hr", "sbp"])
    return r6(outliers.log1p_if_positive(v, ["age", "hr", "sbp"])[0], "sbp")


def _scaled(method):
    def run(spark, d):
        v = visits(spark, d, ["visit_id", *VITALS])
        return r6(scaling.Scaler.fit(v, VITALS, method).apply(v), *VITALS)

    return run


QUERIES["scale_robust"] = _scaled("robust")
QUERIES["scale_standard"] = _scaled("standard")
QUERIES["scale_minmax"] = _scaled("minmax")


@query
def scalable_columns(spark, d):
    v = visits(spark, d).withColumns({"dbp_was_missing": F.col("dbp").isNull().cast("int"), "site": F.lit(1),
                                      "by_ambulance": (F.col("arrival_mode") == "F").cast("int")})
    return spark.createDataFrame([(c,) for c in scaling.scalable_columns(v, "triage", KEYS)], "feature string")


@query
def early_warning_score(spark, d):
    return features.early_warning(visits(spark, d, ["visit_id", "hr", "sbp", "spo2", "temp", "gcs"])).drop(
        "hr", "sbp", "spo2", "temp", "gcs")


@query
def shock_index(spark, d):
    v = visits(spark, d, ["visit_id", "hr", "sbp"])
    return r6(features.shock_index(v, features.fit_shock_index(v)).drop("hr", "sbp"), "shock_index")


@query
def mean_arterial_pressure(spark, d):
    return r6(features.map_pressure(visits(spark, d, ["visit_id", "sbp", "dbp"])).drop("sbp", "dbp"), "map")


@query
def abnormal_vitals(spark, d):
    return features.abnormal_count(visits(spark, d, ["visit_id", "hr", "sbp", "spo2", "temp"])).select(
        "visit_id", "abnormal_vitals_count")


@query
def pain_flags(spark, d):
    v = visits(spark, d, ["visit_id", "pain_raw"]).withColumn("pain", to_number("pain_raw"))
    return features.pain_flags(v).select("visit_id", "severe_pain", "no_pain")


@query
def clinical_features(spark, d):
    v = visits(spark, d, ["visit_id", "age", *VITALS, "pain_raw"])
    out, new = features.add_clinical(v)
    return r6(out.select("visit_id", *new), "shock_index", "map")


@query
def anova_f(spark, d):
    return r6(relevance.anova_f(visits(spark, d, [*MODEL_FEATURES, "triage"]), MODEL_FEATURES, "triage"), "f_score")


@query
def mutual_info(spark, d):
    return r6(relevance.mutual_info(visits(spark, d, [*MODEL_FEATURES, "triage"]), MODEL_FEATURES, "triage"), "mi_score")


@query
def feature_relevance(spark, d):
    q = relevance.rank(visits(spark, d, [*MODEL_FEATURES, "triage"]), MODEL_FEATURES, "triage")
    return r6(q, "f_score", "mi_score", "f_norm", "mi_norm", "combined")


@query
def five_number(spark, d):
    q = profile.five_number(table(spark, d, "lineitem").select(*PRICES), PRICES)
    return r6(q, "min", "q1", "median", "q3", "max")


# ---- splitting, resampling, weighting -------------------------------------------------------------------


@query
def class_distribution(spark, d):
    return r6(balance.distribution(visits(spark, d, ["triage"]), "triage"), "share", "imbalance_ratio")


@query
def stratified_split(spark, d):
    return split.stratified(visits(spark, d, ["visit_id", "triage"]), "triage", "visit_id").drop("triage")


@query
def calibration_split(spark, d):
    s = split.stratified(visits(spark, d, ["visit_id", "triage"]), "triage", "visit_id")
    held = s.where(F.col("split") == "validation").drop("split")
    return split.halves(held, "triage", "visit_id").drop("triage")


@query
def split_distribution(spark, d):
    s = split.stratified(visits(spark, d, ["visit_id", "triage"]), "triage", "visit_id")
    return r6(split.check(s, "triage"), "share")


@query
def grouped_split(spark, d):
    return split.grouped(visits(spark, d, ["visit_id", "patient_id"]), "patient_id")


@query
def grouped_split_events(spark, d):
    return split.grouped(table(spark, d, "events").select("event_id", "user_id"), "user_id")


@query
def temporal_split(spark, d):
    return split.temporal(table(spark, d, "events").select("event_id", "ts"), "ts").drop("ts")


@query
def resample_targets(spark, d):
    v = visits(spark, d, ["triage"])
    parts = [balance.targets(v, "triage", s).withColumn("strategy", F.lit(s)) for s in balance.RATIO_SHIFT]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _filled(spark, d):
    v = visits(spark, d, ["visit_id", "triage", *NEAR])
    return impute.fit_median(v, NEAR).apply(v)


def _smote(spark, d, how=smote.regular):
    v = _filled(spark, d)
    targets = balance.target_table(v, "triage")
    return v, how(v, "triage", NEAR, targets, "visit_id"), targets


QUERIES["smote"] = lambda spark, d: r6(_smote(spark, d)[1], *NEAR)
QUERIES["smote_borderline"] = lambda spark, d: r6(_smote(spark, d, smote.borderline)[1], *NEAR)
QUERIES["smote_tomek"] = lambda spark, d: r6(_smote(spark, d, smote.combined)[1], *NEAR)


@query
def tomek_links(spark, d):
    return smote.tomek_links(_filled(spark, d), "triage", NEAR, "visit_id")


def _resampled(spark, d):
    v, new, targets = _smote(spark, d)
    return v, smote.with_synthetic(v, new, "triage", NEAR, "visit_id", targets)


@query
def resample_report(spark, d):
    q = balance.report(*_resampled(spark, d), "triage")
    return r6(q, "change_pct", "ir_before", "ir_after", "synthetic_pct")


@query
def class_weights(spark, d):
    return r6(balance.class_weights(_resampled(spark, d)[1], "triage"), "raw_weight", "weight")


@query
def quality_checks(spark, d):
    return balance.quality_checks(*_resampled(spark, d), "triage")


@query
def stratified_kfold(spark, d):
    return split.kfold(visits(spark, d, ["visit_id", "triage"]), "triage", "visit_id").drop("triage")


@query
def sample_n(spark, d):
    return split.sample_n(visits(spark, d, ["visit_id", "sbp", "triage"]), 500, "visit_id")


@query
def stratified_split_labels(spark, d):
    """Numeric classes of very different sizes, and rows whose class is missing: a stratum of their own."""
    rows = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 10 != 7, F.col("toxic")).alias("toxic"))
    return split.stratified(rows, "toxic", "doc_id")


@query
def stratified_split_lines(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("lines"))
    return split.stratified(lines, "lines", "l_orderkey")


@query
def quality_checks_failed(spark, d):
    """As many neighbours asked for as the smallest class has rows, more than any of its rows has: the original rows come back and the gates say so."""
    v = durable(_filled(spark, d))
    goals = balance.target_table(v, "triage")
    rows, done = smote.attempt(v, "triage", NEAR, goals, "visit_id", k=min((n for n, _ in goals.values()), default=0))
    return balance.quality_checks(v, rows, "triage", succeeded=done)


@query
def resample_report_vanished(spark, d):
    """Classes that are in one table only."""
    v = visits(spark, d, ["triage"])
    return r6(balance.report(v.where("triage <> 'GREEN'"), v.where("triage <> 'RED'"), "triage"), "change_pct", "synthetic_pct")


# ---- handoffs: written, read back -----------------------------------------------------------------------


LINES = "l_orderkey bigint, l_linenumber bigint, l_quantity double, l_returnflag string"


def _lines(spark, d):
    return table(spark, d, "lineitem").select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in LINES.split(", ")])


@query
def stage_round_trip(spark, d):
    root = work_folder(spark, "stages")
    tables.write_stage(_lines(spark, d), root, "lines", partition_by=["l_returnflag"])
    return tables.read_stage(spark, root, "lines", schema=LINES)


@query
def scan_csv(spark, d):
    root = work_folder(spark, "stages")
    tables.write_stage(_lines(spark, d), root, "lines", fmt="csv")
    return tables.read_stage(spark, root, "lines", fmt="csv", schema=LINES)


@query
def report_csv(spark, d):
    path = tables.write_report(profile.five_number(table(spark, d, "lineitem"), PRICES), work_folder(spark, "out"), "prices")
    names = "feature string, min double, q1 double, median double, q3 double, max double"
    return r6(spark.read.schema(names).option("header", True).csv(path), "min", "q1", "median", "q3", "max")


@query
def report_json(spark, d):
    """JSON has no infinity and no NaN: both come back as null."""
    v = visits(spark, d, ["visit_id", "sbp"]).withColumn("x", F.when(F.col("visit_id") % 3 == 0, F.lit(float("inf")))
                                                         .when(F.col("visit_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("sbp")))
    path = tables.write_report(v, work_folder(spark, "out"), "rows", "json")
    return spark.read.schema("visit_id bigint, sbp double, x double").json(path)


@query
def state_round_trip(spark, d):
    """Medians fitted on one side, saved, loaded and applied on the other."""
    v = visits(spark, d, ["visit_id", *NEAR])
    root = work_folder(spark, "out")
    tables.save_state(spark, features.fit_clean(v, NEAR), root, "fills")
    return r6(features.clean_numeric(v, tables.load_state(spark, root, "fills")), *NEAR)


@query
def attribution_sink(spark, d):
    root = work_folder(spark, "out")
    tables.write_stage(_phi(spark, d), root, "phi", partition_by=["class"])
    return r6(tables.read_stage(spark, root, "phi", schema="visit_id bigint, class string, feature string, phi double"), "phi")


@query
def model_round_trip(spark, d):
    """A saved model scores as it did before: rows per split, and on how many both agree."""
    v = _training(spark, d)
    model = models.logistic(v.where("split = 'train'"), MODEL_FEATURES, "triage", "weight", max_iter=20)
    root = work_folder(spark, "out")
    model.save(spark, root, "logistic")
    again = models.Fitted.load(spark, root, "logistic").score(v).select("visit_id", F.col("prediction").alias("again"))
    both = model.score(v).join(again, "visit_id")
    total = sum((F.col(f"p_{c}") for c in model.classes), F.lit(0.0))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("again")).alias("agree"),
                                     F.count_if(F.abs(total - 1) < 1e-9).alias("sum_to_one"))


# ---- models ---------------------------------------------------------------------------------------------


def _training(spark, d):
    """Split first, then fit the fills on training rows only; weights from the training classes."""
    v = split.stratified(visits(spark, d, ["visit_id", *MODEL_FEATURES, "triage"]), "triage", "visit_id")
    v = durable(spread(v, "visit_id"))  # the stage table that fills, weights, fits and scoring read
    train = F.col("split") == "train"
    v = impute.fit_median(v.where(train), MODEL_FEATURES).apply(v)
    return balance.attach_weights(v, "triage", balance.weight_table(v.where(train), "triage"))


def _scored(kind, **params):
    def run(spark, d):
        v = _training(spark, d)
        model = models.TRAINERS[kind](v.where("split = 'train'"), MODEL_FEATURES, "triage", "weight", **params)
        return model.score(v).select("visit_id", "split", "triage", "prediction", *[f"p_{c}" for c in model.classes])

    return run


# Settings inside the reference's search ranges (models.GRIDS); the other parameters' defaults lie in them too.
BOOSTED = {"n_estimators": 200}
FOREST = {"n_estimators": 200, "max_depth": 18}

QUERIES["boosted_trees"] = _scored("boosted", **BOOSTED)
QUERIES["random_forest"] = _scored("forest", **FOREST)
QUERIES["logistic"] = _scored("logistic", max_iter=1000)


def _folds(spark, d, n):
    v = _training(spark, d).where("split = 'train'").select("visit_id", *MODEL_FEATURES, "triage", "weight")
    return split.kfold(v, "triage", "visit_id", n)


@query
def grid_search_cv(spark, d):
    """The whole grid over five folds; the best setting's row has the balanced accuracy of its refit on all training rows."""
    folds = _folds(spark, d, 5)
    table, model = models.search(folds, "forest", MODEL_FEATURES, "triage", "fold", "weight")
    refit = metrics.summary(model.score(folds), "triage", "prediction").select(F.col("balanced_accuracy").alias("refit_score"))
    best = table.limit(1).select("setting").crossJoin(F.broadcast(refit))  # one row each
    return table.join(F.broadcast(best), "setting", "left").select(*table.columns, "refit_score").orderBy(F.desc("mean_score"), "setting")


@query
def soft_vote(spark, d):
    p = preds(spark, d)
    sure = [(F.col(c) == name).cast("double").alias(f"{m}_{name}") for m, c in (("a", "y_pred"), ("b", "y_pred_b"))
            for name in SCORES]
    wide = p.select("visit_id", *sure, *[F.col(c).alias(f"c_{name}") for name, c in SCORES.items()])
    out = models.soft_vote(wide, ["c", "a", "b"], list(SCORES))
    return r6(out, "p_RED", "p_YELLOW", "p_GREEN").select("visit_id", "p_RED", "p_YELLOW", "p_GREEN", "prediction")


@query
def isotonic_calibration(spark, d):
    p = preds(spark, d, ["visit_id", "y_true", "p_red", "p_yellow", "p_green"])
    parts = split.halves(p, "y_true", "visit_id")
    fitted = models.Calibrator.fit(parts.where("split = 'calibrate'"), "y_true", SCORES)
    out = fitted.apply(parts, SCORES).select("visit_id", "split", *[f"cal_{c}" for c in SCORES])
    return r6(out, *[f"cal_{c}" for c in SCORES])


def _three_models(spark, d):
    p = split.stratified(preds(spark, d, ["visit_id", "y_true", "y_pred", "y_pred_b", "p_red", "p_yellow", "p_green"]),
                         "y_true", "visit_id").where(F.col("split").isin("train", "validation"))
    soft = models.arg_max({name: F.col(c) for name, c in SCORES.items()})
    cells = schema.rows({"model": "A", "p": F.col("y_pred")}, {"model": "B", "p": F.col("y_pred_b")},
                        {"model": "C", "p": soft})
    return p.select("split", F.col("y_true").alias("y"), cells.alias("m")).select("split", "y", "m.*")


@query
def model_comparison(spark, d):
    q = selection.compare(_three_models(spark, d), "y", "p")
    return r6(q, "val_balanced", "val_f1", "acc_gap", "selection_score")


@query
def model_selection(spark, d):
    q = selection.select(_three_models(spark, d), "y", "p", ["A", "B", "C"])
    return r6(q, "val_balanced", "val_f1", "acc_gap", "selection_score")


@query
def feature_importance(spark, d):
    v = _training(spark, d).where("split = 'train'").select(*MODEL_FEATURES, "triage", "weight").persist()
    try:
        fitted = {
            "boosted": models.boosted(v, MODEL_FEATURES, "triage", "weight", **BOOSTED),
            "forest": models.forest(v, MODEL_FEATURES, "triage", "weight", **FOREST),
            "logistic": models.logistic(v, MODEL_FEATURES, "triage", "weight"),
        }
    finally:
        v.unpersist()
    return models.importance(spark, fitted, models.BLEND)


@query
def detailed_predictions(spark, d):
    p = preds(spark, d, ["visit_id", "y_true", "y_pred", "p_red", "p_yellow", "p_green"])
    return r6(models.detailed_predictions(p, "y_true", "y_pred", SCORES, "visit_id"), "prob_RED", "prob_YELLOW", "prob_GREEN")


@query
def baseline_dummy(spark, d):
    v = visits(spark, d, ["visit_id", "triage"])
    return baselines.dummy(v, v, "triage")


@query
def baseline_rules(spark, d):
    return baselines.rules(visits(spark, d, ["visit_id", "hr", "sbp", "spo2", "temp", "triage"])).select(
        "visit_id", "triage", "prediction")


@query
def baseline_learned(spark, d):
    v = _training(spark, d)
    fitted = baselines.learned(v.where("split = 'train'"), MODEL_FEATURES, "triage")
    parts = [metrics.summary(m.score(v), "triage", "prediction", ["split"]).withColumn("model", F.lit(name))
             for name, m in fitted.items()]
    return parts[0].unionByName(parts[1])


# ---- evaluation -----------------------------------------------------------------------------------------


@query
def confusion_matrix(spark, d):
    return r6(metrics.confusion(preds(spark, d, ["y_true", "y_pred"]), "y_true", "y_pred", CLASSES), "row_share")


def _summary(*names):
    def run(spark, d):
        s = metrics.summary(preds(spark, d, ["y_true", "y_pred"]), "y_true", "y_pred")
        return r6(s.select(*names), *names)

    return run


QUERIES["balanced_accuracy"] = _summary("accuracy", "balanced_accuracy")
QUERIES["f1_scores"] = _summary("macro_f1", "weighted_f1")
QUERIES["mcc"] = _summary("mcc")


@query
def classification_report(spark, d):
    p = preds(spark, d, ["y_true", "y_pred", "p_red", "p_yellow", "p_green"])
    return r6(metrics.report(p, "y_true", "y_pred", SCORES), "precision", "recall", "f1", "auc")


@query
def vif_dependent(spark, d):
    """One column is twice another: those two are infinite, the others keep their factors."""
    return r6(features.vif(_dependent(spark, d), list(DEPENDENT)).where("vif < double('infinity')"), "vif")


DEPENDENT = ("l_extendedprice", "l_quantity", "twice", "l_discount")


def _dependent(spark, d):
    rows = table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")])
    return rows.withColumn("twice", 2 * F.col("l_quantity"))


@query
def drop_collinear_table(spark, d):
    """The reduced table: of the dependent pair the first goes, then nothing is above the limit of 1000."""
    return features.drop_collinear(_dependent(spark, d), list(DEPENDENT), limit=1000.0)[0].agg(
        *[F.round(F.sum(c), 2).alias(c) for c in ("l_extendedprice", "twice", "l_discount")])


def _gaps(spark, d, first, second):
    p = split.stratified(preds(spark, d, ["visit_id", "y_true", "y_pred"]), "y_true", "visit_id")
    g = metrics.gaps(p, "y_true", "y_pred", "split", first, second)
    return r6(g, *[c for c in g.columns if c != "band"])


@query
def overfit_gaps_train_test(spark, d):
    return _gaps(spark, d, "train", "test")


@query
def overfit_gaps_validation_test(spark, d):
    return _gaps(spark, d, "validation", "test")


@query
def overfit_gaps(spark, d):
    p = split.stratified(preds(spark, d, ["visit_id", "y_true", "y_pred"]), "y_true", "visit_id")
    g = metrics.gaps(p, "y_true", "y_pred", "split")
    return r6(g, *[c for c, t in g.dtypes if t == "double"])


def _probabilities(spark, d):
    return preds(spark, d, ["y_true", "p_red", "p_yellow", "p_green"])


@query
def roc_auc(spark, d):
    return r6(curves.auc(_probabilities(spark, d), "y_true", SCORES), "auc")


@query
def roc_auc_macro(spark, d):
    return r6(curves.macro_auc(_probabilities(spark, d), "y_true", SCORES), "macro_auc")


@query
def roc_curve(spark, d):
    return r6(curves.roc_curve(_probabilities(spark, d), "y_true", SCORES), "threshold", "fpr", "tpr")


@query
def pr_curve(spark, d):
    return r6(curves.pr_curve(_probabilities(spark, d), "y_true", SCORES), "threshold", "precision", "recall")


@query
def average_precision(spark, d):
    return r6(curves.average_precision(_probabilities(spark, d), "y_true", SCORES), "average_precision")


@query
def calibration_curve(spark, d):
    q = curves.calibration(_probabilities(spark, d), "y_true", SCORES)
    return r6(q, "mean_predicted", "fraction_positive")


@query
def brier(spark, d):
    return r6(metrics.brier(_probabilities(spark, d), "y_true", SCORES), "brier")


@query
def crosstab_margins(spark, d):
    return metrics.crosstab(preds(spark, d, ["y_true", "y_pred"]), "y_true", "y_pred")


@query
def misclass_patterns(spark, d):
    return r6(errors.patterns(preds(spark, d, ["y_true", "y_pred"]), "y_true", "y_pred"), "pct")


@query
def triage_error_counts(spark, d):
    return errors.error_counts(preds(spark, d, ["y_true", "y_pred"]), "y_true", "y_pred")


# ---- explanation ----------------------------------------------------------------------------------------

SLOPES = {
    "RED": {"hr": 0.02, "sbp": -0.01, "spo2": -0.05},
    "YELLOW": {"hr": 0.01, "sbp": 0.005, "spo2": -0.02},
    "GREEN": {"hr": -0.03, "sbp": 0.005, "spo2": 0.07},
}


@query
def shapley_sampled(spark, d):
    v = _training(spark, d)
    model = models.forest(v.where("split = 'train'"), MODEL_FEATURES, "triage", "weight", **FOREST)
    return explain.sampled(model, v.where("split = 'test'"), "visit_id", background=100)


def _phi(spark, d):
    return explain.linear(visits(spark, d, ["visit_id", "hr", "sbp", "spo2"]), "visit_id", SLOPES)


@query
def shapley_linear(spark, d):
    return r6(_phi(spark, d), "phi")


@query
def shapley_global(spark, d):
    return r6(explain.global_importance(_phi(spark, d)), "importance")


@query
def shapley_by_class(spark, d):
    return r6(explain.class_importance(_phi(spark, d)), "importance")


# ---- study ----------------------------------------------------------------------------------------------


@query
def bootstrap_ci(spark, d):
    q = study.bootstrap(preds(spark, d, ["visit_id", "y_true", "y_pred"]), "y_true", "y_pred", "visit_id", n=1000)
    return r6(q, "mean", "low", "median", "high")


@query
def bootstrap_ci_table(spark, d):
    return study.bootstrap_from_table(preds(spark, d, ["y_true", "y_pred"]), "y_true", "y_pred")


@query
def mcnemar(spark, d):
    return r6(study.mcnemar_counts(preds(spark, d, ["y_true", "y_pred", "y_pred_b"]), "y_true", "y_pred", "y_pred_b"),
              "statistic")


@query
def subgroup_metrics(spark, d):
    p = preds(spark, d, ["y_true", "y_pred", "age", "arrival_mode"])
    dims = {"age": C.age_band(), "arrival": F.col("arrival_mode"), "ambulance": F.col("arrival_mode") == "F"}
    q = study.subgroups(p, "y_true", "y_pred", dims)
    return r6(q, "accuracy", "balanced_accuracy", "macro_f1", "max_gap")


@query
def learning_curve_sizes(spark, d):
    shares = [(i + 1) / 10 for i in range(10)]
    steps = split.nested_samples(visits(spark, d, ["visit_id"]), "visit_id", shares)
    return steps.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("visit_id").alias("key_sum"))


def _ready(spark, d):
    v = durable(spread(visits(spark, d, ["visit_id", "arrival_ts", *MODEL_FEATURES, "triage"]), "visit_id"))
    return impute.fit_median(v, MODEL_FEATURES).apply(v)


@query
def learning_curve(spark, d):
    return study.learning_curve(_ready(spark, d), MODEL_FEATURES, "triage", "visit_id")


@query
def ablation(spark, d):
    v = split.stratified(_ready(spark, d), "triage", "visit_id")
    groups = {"circulation": ["hr", "sbp", "dbp"], "breathing": ["spo2"], "general": ["age", "temp", "gcs"]}
    return study.ablation(v.where("split = 'train'"), v.where("split = 'test'"), groups, "triage", **FOREST)


@query
def temporal_validation(spark, d):
    return study.temporal_validation(_ready(spark, d), MODEL_FEATURES, "triage", "arrival_ts", **FOREST)


# ---- what must hold for trained and iterated results, as exact counts -----------------------------------


def _filled_counts(spark, d, name, columns):
    """Rows, cells still empty, and rows whose given values are untouched."""
    before = visits(spark, d, ["visit_id", *columns]).withColumnsRenamed({c: f"_{c}" for c in columns})
    both = QUERIES[name](spark, d).join(before, "visit_id")
    gaps, same = F.lit(0), F.lit(True)
    for c in columns:
        gaps = gaps + F.col(c).isNull().cast("int")
        given = F.col(f"_{c}") if both.schema[c].dataType.typeName() == "string" else F.round(f"_{c}", 6) + 0.0
        now = F.col(c) if both.schema[c].dataType.typeName() == "string" else F.round(c, 6) + 0.0
        same = same & (given.isNull() | (given == now))
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(gaps).alias("gaps"), F.count_if(same).alias("kept"))


def _trained_counts(spark, d, name):
    """Per split: rows, probabilities that sum to 1, and whether recall over classes beats a constant answer."""
    rows = QUERIES[name](spark, d)
    total = sum((F.col(c) for c in rows.columns if c.startswith("p_")), F.lit(0.0))
    per = rows.groupBy("split", "triage").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - 1) < 1e-9).alias("sum_to_one"),
                                              F.avg((F.col("prediction") == F.col("triage")).cast("double")).alias("recall"))
    return per.groupBy("split").agg(F.sum("n").alias("n"), F.sum("sum_to_one").alias("sum_to_one"),
                                    (F.avg("recall") > 1 / 3 + 0.02).alias("learned"))


def _inside(*columns):
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))
    return F.count_if(ok).alias("inside")


def _register_checked():
    vitals, numeric = list(VITALS), list(MODEL_FEATURES)
    for name, columns in (("impute_chained_rounds", vitals), ("impute_chained_forest", vitals), ("impute_forest_category", ["complaint"]),
                          ("impute_auto", [*numeric, "complaint"])):
        QUERIES[f"{name}_checked"] = lambda spark, d, name=name, columns=columns: _filled_counts(spark, d, name, columns)
    for name in ("boosted_trees", "random_forest", "logistic"):
        QUERIES[f"{name}_checked"] = lambda spark, d, name=name: _trained_counts(spark, d, name)


_register_checked()


@query
def grid_search_cv_checked(spark, d):
    """Every setting of the search, whether its scores are shares, and whether only the best one has a refit."""
    q = grid_search_cv(spark, d)
    ok = F.col("mean_score").between(0.0, 1.0) & F.col("mean_train_score").between(0.0, 1.0) & (F.col("std_score") >= 0)
    # no setting of at least 150 trees answers as badly as a constant does
    best = F.col("mean_score") == F.max("mean_score").over(Window.partitionBy("model"))
    return q.select("setting", "params", ok.alias("inside"), (F.col("mean_score") > 1 / 3 + 0.05).alias("learned"),
                    (F.col("refit_score").isNull() | best).alias("refit_is_best"))


@query
def feature_importance_checked(spark, d):
    q = feature_importance(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("total"))
    return r6(q, "total")


@query
def baseline_learned_checked(spark, d):
    return baseline_learned(spark, d).groupBy("model", "split", "n").agg(_inside("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1"))


@query
def shapley_sampled_checked(spark, d):
    """Shares of the classes cancel for every row and feature, as probabilities sum to 1."""
    per = shapley_sampled(spark, d).groupBy("visit_id", "feature").agg(F.count(F.lit(1)).alias("classes"), F.sum("phi").alias("total"))
    return per.agg(F.countDistinct("visit_id").alias("visits"), F.count(F.lit(1)).alias("cells"), F.sum("classes").alias("n"),
                   F.count_if(F.abs("total") < 1e-9).alias("cancel"))


@query
def bootstrap_ci_table_checked(spark, d):
    """Every interval holds the metric of the table itself."""
    q = bootstrap_ci_table(spark, d)
    whole = metrics.summary(preds(spark, d, ["y_true", "y_pred"]), "y_true", "y_pred")
    whole = whole.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in study.METRICS])).alias("r")).select("r.*")
    return q.join(whole, "metric").select("metric", F.round("value", 6).alias("value"), F.col("value").between(F.col("low"), F.col("high")).alias("inside"),
                                          ((F.col("low") <= F.col("median")) & (F.col("median") <= F.col("high"))).alias("ordered"))


@query
def learning_curve_checked(spark, d):
    """All ten sizes of the curve: whether scores are shares, and whether more rows taught more than a tenth of them did."""
    q = learning_curve(spark, d)
    ends = q.agg(F.max_by("validation_score", "share").alias("_last"), F.min_by("validation_score", "share").alias("_first"))
    return q.crossJoin(F.broadcast(ends)).agg(F.count(F.lit(1)).alias("steps"), _inside("train_score", "validation_score"),
                                              F.count_if(F.col("validation_std") >= 0).alias("spreads"),
                                              F.bool_and(F.col("_last") >= F.col("_first") - 0.02).alias("rises"))


@query
def ablation_checked(spark, d):
    q = ablation(spark, d)
    whole = q.where("dropped = '(none)'").select(F.col("balanced_accuracy").alias("_whole"))  # one row
    return q.crossJoin(F.broadcast(whole)).groupBy("dropped").agg(
        _inside("balanced_accuracy"), F.count_if(F.abs(F.col("_whole") - F.col("balanced_accuracy") - F.col("loss")) < 1e-9).alias("adds_up"))


@query
def temporal_validation_checked(spark, d):
    return temporal_validation(spark, d).groupBy("split", "n").agg(_inside("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1"))
