"""Times the headline queries once each, after one warm-up, and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated; "all" for every
registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskframe.plans.queries import QUERIES  # noqa: E402
from riskframe.session import local_session  # noqa: E402

HEADLINE = (
    "scan_visits", "coerce_numeric", "one_hot", "row_weights", "missing_profile", "missing_patterns", "nullity_corr",
    "impute_median", "impute_mode", "correlated_features", "impute_knn", "impute_chained_linear", "impute_chained_rounds",
    "imputation_quality", "vif", "drop_collinear", "outliers_iqr_prices", "outlier_report", "winsorize", "scale_robust",
    "clinical_features", "anova_f", "mutual_info", "feature_relevance", "five_number", "stratified_split", "grouped_split",
    "temporal_split", "smote", "smote_borderline", "tomek_links", "class_weights", "stratified_kfold", "random_forest",
    "logistic", "soft_vote", "isotonic_calibration", "model_selection", "classification_report", "roc_auc", "roc_curve",
    "pr_curve", "calibration_curve", "crosstab_margins", "shapley_global", "bootstrap_ci", "mcnemar", "subgroup_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = local_session(cpus, partitions=cpus)
    QUERIES["clinical_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
