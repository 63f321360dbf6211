"""The whole study on the smallest tables."""

from riskframe.plans import pipeline
from riskframe.sources import tables
from riskframe.sources.visits import visits


def test_study_end_to_end(spark, sf_dir, tmp_path):
    raw = visits(spark, sf_dir, ["visit_id", "age", "hr", "sbp", "dbp", "spo2", "temp", "gcs", "pain_raw", "complaint", "arrival_mode", "triage"]
                 ).withColumnRenamed("pain_raw", "pain")
    small = pipeline.Study(rounds=2, text=("complaint", "arrival_mode"), category_trees=3, boosted={"n_estimators": 3, "max_depth": 3},
                           forest={"n_estimators": 5, "max_depth": 6}, tuned=("logistic",), grids={"logistic": {"C": [0.5, 1.0]}}, folds=2,
                           curve={"shares": (0.5, 1.0), "folds": 2, "n_estimators": 5, "max_depth": 6}, explained_rows=20)
    root = str(tmp_path)
    out = pipeline.run(spark, raw, root, small).first()
    held = tables.read_stage(spark, root, "split").where("split = 'test'").count()
    assert out["balanced_accuracy"] > 0.5 and out["n"] == held
    assert tables.read_stage(spark, root, "attributions").count() > 0

    report = lambda name, fmt="csv": spark.read.option("header", True).option("inferSchema", True).format(fmt).load(f"{root}/reports/{name}.{fmt}")
    assert tables.read_stage(spark, root, "imputed").where("complaint IS NULL OR dbp IS NULL").count() == 0
    assert report("imputation_success").first()["success_pct"] == 100
    assert {r["column"] for r in report("imputation_quality").collect()} >= {"dbp", "complaint"}
    assert report("text_fills").where("column = 'complaint'").first()["method"] == "forest"
    assert report("outliers").count() == 8
    kept = {r["feature"] for r in report("relevance").collect()}
    gone = {r["feature"] for r in report("collinear").collect()}
    assert kept and gone and not kept & gone
    assert report("tuning_logistic", "json").count() == 2
    assert tables.load_state(spark, root, "settings")["logistic"]["C"] in (0.5, 1.0)
    scores = {r["model"]: r["balanced_accuracy"] for r in report("baselines").collect()}
    assert set(scores) == {out["model"] + "_chosen", "majority", "rules", "logistic", "tree"}
    assert scores["majority"] < scores[out["model"] + "_chosen"]
    assert report("paired_tests").where("p_value BETWEEN 0 AND 1").count() == 4
    assert {r["dim"] for r in report("subgroups").collect()} == {"age_category", "complaint", "arrival_mode"}
    assert report("learning_curve").count() == 2
    dropped = {r["dropped"] for r in report("ablation").collect()}
    assert dropped >= {"(none)", "vitals", "missing", "derived"}
