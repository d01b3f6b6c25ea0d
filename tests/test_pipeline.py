"""The whole batch run writes every artefact and they read back consistently."""

import os
import tempfile

from retainspark.plans.pipeline import run_pipeline


def test_pipeline_end_to_end(spark):
    out = tempfile.mkdtemp(prefix="pipe-", dir="/tmp")
    res = run_pipeline(spark, "/root/testdata/sf0.01", out, rounds=3, trees=5,
                       models=["LogisticRegression", "RandomForest"], cross_validate=False)
    for d in ["raw", "features", "splits", "model", "metrics", "thresholds", "scored", "feature_importance",
              "explainer", "threshold_curve", "model_comparison"]:
        assert os.path.isdir(os.path.join(out, d)), d
    doc = spark.read.json(os.path.join(out, "metrics")).first()
    assert doc["model_name"] == res["model"]
    assert len(doc["threshold_analysis"]["thresholds"]) == 62
    scored = spark.read.parquet(os.path.join(out, "scored"))
    assert scored.count() == 300 and "recommended_action" in scored.columns
    imp = spark.read.option("header", True).csv(os.path.join(out, "feature_importance"))
    assert imp.count() == 15
