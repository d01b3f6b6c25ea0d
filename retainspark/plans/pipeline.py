"""The whole batch run in one driver program.

customer base -> quality gates -> features -> exact split -> train/compare
-> evaluate (thresholds, metrics document) -> scored table -> explanations.
Stage outputs that later stages reuse (customer base, features, splits,
scored table) are written once as parquet under ``out_dir`` and read back,
so every later pass starts from stored data, not from the lineage.

usage: python -m retainspark.plans.pipeline --sf-dir DIR --out DIR [--rounds N] [--trees N]
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import explain as xp
from ..operators import quality as qa
from ..operators import reports as rp
from ..operators import train as tr
from ..operators.features import feature_table, high_value_quantiles
from ..operators.scoring import labelled, score_model, scored_table
from ..operators.split import stratified_split
from ..schema import FEATURES, LABEL_RATE_RANGE
from ..session import build_session, table
from ..sources import files
from ..sources.customer_base import customer_base
from ..sources.published import publish


def _store(df: DataFrame, path: str) -> DataFrame:
    files.write_parquet(df, path)
    return df.sparkSession.read.parquet(path)


def run_pipeline(spark: SparkSession, sf_dir: str, out_dir: str, rounds: int = 400, trees: int = 300,
                 models: list[str] | None = None, cross_validate: bool = True, expected_rows: int | None = None,
                 select_on: str = "test", shapley_permutations: int = 4, shapley_background: int = 64) -> dict:
    p = lambda *a: os.path.join(out_dir, *a)
    # 1 ingest + gates (V1-V4)
    side = spark.newSession()   # observed, see Gates
    checked = qa.Gates(customer_base(table(side, sf_dir, "customer"), table(side, sf_dir, "orders")))
    files.write_parquet(checked.watched, p("raw"))
    cust = spark.read.parquet(p("raw"))
    gates = checked.result(expected_rows=expected_rows).first()
    if not (gates["rows_ok"] and gates["nulls_ok"] and gates["label_rate_ok"]):
        raise ValueError(f"quality gates failed: {gates.asDict()} (label rate range {LABEL_RATE_RANGE})")
    files.write_csv(cust, p("raw_csv"))
    files.write_parquet(qa.profile(cust), p("profile"))
    # 2 features (F1-F14) + correlations (A1)
    q = high_value_quantiles(cust).first()
    feat = _store(feature_table(cust, quantiles=(q["q_balance"], q["q_salary"])), p("features"))
    files.write_json_doc(spark.createDataFrame([(FEATURES,)], "feature_names array<string>"), p("feature_names"))
    files.write_parquet(rp.correlations(feat), p("correlations"))
    # 3 split (M1, A11)
    splits = _store(stratified_split(feat), p("splits"))
    files.write_parquet(rp.split_rates(splits), p("split_rates"))
    # 4 train / compare / select
    results, fitted = tr.compare_models(splits, rounds=rounds, trees=trees, names=models,
                                        cross_validate=cross_validate)
    results = _store(results, p("model_comparison"))
    best_name, best = tr.best_model(results, fitted)
    # 5 evaluate (C2, E1-E12): F1 threshold on val; business threshold and report on test
    val = score_model(best, splits.where(F.col("split") == "val"))
    test = _store(score_model(best, splits.where(F.col("split") == "test")), p("test_scores"))
    f1_t = ev.best_f1_threshold(val).first()["threshold"]
    biz_src = test if select_on == "test" else val
    biz = ev.best_business_threshold(biz_src).first()["threshold"]
    doc = ev.metrics_record(test, f1_t, model_name=best_name)
    files.write_json_doc(doc, p("metrics"))
    files.write_json_doc(spark.createDataFrame([(float(f1_t), float(biz))], files.THRESHOLDS_SCHEMA), p("thresholds"))
    files.write_parquet(ev.threshold_sweep(test), p("threshold_curve"))
    # 6 scored table (C3, F15-F19) + exports
    scored = _store(labelled(scored_table(test, biz)), p("scored"))
    files.write_csv(scored, p("scored_csv"))
    # 7 explanations (X1 for the linear model, X2 otherwise; X5, S8)
    train = splits.where(F.col("split") == "train")
    if tr.is_linear(best):
        w = tr.linear_weights(best)
        means = xp.feature_means(train)
        long_phi = xp.long_attributions(xp.linear_shapley(scored, w, means=means))
        explainer = files.explainer_table(spark, w, means, best_name)
    else:
        explainer = _store(xp.background_sample(train, best_name, size=shapley_background), p("background"))
        long_phi = xp.sampled_shapley(best, scored, background=explainer, permutations=shapley_permutations)
    explainer = _store(explainer, p("explainer"))
    # 8 the model with all that serving it takes
    version = publish(best, best_name, p("model"), explainer, f1_t, biz, (q["q_balance"], q["q_salary"]))
    long_phi = _store(long_phi, p("attributions"))
    importance = (long_phi.groupBy("feature", "feature_index").agg(F.bround(F.avg(F.abs("phi")), 6)
                                                                   .alias("mean_abs_shap"))
                  .orderBy(F.col("mean_abs_shap").desc(), "feature_index").limit(15))
    files.write_csv(importance.select("feature", "mean_abs_shap"), p("feature_importance"))
    return {"model": best_name, "version": version, "f1_threshold": f1_t, "business_threshold": biz, "out": out_dir,
            "gates": gates.asDict()}


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--rounds", type=int, default=400)
    ap.add_argument("--trees", type=int, default=300)
    ap.add_argument("--models", nargs="*")
    ap.add_argument("--no-cv", action="store_true")
    ap.add_argument("--master")
    a = ap.parse_args()
    spark = build_session(a.master)
    print(json.dumps(run_pipeline(spark, a.sf_dir, a.out, a.rounds, a.trees, a.models, not a.no_cv), default=str))


if __name__ == "__main__":
    main()
