"""F1-F19, C1, C4 on the hand-checkable sample request and boundary rows."""

import pytest
from pyspark.sql import functions as F

from retainspark.functions import features as fx
from retainspark.operators.features import coded, feature_table, serving_features
from retainspark.operators.scoring import score_scorecard, scored_table
from retainspark.operators.serve import score_requests
from retainspark.schema import CLV_TRAINING, FEATURES, REQUEST_SCHEMA

SAMPLE = (1, 600, "Germany", "Female", 42, 2, 125000.0, 1, 1, 0, 70000.0)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([SAMPLE], REQUEST_SCHEMA)


def test_sample_training_features(spark, sample):
    raw = sample.withColumn("Exited", F.lit(1))
    q = spark.createDataFrame([(1e9, 1e9)], "q_balance double, q_salary double")
    r = feature_table(raw, quantiles=q).first()
    assert (r["Geography"], r["Gender"]) == (1, 0)
    assert r["balance_salary_ratio"] == pytest.approx(1.785689, abs=1e-6)
    assert r["products_per_year"] == pytest.approx(0.333333, abs=1e-6)
    assert r["age_tenure_ratio"] == 14.0
    assert (r["age_group"], r["credit_score_band"], r["tenure_stability"]) == (1, 1, 0)
    assert r["engagement_score"] == 0.275
    assert (r["is_zero_balance"], r["inactive_high_balance"], r["high_value_customer"]) == (0, 1, 0)
    assert r["clv_estimated"] == 2924.61
    p = score_scorecard(feature_table(raw, quantiles=q)).first()["churn_probability"]
    assert p == 0.645656
    s = scored_table(score_scorecard(feature_table(raw, quantiles=q)), 0.5).first()
    assert s["risk_level"] == "HIGH" and s["retention_value"] == 566.49 and s["action_code"] == 1
    assert s["churn_prediction"] == 1


def test_sample_serving_response(spark, sample):
    bg = serving_features(sample)
    resp, bad = score_requests(sample, 0.2, background=bg)
    r = resp.first()
    assert bad.count() == 0
    assert serving_features(sample).first()["clv_estimated"] == 5462.77
    assert r["churn_probability"] == 0.6457 and r["risk_level"] == "HIGH"
    assert r["retention_value_eur"] == 1058.12 and r["churn_prediction"] == 1
    assert r["recommended_action"].startswith("Priority call")
    assert r["model_version"] == "scorecard-2.0.0" and r["business_optimal"] is True
    assert len(r["top_risk_factors"]) == 3


@pytest.mark.parametrize("age,group", [(18, 0), (30, 0), (31, 1), (45, 1), (46, 2), (60, 2), (61, 3), (95, 3)])
def test_age_bins_right_closed(spark, age, group):
    df = spark.createDataFrame([(age,)], "Age int")
    assert df.select(fx.age_group()).first()[0] == group


@pytest.mark.parametrize("cs,band", [(300, 0), (579, 0), (580, 1), (669, 1), (670, 2), (739, 2), (740, 3),
                                      (799, 3), (800, 4), (850, 4)])
def test_credit_bands(spark, cs, band):
    assert spark.createDataFrame([(cs,)], "CreditScore int").select(fx.credit_score_band()).first()[0] == band


@pytest.mark.parametrize("t,band", [(0, 0), (2, 0), (3, 1), (5, 1), (6, 2), (10, 2)])
def test_tenure_bands(spark, t, band):
    assert spark.createDataFrame([(t,)], "Tenure int").select(fx.tenure_stability()).first()[0] == band


@pytest.mark.parametrize("p,level", [(0.349999, "LOW"), (0.35, "MEDIUM"), (0.599999, "MEDIUM"), (0.6, "HIGH")])
def test_risk_levels(spark, p, level):
    assert spark.createDataFrame([(p,)], "churn_probability double").select(fx.risk_level()).first()[0] == level


def test_unknown_category_is_null(spark):
    df = spark.createDataFrame([("Italy", "X")], "Geography string, Gender string")
    r = df.select(fx.geography_code(), fx.gender_code()).first()
    assert r[0] is None and r[1] is None


def test_actions_first_match(spark):
    rows = [(1, 0, 0.9, 30, 1), (0, 1, 0.9, 30, 1), (0, 0, 0.2, 30, 1), (0, 0, 0.9, 56, 1),
            (0, 0, 0.9, 55, 3), (0, 0, 0.9, 55, 2), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "inactive_high_balance int, is_zero_balance int, engagement_score double, "
                                     "Age int, NumOfProducts int")
    assert [r[0] for r in df.select(fx.action_code()).collect()] == [1, 2, 3, 4, 5, 6, 6]


def test_clv_clip_and_balance_edges(spark):
    df = spark.createDataFrame([(300, 0, 0.0, 1, 10000.0), (850, 10, 250000.0, 4, 199999.0)],
                               "CreditScore int, Tenure int, Balance double, NumOfProducts int, EstimatedSalary double")
    lo, hi = [r[0] for r in df.select(fx.clv(CLV_TRAINING)).collect()]
    assert lo == 360.0 and hi == 5000.0


def test_feature_order(spark, sf_small):
    from retainspark.plans import base
    f = base.feat(spark, sf_small)
    assert f.columns == ["RowNumber", "CustomerId"] + FEATURES + ["Exited"]
    assert coded(base.cust(spark, sf_small)).where(F.col("Geography").isNull()).count() == 0


def test_labels_pass_strings_through(spark):
    from retainspark.operators.scoring import labelled
    df = spark.createDataFrame([("Spain", "Male", 1, 0, 2)],
                               "Geography string, Gender string, age_group int, tenure_stability int, "
                               "credit_score_band int")
    r = labelled(df).first()
    assert (r["Geography_Label"], r["Gender_Label"], r["Age_Group_Label"]) == ("Spain", "Male", "Prime (31-45)")


def test_serving_uses_stored_quantiles(spark, sample):
    rich = spark.createDataFrame([(2, 700, "France", "Male", 50, 5, 240000.0, 2, 1, 1, 190000.0)], REQUEST_SCHEMA)
    both = sample.unionByName(rich)
    hv_stored = serving_features(both, quantiles=(100000.0, 100000.0), legacy=False)
    assert [r["high_value_customer"] for r in hv_stored.orderBy("CustomerId").collect()] == [0, 1]
    assert {r["high_value_customer"] for r in serving_features(both).collect()} == {0}
    resp, _ = score_requests(both, 0.2, quantiles=(100000.0, 100000.0))
    assert resp.count() == 2
