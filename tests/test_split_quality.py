"""M1/M2 split properties and golden sizes; V1-V7 gates and contract."""

import random

import pytest
from pyspark.sql import functions as F

from retainspark.operators import quality as qa
from retainspark.operators import split as sp
from retainspark.schema import REQUEST_SCHEMA


def _labelled(spark, n, npos):
    return spark.range(n).select((F.col("id") + 10_000_000).alias("CustomerId"),
                                 (F.col("id") < npos).cast("int").alias("Exited"))


def test_split_golden_sizes(spark):
    s = sp.stratified_split(_labelled(spark, 10_000, 2_160))
    got = {(r["split"], r["Exited"]): r["n"] for r in s.groupBy("split", "Exited").agg(F.count("*").alias("n")).collect()}
    assert got[("test", 1)] == 432 and got[("test", 1)] + got[("test", 0)] == 2000
    assert got[("val", 1)] == 216 and got[("val", 1)] + got[("val", 0)] == 1000
    assert got[("train", 1)] + got[("train", 0)] == 7000


def test_split_disjoint_exhaustive_stable(spark):
    df = _labelled(spark, 5_003, 977)
    a = sp.stratified_split(df).select("CustomerId", "split")
    b = sp.stratified_split(df.repartition(5)).select("CustomerId", "split")
    assert a.count() == 5_003 and a.select("CustomerId").distinct().count() == 5_003
    assert a.exceptAll(b).count() == 0
    c = sp.stratified_split(df, seed=7).select("CustomerId", "split")
    assert a.exceptAll(c).count() > 0


def test_class_weights(spark):
    w = {r["label"]: r["weight"] for r in sp.class_weights(_labelled(spark, 1000, 200)).collect()}
    assert w == {1: 2.5, 0: 0.625}


def test_gates(spark, sf_small):
    from retainspark.plans import base
    g = qa.quality_gates(base.cust(spark, sf_small), expected_rows=150).first()
    assert g["rows"] == 150 and g["rows_ok"] and g["nulls_ok"] and g["null_cells"] == 0
    bad = qa.quality_gates(base.cust(spark, sf_small), expected_rows=10_000).first()
    assert not bad["rows_ok"]


def _req(spark, **over):
    base = dict(CustomerId=1, CreditScore=600, Geography="France", Gender="Male", Age=40, Tenure=5,
                Balance=0.0, NumOfProducts=1, HasCrCard=1, IsActiveMember=1, EstimatedSalary=1000.0)
    base.update(over)
    return spark.createDataFrame([tuple(base[f.name] for f in REQUEST_SCHEMA.fields)], REQUEST_SCHEMA)


@pytest.mark.parametrize("field,value,rule", [
    ("CreditScore", 299, "CreditScore_range"), ("CreditScore", 851, "CreditScore_range"),
    ("Age", 17, "Age_range"), ("Age", 96, "Age_range"), ("Tenure", -1, "Tenure_range"),
    ("Tenure", 11, "Tenure_range"), ("Balance", -0.01, "Balance_range"), ("NumOfProducts", 0, "NumOfProducts_range"),
    ("NumOfProducts", 5, "NumOfProducts_range"), ("HasCrCard", 2, "HasCrCard_range"),
    ("IsActiveMember", -1, "IsActiveMember_range"), ("EstimatedSalary", 0.0, "EstimatedSalary_range"),
    ("Geography", "Italy", "Geography_value"), ("Gender", "X", "Gender_value"), ("Age", None, "Age_range"),
    ("Geography", None, "Geography_value")])
def test_contract_rules(spark, field, value, rule):
    v = qa.validate(_req(spark, **{field: value})).first()["violations"]
    assert v == [rule]


def test_contract_bounds_inclusive(spark):
    ok = _req(spark, CreditScore=300, Age=95, Tenure=0, NumOfProducts=4, Balance=0.0, EstimatedSalary=0.01)
    valid, bad = qa.split_valid(ok)
    assert valid.count() == 1 and bad.count() == 0


def test_whatif_defaults(spark):
    r = qa.whatif_defaults(_req(spark, CreditScore=0, Tenure=0, Geography="", IsActiveMember=0,
                                HasCrCard=0, EstimatedSalary=None), zero_is_missing=True).first()
    assert (r["CreditScore"], r["Tenure"], r["Geography"], r["IsActiveMember"], r["HasCrCard"]) == (650, 5, "France", 0, 1)
    assert r["EstimatedSalary"] == 50000.0
    strict = qa.whatif_defaults(_req(spark, Tenure=0, Age=None)).first()
    assert strict["Tenure"] == 0 and strict["Age"] == 40


def test_profile_matches_pandas(spark, sf_small):
    from retainspark.plans import base
    cust = base.cust(spark, sf_small)
    pdf = cust.toPandas()
    prof = {r["column"]: r for r in qa.profile(cust).collect()}
    d = pdf.describe()
    for c in ["Balance", "Age", "EstimatedSalary"]:
        assert prof[c]["p25"] == pytest.approx(d[c]["25%"], abs=1e-4)
        assert prof[c]["p75"] == pytest.approx(d[c]["75%"], abs=1e-4)
        assert prof[c]["std"] == pytest.approx(d[c]["std"], abs=1e-4)


def _percentile(df, c, q):
    return df.agg(F.percentile(F.col(c), F.lit(q))).first()[0]


def test_quantiles_equal_percentile_bit_for_bit(spark):
    from retainspark.operators.quantile import quantiles
    rng = random.Random(5)
    rows = [(round(rng.uniform(0, 250_000), 2), rng.choice([0.0, 0.0, 1.5, 7.25]), 10.0 ** rng.randint(-275, 275), None if i % 3 else -float(i)) for i in range(4001)]
    df = spark.createDataFrame(rows, "money double, ties double, spread double, gaps double").repartition(5)
    cols, qs = df.columns, [0.0, 0.25, 0.5, 0.75, 0.901, 1.0]
    found = quantiles(df, cols, qs)
    assert found == {(c, q): _percentile(df, c, q) for c in cols for q in qs}


@pytest.mark.parametrize("accuracy", [2, 7, 100])
def test_quantiles_settle_with_any_sketch(spark, monkeypatch, accuracy):
    from retainspark.operators import quantile
    monkeypatch.setattr(quantile, "ACCURACY", accuracy)
    df = spark.createDataFrame([(10.0 ** i,) for i in range(-60, 61)] + [(1.0,)] * 30, "x double")
    assert quantile.quantiles(df, ["x"], [0.25, 0.5]) == {("x", q): _percentile(df, "x", q) for q in (0.25, 0.5)}


def test_quantiles_of_nothing(spark):
    from retainspark.operators.quantile import quantiles
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "x double, y double")
    found = quantiles(df, ["x", "y"], [0.5, 0.0])
    assert found["x", 0.5] is None and found["y", 0.0] == 1.0
    assert quantiles(df.limit(0), ["y"], [0.5]) == {("y", 0.5): None}



def test_null_labels_are_refused(spark):
    df = _labelled(spark, 100, 20).withColumn("Exited", F.when(F.col("CustomerId") % 10 != 0, F.col("Exited")))
    for run in (sp.stratified_split, sp.with_weights):
        with pytest.raises(ValueError, match="10 rows"):
            run(df)


def test_split_equals_a_ranking_of_all_rows(spark):
    for n, npos in ((1000, 203), (37, 5), (3, 1), (50, 0), (50, 50)):
        df = _labelled(spark, n, npos)
        got = {r[0]: r[2] for r in sp.stratified_split(df).collect()}
        q = sp.quotas(n, npos)
        import hashlib
        for y in (0, 1):
            ids = [10_000_000 + i for i in range(n) if (i < npos) == bool(y)]
            ids.sort(key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))
            k, v = q[y, "test"], q[y, "test"] + q[y, "val"]
            assert [got[i] for i in ids] == ["test"] * k + ["val"] * (v - k) + ["train"] * (len(ids) - v)


def test_quotas_at_any_size():
    big = sp.quotas(10 ** 12, 18 * 10 ** 10)
    assert big[1, "test"] == 36 * 10 ** 9 and sum(big.values()) == 3 * 10 ** 11


def test_split_needs_no_shuffle_of_rows(spark):
    plan = sp.stratified_split(_labelled(spark, 1000, 200))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
