"""Published models (S7-S9), explainers without the training table, gates on the write (V1-V3)."""

import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from retainspark.operators import explain as xp
from retainspark.operators import quality as qa
from retainspark.operators import split as sp
from retainspark.operators import train as tr
from retainspark.operators.serve import score_published, score_requests
from retainspark.plans import base
from retainspark.schema import FEATURES
from retainspark.sources import files
from retainspark.sources import published as pb
from retainspark.sources.requests import requests_from_base


@pytest.fixture(scope="module")
def train(spark, sf_small):
    s = sp.stratified_split(base.feat(spark, sf_small))
    return sp.with_weights(s.where(F.col("split") == "train")).cache()


@pytest.fixture(scope="module")
def fitted(train):
    e = tr.estimators(train.count(), trees=3)
    return {n: e[n].fit(train) for n in ("LogisticRegression", "RandomForest")}


def fresh():
    return os.path.join(tempfile.mkdtemp(prefix="pub-", dir="/tmp"), "models")


def test_nothing_published_falls_back(spark, sf_small):
    got = pb.load_published(spark, fresh())
    assert (got.model, got.explainer, got.name, got.business_threshold, got.quantiles) == (None, None, "scorecard", 0.5, None)
    resp, _ = score_published(requests_from_base(base.cust(spark, sf_small)).limit(20), got)
    rows = resp.collect()
    assert rows and {tuple(r.top_risk_factors) for r in rows} == {tuple(xp.FALLBACK_FACTORS)} and {r.threshold_used for r in rows} == {0.5}
    with pytest.raises(FileNotFoundError):
        tr.load_model(spark, fresh())


def test_newest_record_counts(spark, train, fitted):
    path = fresh()
    first = pb.publish(fitted["LogisticRegression"], "lr", path, None, 0.4, 0.2)
    second = pb.publish(fitted["RandomForest"], "rf", path, xp.background_sample(train, "rf", size=16), 0.5, 0.3, (1.0, 2.0))
    got = pb.load_published(spark, path)
    assert (got.version, got.name, got.f1_threshold, got.business_threshold, got.quantiles) == (second, "rf", 0.5, 0.3, (1.0, 2.0))
    assert got.explainer.count() == 16 and not tr.is_linear(got.model)
    old = pb.load_published(spark, path, first)
    assert old.name == "lr" and old.explainer is None and tr.is_linear(old.model)
    assert [r.version for r in pb.records(spark, path).collect()] == [second, first]


def test_a_killed_save_is_never_seen(spark, fitted, monkeypatch):
    path = fresh()
    pb.publish(fitted["LogisticRegression"], "lr", path)
    kept = pb.load_published(spark, path).version

    class Killed(Exception):
        pass

    class Explainer:
        @property
        def write(self):
            raise Killed
    with pytest.raises(Killed):  # the model is there, the record isn't
        pb.publish(fitted["RandomForest"], "rf", path, Explainer())
    assert len(os.listdir(os.path.join(path, "versions"))) == 2
    assert pb.load_published(spark, path).version == kept


def test_tree_model_explained_without_the_training_table(spark, sf_small, train, fitted):
    path = fresh()
    pb.publish(fitted["RandomForest"], "rf", path, xp.background_sample(train, "rf"), 0.5, 0.3, (1.0, 1.0))
    req = requests_from_base(base.cust(spark, sf_small)).limit(15)
    got = {r.CustomerId: r.top_risk_factors for r in score_published(req, pb.load_published(spark, path))[0].collect()}
    own = score_requests(req, 0.3, background=train, model=fitted["RandomForest"], quantiles=(1.0, 1.0))[0].collect()
    assert got == {r.CustomerId: r.top_risk_factors for r in own} and all(len(x) == 3 for x in got.values())


def test_stream_serves_what_is_published(spark, sf_small, train, fitted):
    from retainspark.streaming.scoring import read_output, score_stream
    path, root = fresh(), tempfile.mkdtemp(prefix="pubstream-", dir="/tmp")
    pb.publish(fitted["RandomForest"], "rf", path, xp.background_sample(train, "rf"), 0.5, 0.3, (1.0, 1.0))
    found = pb.load_published(spark, path)
    req = requests_from_base(base.cust(spark, sf_small)).limit(15)
    req.write.json(os.path.join(root, "in"))
    score_stream(spark, os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "chk"), found.business_threshold, model=found.model,
                 model_name=found.name, explainer=found.explainer, quantiles=found.quantiles).awaitTermination()
    want = {r.CustomerId: (r.churn_probability, r.top_risk_factors) for r in score_published(req, found)[0].collect()}
    assert {r.CustomerId: (r.churn_probability, r.top_risk_factors) for r in read_output(spark, os.path.join(root, "out")).collect()} == want


def test_gates_come_from_the_write(spark, sf_small):
    side = spark.newSession()
    cust = base.cust(side, sf_small)
    gates, path = qa.Gates(cust), os.path.join(tempfile.mkdtemp(prefix="gates-", dir="/tmp"), "raw")
    files.write_parquet(gates.watched, path)
    shutil.rmtree(path)  # nothing is read again for them
    assert gates.result(expected_rows=cust.count()).first() == qa.quality_gates(cust, expected_rows=cust.count()).first()
    holes = cust.withColumn("Age", F.when(F.col("CustomerId") % 2 == 0, F.col("Age")))
    bad = qa.Gates(holes)
    files.write_parquet(bad.watched, path)
    assert not bad.result().first().nulls_ok


def test_models_work_after_gates(spark, sf_small, fitted, train):
    gates = qa.Gates(base.cust(spark.newSession(), sf_small))
    gates.watched.write.format("noop").mode("overwrite").save()
    assert gates.result().first().rows_ok
    assert fitted["RandomForest"].transform(train).count() == train.count()
    assert fitted["LogisticRegression"].transform(train).agg(F.max("prediction")).first()[0] is not None


def test_pipeline_scans_the_base_once_for_the_gates():
    import inspect

    from retainspark.plans import pipeline
    said = inspect.getsource(pipeline.run_pipeline)
    assert "qa.Gates(" in said and "quality_gates(" not in said


def test_standard_errors_shrink_with_permutations(spark, train, fitted):
    model, rows = fitted["RandomForest"], train.limit(12)
    few = xp.sampled_shapley(model, rows, background=train, permutations=4, digits=None)
    many = xp.sampled_shapley(model, rows, background=train, permutations=64, digits=None)
    a, b = few.agg(F.avg("stderr")).first()[0], many.agg(F.avg("stderr")).first()[0]
    assert 0 < b < a / 2.5  # sixteen times the pairs: a quarter
    # the means over few permutations lie within some errors of those over many
    j = few.alias("x").join(many.alias("y"), ["CustomerId", "feature"])
    near = j.where(F.abs(F.col("x.phi") - F.col("y.phi")) <= 6 * F.col("x.stderr") + 4 * F.col("y.stderr") + 1e-9).count()
    assert near >= 0.8 * j.count()
    assert xp.sampled_shapley(model, rows, background=train, permutations=2).where("stderr is not null").count() == 0


def test_pairs_walk_the_same_order_both_ways(spark, train):
    paths = xp.sampled_paths(train.limit(5), train, FEATURES, 4, 8, 42, "CustomerId").collect()
    by = {}
    for r in paths:
        by.setdefault((r.CustomerId, r.pair), []).append(r)
    assert all(len(p) == 2 and p[0].perm == p[1].perm[::-1] and p[0].bvec == p[1].bvec for p in by.values()) and len(by) == 10
