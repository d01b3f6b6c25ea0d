"""X1-X7 invariants, model persistence (S7), sampled Shapley path sums (X2),
stream = batch (Z1), file sources/sinks (S1-S9)."""

import os
import tempfile
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from retainspark.functions.scorecard import scorecard_logit
from retainspark.operators import explain as xp
from retainspark.operators import split as sp
from retainspark.operators import train as tr
from retainspark.operators.scoring import score_model
from retainspark.plans import base
from retainspark.schema import FEATURES, RAW_SCHEMA, RISK_LABELS


@pytest.fixture(scope="module")
def feat(spark, sf_small):
    return base.feat(spark, sf_small).cache()


def test_linear_shapley_sums_to_logit_gap(feat):
    att = xp.scorecard_shapley(feat).withColumn("logit", scorecard_logit())
    mean_logit = att.agg(F.avg("logit")).first()[0]
    total = sum(F.col(xp.phi_col(f)) for f in FEATURES)
    gaps = att.select((total - (F.col("logit") - F.lit(mean_logit))).alias("g")).collect()
    assert max(abs(r["g"]) for r in gaps) < 1e-5


def test_top_factors_order_and_text(spark, feat):
    att = xp.scorecard_shapley(feat)
    top = xp.top_k(att, 3).collect()
    by_id = {}
    for r in top:
        by_id.setdefault(r["CustomerId"], []).append(r)
    for rows in by_id.values():
        mags = [abs(r["phi"]) for r in sorted(rows, key=lambda r: r["rank"])]
        assert mags == sorted(mags, reverse=True) and len(rows) == 3
    assert all("risk, magnitude=" in r["factor"] for r in top)
    imp = xp.global_importance(att).collect()
    assert len(imp) == 15 and imp[0]["mean_abs_shap"] >= imp[-1]["mean_abs_shap"]


def test_fallback_factors(spark, feat):
    out = xp.with_fallback(feat.select("CustomerId"), None).first()
    assert out["top_risk_factors"] == ["SHAP not available"]


@pytest.fixture(scope="module")
def splits(feat):
    return sp.stratified_split(feat).cache()


def test_model_save_load_same_scores(spark, splits):
    train = sp.with_weights(splits.where(F.col("split") == "train"))
    model = tr.estimators(train.count())["LogisticRegression"].fit(train)
    path = tempfile.mkdtemp(prefix="model-", dir="/tmp")
    tr.save_model(model, "LogisticRegression", path)
    name, loaded = tr.load_model(spark, path)
    a = score_model(model, splits).select("CustomerId", "churn_probability")
    b = score_model(loaded, splits).select("CustomerId", F.col("churn_probability").alias("p2"))
    worst = a.join(b, "CustomerId").agg(F.max(F.abs(F.col("churn_probability") - F.col("p2")))).first()[0]
    assert name == "LogisticRegression" and worst < 1e-12
    w = tr.linear_weights(model)
    assert set(w) == set(FEATURES)


def test_folds_stratified(splits):
    f = tr.with_folds(sp.with_weights(splits.where(F.col("split") == "train")))
    per = f.groupBy("fold").agg(F.count("*").alias("n"), F.sum("Exited").alias("pos")).collect()
    assert len(per) == 5
    assert max(r["pos"] for r in per) - min(r["pos"] for r in per) <= 1
    assert max(r["n"] for r in per) - min(r["n"] for r in per) <= 2


def test_compare_models_small(splits):
    res, models = tr.compare_models(splits, rounds=3, trees=5, names=["LogisticRegression", "RandomForest"],
                                    cross_validate=False)
    rows = res.collect()
    assert [r["Model"] for r in rows] == sorted([r["Model"] for r in rows],
                                                key=lambda m: -[x for x in rows if x["Model"] == m][0]["Val AUC"])
    name, _ = tr.best_model(res, models)
    assert name == rows[0]["Model"]


def test_sampled_shapley_path_sums(spark, splits):
    train = sp.with_weights(splits.where(F.col("split") == "train"))
    model = tr.estimators(1, trees=5)["RandomForest"].fit(train)
    rows = splits.limit(20)
    phi = xp.sampled_shapley(model, rows, background=train, permutations=3, background_size=8, digits=None)
    sums = {r[0]: r[1] for r in phi.groupBy("CustomerId").agg(F.sum("phi")).collect()}
    # the steps of a path add up to f(x) - f(b): with K paths, phi to f(x) - mean_k f(b_k)
    f = {r["CustomerId"]: r["churn_probability"] for r in score_model(model, rows).collect()}
    paths = xp.sampled_paths(rows, train, FEATURES, 3, 8, 42, "CustomerId")
    ends = paths.select("CustomerId", *[F.get("bvec", F.lit(i)).alias(c) for i, c in enumerate(FEATURES)])
    start = {r[0]: r[1] for r in score_model(model, ends).groupBy("CustomerId").agg(F.avg("churn_probability")).collect()}
    assert len(sums) == 20
    assert all(sums[i] == pytest.approx(f[i] - start[i], abs=1e-9) for i in f)
    assert {r[1] for r in phi.groupBy("CustomerId").count().collect()} == {len(FEATURES)}


def test_sampled_shapley_with_few_background_rows(spark, splits):
    model = tr.estimators(1, trees=3)["RandomForest"].fit(sp.with_weights(splits))
    rows = splits.limit(20)
    phi = xp.sampled_shapley(model, rows, background=rows.limit(4), permutations=2, background_size=32)
    assert phi.count() == 20 * len(FEATURES)
    with pytest.raises(ValueError):
        xp.sampled_shapley(model, rows, background=rows.limit(0))


def test_serving_explains_the_model_it_uses(spark, splits, sf_small):
    from retainspark.operators.serve import score_requests
    from retainspark.sources import files
    from retainspark.sources.requests import requests_from_base
    train = sp.with_weights(splits.where(F.col("split") == "train"))
    req = requests_from_base(base.cust(spark, sf_small)).limit(30)
    model = tr.estimators(1000)["LogisticRegression"].fit(train)
    path = os.path.join(tempfile.mkdtemp(prefix="exp-", dir="/tmp"), "explainer")
    files.write_parquet(files.explainer_table(spark, tr.linear_weights(model), xp.feature_means(train), "lr"), path)
    say = lambda **kw: {r["CustomerId"]: r["top_risk_factors"] for r in score_requests(req, 0.5, quantiles=(1.0, 1.0), **kw)[0].collect()}
    own = say(model=model, background=train)
    assert own == say(model=model, explainer=spark.read.parquet(path)) != say(background=train)
    assert set(map(tuple, say(model=model).values())) == {tuple(xp.FALLBACK_FACTORS)}
    flat = files.explainer_table(spark, {"Age": 1.0}, dict.fromkeys(FEATURES, 0.0), "age")
    assert {f[0].split(" (")[0] for f in say(model=model, explainer=flat).values()} == {RISK_LABELS.get("Age", "Age")}
    forest = tr.estimators(1, trees=3)["RandomForest"].fit(train)
    assert all(len(f) == 3 for f in say(model=forest, background=train).values())


def test_malformed_records_are_kept(spark):
    from retainspark.operators.quality import split_valid
    from retainspark.sources import files
    from retainspark.sources.requests import read_requests_json
    root = tempfile.mkdtemp(prefix="bad-", dir="/tmp")
    with open(os.path.join(root, "r.json"), "w") as out:
        out.write('{"CustomerId": 1, "Age": }\n{"CustomerId": 2}\n')
    good, bad = split_valid(read_requests_json(spark, root).cache())
    rows = {r[files.CORRUPT]: r["violations"] for r in bad.collect()}
    assert good.count() == 0 and rows['{"CustomerId": 1, "Age": }'] == ["malformed_record"] and len(rows[None]) > 5


def test_stream_equals_batch(spark, sf_small):
    from retainspark.operators import evaluate as ev
    from retainspark.operators.serve import score_requests
    from retainspark.session import ensure_checkpoint_dir
    from retainspark.sources.requests import requests_from_base
    from retainspark.streaming.scoring import score_stream
    root = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    req = requests_from_base(base.cust(spark, sf_small))
    req.repartition(3).write.json(os.path.join(root, "in"))
    ensure_checkpoint_dir(spark)
    biz = ev.best_business_threshold(base.prob(spark, sf_small)).select("threshold")
    q = score_stream(spark, os.path.join(root, "in"), os.path.join(root, "out"), os.path.join(root, "chk"),
                     biz, background=base.feat(spark, sf_small), max_files_per_trigger=1)
    q.awaitTermination()
    streamed = spark.read.parquet(os.path.join(root, "out", "responses")).drop("batch_id")
    batch, bad = score_requests(req, biz, background=base.feat(spark, sf_small))
    cols = [c for c in batch.columns if c != "top_risk_factors"]
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert streamed.count() == batch.count()
    qbad = spark.read.parquet(os.path.join(root, "out", "quarantine"))
    assert qbad.count() == bad.count() > 0


def test_csv_json_roundtrip_and_optional(spark, sf_small):
    from retainspark.sources import files
    cust = base.cust(spark, sf_small)
    root = tempfile.mkdtemp(prefix="io-", dir="/tmp")
    files.write_csv(cust, os.path.join(root, "raw"))
    back = files.read_csv(spark, os.path.join(root, "raw"), RAW_SCHEMA)
    assert back.exceptAll(cust).count() == 0 and back.count() == cust.count()
    doc = spark.createDataFrame([(0.62, 0.2)], files.THRESHOLDS_SCHEMA)
    files.write_json_doc(doc, os.path.join(root, "thr"))
    t = files.thresholds_or_default(spark, os.path.join(root, "thr")).first()
    assert (t["f1_optimal"], t["business_optimal"]) == (0.62, 0.2)
    d = files.thresholds_or_default(spark, os.path.join(root, "missing")).first()
    assert (d["f1_optimal"], d["business_optimal"]) == (0.5, 0.5)
    empty = files.optional_table(spark, os.path.join(root, "nope"), RAW_SCHEMA)
    assert empty.count() == 0 and empty.schema == RAW_SCHEMA


def test_export_csv(spark, sf_small):
    from retainspark.operators import reports as rp
    plan = base.Plan(spark, sf_small)
    path = os.path.join(tempfile.mkdtemp(prefix="exp-", dir="/tmp"), "export")
    rows = rp.export_csv(plan.scored, path, geo="Germany", active="Inactive")
    back = spark.read.option("header", True).csv(path)
    assert back.count() == rows.count() > 0
    assert set(back.columns) == set(rows.columns)
    assert {r["Geography_Label"] for r in back.select("Geography_Label").collect()} == {"Germany"}


def test_stream_restart_exactly_once(spark, sf_small):
    """A second run on the same checkpoint picks up only new files; every
    request is answered once."""
    from retainspark.session import ensure_checkpoint_dir
    from retainspark.sources.requests import requests_from_base
    from retainspark.streaming.scoring import score_stream
    ensure_checkpoint_dir(spark)
    plan = base.Plan(spark, sf_small)
    root = tempfile.mkdtemp(prefix="restart-", dir="/tmp")
    inbox, out, chk = (os.path.join(root, x) for x in ("in", "out", "chk"))
    req = requests_from_base(plan.cust)
    first, second = req.where(F.col("CustomerId") % 2 == 0), req.where(F.col("CustomerId") % 2 == 1)
    first.write.json(os.path.join(inbox, "a"))
    score_stream(spark, os.path.join(inbox, "*"), out, chk, plan.biz, background=plan.feat).awaitTermination()
    n1 = spark.read.parquet(os.path.join(out, "responses")).count()
    second.write.json(os.path.join(inbox, "b"))
    score_stream(spark, os.path.join(inbox, "*"), out, chk, plan.biz, background=plan.feat).awaitTermination()
    resp = spark.read.parquet(os.path.join(out, "responses"))
    bad = spark.read.parquet(os.path.join(out, "quarantine"))
    assert 0 < n1 < resp.count()
    assert resp.count() + bad.count() == req.count()
    assert resp.select("CustomerId").distinct().count() == resp.count()


def test_leaderboard_fits_the_full_models(spark, sf_small, monkeypatch):
    import inspect

    from retainspark.plans import catalog_models as cm
    full, got = inspect.signature(tr.compare_models), []

    def compare(*args, **kwargs):
        call = full.bind(*args, **kwargs)
        call.apply_defaults()
        got.append((call.arguments["rounds"], call.arguments["trees"], call.arguments["names"], call.arguments["cross_validate"]))
        return None, {}
    monkeypatch.setattr(cm.tr, "compare_models", compare)
    cm.q_leaderboard(spark, sf_small)
    assert got == [(400, 300, None, True)]


def test_a_stopped_comparison_goes_on(spark, splits, monkeypatch):
    """Finished fits are rows; only the others are made again, and the results are the same."""
    kw = dict(rounds=2, trees=3, names=["LogisticRegression", "RandomForest"], parallelism=2)
    store = tempfile.mkdtemp(prefix="fits-", dir="/tmp")
    want = [tuple(r) for r in tr.compare_models(splits, **kw, store=os.path.join(store, "a"))[0].collect()]
    made, add = [], tr.TrainingTable.add

    def stopping(self, row, model=None):
        if len(made) == 5:
            raise RuntimeError("stopped")
        made.append(row[:2])
        add(self, row, model)
    monkeypatch.setattr(tr.TrainingTable, "add", stopping)
    with pytest.raises(RuntimeError, match="stopped"):
        tr.compare_models(splits, **kw, store=os.path.join(store, "b"))
    first = tr.TrainingTable(spark, os.path.join(store, "b")).done()
    assert len(first) == 5
    made.clear()
    monkeypatch.setattr(tr.TrainingTable, "add", lambda self, row, model=None: (made.append(row[:2]), add(self, row, model)))
    res, models = tr.compare_models(splits, **kw, store=os.path.join(store, "b"))
    assert len(made) == 7 and not first & set(made) and set(models) == set(kw["names"])
    assert [tuple(r) for r in res.collect()] == want
    made.clear()
    tr.compare_models(splits, **kw, store=os.path.join(store, "b"))
    assert made == []


def test_mean_of_folds_does_not_depend_on_the_order_of_rows(spark):
    """As read from a training table: a row a file, in whatever order."""
    aucs = [0.73, 0.68, 0.69, 0.6, 0.54, None]
    orders = [[0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [3, 1, 4, 0, 2], [2, 0, 1, 4, 3]]
    added = [reduce(add, (aucs[k] for k in o)) for o in orders]  # sum() would make up for lost digits
    assert len(set(added)) > 1
    rows = [spark.createDataFrame([("m", k, aucs[k]) for k in [*o, 5]], "model string, fold int, auc double").coalesce(1) for o in orders]
    assert {tr.mean_auc(r).first()["cv"] for r in rows} == {added[0] / 5}


def test_training_key_follows_data_and_sizes(splits):
    key = tr.training_key(splits, 1, 2)
    assert key == tr.training_key(splits.repartition(5), 1, 2) != tr.training_key(splits, 1, 3)
    assert key != tr.training_key(splits.where(F.col("CustomerId") % 7 > 0), 1, 2)


def test_certificate_tells_an_optimum(splits):
    train = sp.with_weights(splits.where(F.col("split") == "train")).cache()
    pipe = tr.estimators(train.count())["LogisticRegression"]
    rows = tr.fit_certificate(pipe.fit(train), train).collect()
    assert len(rows) == len(FEATURES) + 1 and all(r.optimal for r in rows) and any(abs(r.gradient_at_start) > 0.01 for r in rows)
    pipe.getStages()[-1].setMaxIter(1)
    assert not all(r.optimal for r in tr.fit_certificate(pipe.fit(train), train).collect())
