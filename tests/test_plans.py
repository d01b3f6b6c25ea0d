"""Plan-shape regression tests for the scale design (read from explain output)."""

import pytest
from pyspark.sql import functions as F

from retainspark.operators import evaluate as ev
from retainspark.operators import reports as rp
from retainspark.plans import base


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plan(spark, sf_small):
    return base.Plan(spark, sf_small)


def test_orders_read_once_then_stored_table(plan):
    """After the customer base is stored, no later pass rescans orders."""
    for df in (plan.scored, rp.first_call_list(plan.scored), ev.auc_exact(plan.prob), ev.threshold_sweep(plan.prob)):
        files = df.inputFiles()
        assert files and all("/tables/cust-" in f or "/tables/scores-" in f for f in files), files


def test_scalars_are_literals(plan):
    text = _plan(plan.scored)
    assert "BroadcastNestedLoopJoin" not in text   # quantiles and threshold folded in


def test_lookup_filter_pushed_to_scan(plan):
    text = _plan(rp.customer_lookup(plan.scored, 10000007))
    assert "EqualTo(CustomerId,10000007)" in text


def test_topk_is_take_ordered(plan):
    text = _plan(rp.first_call_list(plan.scored))
    assert "TakeOrderedAndProject" in text


def test_cv_auc_runs_on_folds(spark, plan):
    from retainspark.operators import split as sp
    from retainspark.operators import train as tr
    learnable = plan.feat.withColumn("Exited", (F.col("Age") > 50).cast("int"))
    s = sp.stratified_split(learnable)
    train = sp.with_weights(s.where(F.col("split") == "train"))
    folds = tr.with_folds(train).cache()
    auc = tr.cv_auc(tr.estimators(folds.count(), trees=5)["RandomForest"], folds)
    assert 0.95 < auc <= 1.0


def test_hot_customer_is_combined_map_side(spark, sf_small):
    """One customer holding a third of all orders: the per-customer aggregate
    is partial (map-side) + final, and its row is still exact."""
    from retainspark.session import table
    from retainspark.sources.customer_base import customer_base, order_summary
    orders = table(spark, sf_small, "orders")
    n = orders.count()
    hot = orders.limit(n // 2).withColumn("o_custkey", F.lit(7).cast("long"))
    skewed = orders.unionByName(hot)
    summary = order_summary(skewed)
    text = _plan(summary)
    assert text.count("HashAggregate") >= 2 and "partial_" in text
    got = summary.where(F.col("o_custkey") == 7).first()
    pdf = skewed.where(F.col("o_custkey") == 7).toPandas()
    later, pdf = pdf[pdf["o_orderdate"] >= "2000-07-01"], pdf[pdf["o_orderdate"] < "2000-07-01"]
    assert got["after"] == len(later) > 0 and got["n"] == len(pdf)
    assert got["d0"] == pdf["o_orderdate"].min() and got["d1"] == pdf["o_orderdate"].max()
    assert got["cents"] == int((pdf["o_totalprice"] * 100).round().astype("int64").sum())
    cust = customer_base(table(spark, sf_small, "customer"), skewed)
    assert cust.count() == table(spark, sf_small, "customer").count()


def test_split_without_positives(spark):
    from retainspark.operators import split as sp
    df = spark.range(100).select((F.col("id") + 1).alias("CustomerId"), F.lit(0).alias("Exited"))
    got = {r["split"]: r["n"] for r in sp.stratified_split(df).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"test": 20, "val": 10, "train": 70}


def test_sweep_all_tied(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0)] * 10, "churn_probability double, Exited int")
    rows = ev.threshold_sweep(df, clv=None, avg_clv=100.0).orderBy("threshold").collect()
    assert [r["tp"] for r in rows if r["threshold"] < 0.5] == [10] * 30
    at_half = [r for r in rows if r["threshold"] == 0.5][0]
    # the raw grid point is 0.5000000000000002: tp/fp exclude p = 0.5, the F1 column
    # (rounded threshold) includes it
    assert at_half["tp"] == 0 and at_half["f1"] == pytest.approx(0.6667)
    assert all(r["tp"] == 0 and r["fp"] == 0 for r in rows if r["threshold"] > 0.5)


def test_reports_run_no_other_job(spark, sf_small):
    """A report that uses neither the quantile flag nor the threshold starts
    the one job that stores the customer base, and none for those."""
    from retainspark.plans.registry import load_all
    queries = load_all()[0]
    tracker = spark.sparkContext.statusTracker()
    for name in ("label_decode", "customer_lookup", "call_list", "cohort_churn", "export_rows"):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        queries[name](spark, sf_small)
        jobs = tracker.getJobIdsForGroup(f"build-{name}")
        spark.sparkContext.setJobGroup("rest", "rest")
        assert len(jobs) <= 6, (name, len(jobs))


def test_label_is_observed_after_the_cutoff(spark, sf_small):
    from retainspark.plans import base
    from retainspark.session import table
    cust = {r["CustomerId"] - 10_000_000: r["Exited"] for r in base.cust(spark, sf_small).collect()}
    later = {r[0] for r in table(spark, sf_small, "orders").where("o_orderdate >= timestamp'2000-07-01'").select("o_custkey").distinct().collect()}
    assert all(left == int(key not in later) for key, left in cust.items()) and 0 < sum(cust.values()) < len(cust)


def test_released_tables_are_gone(spark, monkeypatch):
    import os
    from retainspark import session
    monkeypatch.setattr(session, "_tables", [])
    kept = session.materialize(spark.range(5), "gone")
    path = session._tables[0].removeprefix("file:")
    assert kept.count() == 5 and os.path.isdir(path)
    session.release()
    assert not os.path.exists(path) and session._tables == []
