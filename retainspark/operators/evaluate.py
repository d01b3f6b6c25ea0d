"""Evaluation: confusion (E1), threshold sweep (E2-E4), exact ranking
metrics (E5-E8), derived rates (E9, E10), metrics record (E11).

Plan shapes:

* E2 is one pass: each row gets the number of grid points at or below its
  score (a JVM-side array filter), rows collapse to at most 63 x 63 groups
  by partial aggregation, and the 62 grid rows are suffix sums over that
  tiny table.  Not 62 scans, not rows x 62.
* E5-E8 never sort the whole table in one task, and read it once: scores are
  collapsed to distinct values (a hot score costs one row) and stored.  Their
  number says how many buckets there are (``SCORES_PER_BUCKET`` each, at any
  size); a range partitioning deals them out in score order, however closely
  a model's scores crowd.  A bucket's offset is the sum of the groups of
  ``BUCKETS_PER_GROUP`` buckets above its own and of the buckets above it in
  its group, so no window holds more than a bucket's or a group's rows, and
  the one over the groups grows with scores / 2e8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OUTREACH_COST, RETENTION_SUCCESS_RATE, THRESHOLD_GRID, THRESHOLD_GRID_RAW
from ..session import materialize

SCORES_PER_BUCKET = 200_000
BUCKETS_PER_GROUP = 1_000


def _lit_array(values: list[float]) -> Column:
    """array<double> literal built as one SQL expression (one JVM call, not one per value);
    ``repr`` round-trips every double exactly."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def _grid_index(p: Column, grid: list[float]) -> Column:
    """Number of grid points t with t <= p (prediction positive for j < idx)."""
    return F.size(F.filter(_lit_array(grid), lambda t: t <= p)).cast("int")


def _divide0(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


# E1, E9, E10 ---------------------------------------------------------------
def confusion(df: DataFrame, threshold: float = 0.5, p: str = "churn_probability",
              label: str = "Exited") -> DataFrame:
    pred = F.col(p) >= F.lit(float(threshold))
    y = F.col(label) == 1
    return df.agg(F.count_if(pred & y).cast("long").alias("tp"),
                  F.count_if(pred & ~y).cast("long").alias("fp"),
                  F.count_if(~pred & ~y).cast("long").alias("tn"),
                  F.count_if(~pred & y).cast("long").alias("fn"))


def classification_metrics(df: DataFrame, threshold: float = 0.5, p: str = "churn_probability",
                           label: str = "Exited") -> DataFrame:
    """E9/E10 from E1; 0 on zero division; rounded to 4 digits."""
    c = confusion(df, threshold, p, label)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(
        "tp", "fp", "tn", "fn",
        F.bround(_divide0(tp, tp + fp), 4).alias("precision"),
        F.bround(_divide0(tp, tp + fn), 4).alias("recall"),
        F.bround(_divide0(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
        F.bround(_divide0(tp + tn, tp + fp + tn + fn), 4).alias("accuracy"),
        F.bround(_divide0(tp, tp + fn), 4).alias("catch_rate"),
        F.bround(_divide0(fp, fp + tn), 4).alias("false_alarm_rate"),
    )


# E2 ------------------------------------------------------------------------
def sweep_counts(df: DataFrame, p: str = "churn_probability", label: str = "Exited",
                 clv: str | None = "clv_estimated") -> DataFrame:
    """The one pass over the data: counts per (raw grid index, rounded grid index)."""
    pc = F.col(p)
    cents = (F.sum(F.round(F.col(clv) * 100, 0).cast("long")) if clv
             else F.lit(0).cast("long"))
    return (df.select(pc.alias("_p"), F.col(label).alias("_y"), *([F.col(clv).alias(clv)] if clv else []))
            .groupBy(_grid_index(F.col("_p"), THRESHOLD_GRID_RAW).alias("idx_raw"),
                     _grid_index(F.col("_p"), THRESHOLD_GRID).alias("idx_round"))
            .agg(F.sum(F.col("_y")).cast("long").alias("pos"),
                 F.sum(1 - F.col("_y")).cast("long").alias("neg"),
                 (cents if clv else F.lit(0).cast("long")).alias("clv_cents")))


def _grid(spark) -> DataFrame:
    rows = [(j, THRESHOLD_GRID_RAW[j], THRESHOLD_GRID[j]) for j in range(len(THRESHOLD_GRID))]
    return spark.createDataFrame(rows, "j int, t_raw double, threshold double")


def sweep_core(df: DataFrame, p: str = "churn_probability", label: str = "Exited",
               clv: str | None = "clv_estimated", avg_clv: float | None = None,
               success_rate: float = RETENTION_SUCCESS_RATE, cost: float = OUTREACH_COST) -> DataFrame:
    counts = sweep_counts(df, p, label, clv)   # <= 63 x 63 rows
    g = _grid(df.sparkSession)
    above_raw = F.col("idx_raw") > F.col("j")
    above_rnd = F.col("idx_round") > F.col("j")
    # every grid row sees every count row, so the totals come out of the same aggregate
    j = (g.crossJoin(F.broadcast(counts))
         .groupBy("j", "t_raw", "threshold")
         .agg(F.sum(F.when(above_raw, F.col("pos")).otherwise(0)).cast("long").alias("tp"),
              F.sum(F.when(above_raw, F.col("neg")).otherwise(0)).cast("long").alias("fp"),
              F.sum(F.when(above_rnd, F.col("pos")).otherwise(0)).cast("long").alias("tp_at_rounded"),
              F.sum(F.when(above_rnd, F.col("neg")).otherwise(0)).cast("long").alias("fp_at_rounded"),
              F.sum("pos").cast("long").alias("P"), F.sum("neg").cast("long").alias("N"),
              F.sum("clv_cents").alias("cents")))
    mean_clv = (F.lit(float(avg_clv)) if avg_clv is not None
                else F.col("cents").cast("double") / F.lit(100.0) / (F.col("P") + F.col("N")))
    tp, fp = F.col("tp"), F.col("fp")
    revenue = tp * mean_clv * F.lit(success_rate)
    costc = (tp + fp) * F.lit(cost)
    return j.select(
        "j", "t_raw", "threshold", "tp", "fp",
        (tp + fp).alias("outreach"),
        revenue.alias("revenue"), costc.alias("cost"), (revenue - costc).alias("net_value"),
        _divide0(2 * F.col("tp_at_rounded"),
                 F.col("tp_at_rounded") + F.col("fp_at_rounded") + F.col("P")).alias("f1"),
        _divide0(2 * tp, tp + fp + F.col("P")).alias("f1_at_raw"),
        "P", "N", mean_clv.alias("avg_clv"))


def threshold_sweep(df: DataFrame, **kw) -> DataFrame:
    """62 rows (threshold, tp, fp, outreach, revenue, cost, net_value, f1, profitable)."""
    s = sweep_core(df, **kw)
    return s.select("threshold", "tp", "fp", "outreach",
                    F.bround("revenue", 2).alias("revenue"), F.bround("cost", 2).alias("cost"),
                    F.bround("net_value", 2).alias("net_value"), F.bround("f1", 4).alias("f1"),
                    (F.col("net_value") > 0).alias("profitable"))


def best_f1_threshold(df: DataFrame, **kw) -> DataFrame:
    """First strict maximum of F1 (raw grid); 0.5 when F1 is never > 0."""
    s = sweep_core(df, **kw)
    top = s.orderBy(F.col("f1_at_raw").desc(), F.col("j").asc()).limit(1)
    return top.select(F.when(F.col("f1_at_raw") > 0, F.col("threshold")).otherwise(F.lit(0.5)).alias("threshold"),
                      F.bround(F.col("f1_at_raw"), 4).alias("f1"))


def best_business_threshold(df: DataFrame, **kw) -> DataFrame:
    """First strict maximum of net value, with an at-grid-edge flag."""
    s = sweep_core(df, **kw)
    top = s.orderBy(F.col("net_value").desc(), F.col("j").asc()).limit(1)
    return top.select("threshold", F.bround("net_value", 2).alias("net_value"),
                      ((F.col("j") == 0) | (F.col("j") == len(THRESHOLD_GRID) - 1)).alias("at_edge"))


# E5-E8 ---------------------------------------------------------------------
def _bucketed(df: DataFrame, p: str, label: str, buckets: int | None, bucketing: str) -> DataFrame:
    """(score, pos, neg, b) per distinct score, bucket order following score
    order.  ``df`` is read once; what is counted about the scores (how many,
    and rows without one) is counted on the stored distinct scores."""
    score = F.col(p).cast("double")
    scores = materialize(df.select(score.alias("score"), F.col(label).alias("_y")).groupBy("score")
                         .agg(F.sum("_y").cast("long").alias("pos"), F.sum(1 - F.col("_y")).cast("long").alias("neg")), "scores")
    unranked = F.col("score").isNull() | F.isnan("score")
    n, lost = scores.agg(F.count("*"), F.sum(F.when(unranked, F.col("pos") + F.col("neg")))).first()
    if lost:
        raise ValueError(f"{lost} rows have no {p} to rank by")
    buckets = buckets or -(-n // SCORES_PER_BUCKET)
    if bucketing == "width":   # equal-width buckets on [0, 1]
        return scores.withColumn("b", F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(F.col("score") * buckets).cast("int"))))
    if buckets < 2:
        return scores.withColumn("b", F.lit(0))
    # stored, as the range edges are drawn anew in every run
    return materialize(scores.repartitionByRange(buckets, "score").withColumn("b", F.spark_partition_id()), "score-buckets")


def _offsets(per_b: DataFrame) -> DataFrame:
    """What lies above each bucket, the totals, and the first point of the next
    lower bucket, by two levels of running sums."""
    grouped = per_b.withColumn("g", F.floor(F.col("b") / BUCKETS_PER_GROUP))
    per_g = grouped.groupBy("g").agg(F.sum("bpos").alias("gpos"), F.sum("bneg").alias("gneg"),
                                     F.max_by("first_pos", "b").alias("g_first_pos"), F.max_by("first_neg", "b").alias("g_first_neg"))

    def above(col: str, order) -> Column:
        return F.coalesce(F.sum(col).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = Window.orderBy(F.col("g").desc())
    every = groups.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_g = per_g.select(F.col("g").alias("of"), above("gpos", groups).alias("g_pos_above"), above("gneg", groups).alias("g_neg_above"),
                         F.sum("gpos").over(every).cast("long").alias("P"), F.sum("gneg").over(every).cast("long").alias("N"),
                         F.lead("g_first_pos").over(groups).alias("ng_pos"), F.lead("g_first_neg").over(groups).alias("ng_neg"))
    inside = Window.partitionBy("g").orderBy(F.col("b").desc())
    return (grouped.join(F.broadcast(per_g), F.col("g") == F.col("of"))
            .select(F.col("b").alias("bucket"), (F.col("g_pos_above") + above("bpos", inside)).alias("pos_above"),
                    (F.col("g_neg_above") + above("bneg", inside)).alias("neg_above"), "P", "N",
                    F.coalesce(F.lead("first_pos").over(inside), F.col("ng_pos")).alias("nb_pos"),
                    F.coalesce(F.lead("first_neg").over(inside), F.col("ng_neg")).alias("nb_neg")))


def score_curve(df: DataFrame, p: str = "churn_probability", label: str = "Exited",
                buckets: int | None = None, bucketing: str = "range") -> DataFrame:
    """Per distinct score s: pos, neg, tp_ge = positives with score >= s,
    fp_ge = negatives with score >= s, the next lower score's (pos, neg), and
    the totals P, N.  ``bucketing``: "range" (equal counts, default) or
    "width" (equal-width on [0, 1], for scores known to spread).  Null and NaN
    scores have no place in an order: they are refused with a count."""
    scores = _bucketed(df, p, label, buckets, bucketing)
    per_b = scores.groupBy("b").agg(
        F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"),
        F.max_by("pos", "score").alias("first_pos"), F.max_by("neg", "score").alias("first_neg"))
    order = Window.partitionBy("b").orderBy(F.col("score").desc())
    inb = order.rowsBetween(Window.unboundedPreceding, 0)
    return (scores.join(_offsets(per_b), F.col("b") == F.col("bucket"))
            .select("score", "pos", "neg",
                    (F.col("pos_above") + F.sum("pos").over(inb)).cast("long").alias("tp_ge"),
                    (F.col("neg_above") + F.sum("neg").over(inb)).cast("long").alias("fp_ge"),
                    F.coalesce(F.lead("pos").over(order), F.col("nb_pos")).alias("next_pos"),
                    F.coalesce(F.lead("neg").over(order), F.col("nb_neg")).alias("next_neg"),
                    "P", "N"))


def ranking_summary(df: DataFrame, digits: int = 6, **kw) -> DataFrame:
    """E5 + E8 from one curve, in one aggregate: exact AUC (ties at half
    weight, rank-sum form), step-wise average precision, and the class totals."""
    c = score_curve(df, **kw)
    auc_term = F.col("pos") * ((F.col("N") - F.col("fp_ge")) + 0.5 * F.col("neg"))
    ap_term = F.col("pos") / F.col("P") * (F.col("tp_ge") / (F.col("tp_ge") + F.col("fp_ge")))
    return c.groupBy().agg(
        F.bround(_divide0(F.sum(auc_term), F.first("P").cast("double") * F.first("N")), digits).alias("auc"),
        F.bround(F.coalesce(F.sum(F.when(F.col("pos") > 0, ap_term)), F.lit(0.0)), digits).alias("average_precision"),
        F.first("P").alias("positives"), F.first("N").alias("negatives"))


def auc_exact(df: DataFrame, **kw) -> DataFrame:
    """E5: exact ROC AUC, ties at half weight (rank-sum form)."""
    return ranking_summary(df, **kw).select("auc", "positives", "negatives")


def roc_points(df: DataFrame, drop_intermediate: bool = False, **kw) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) per distinct score.  With
    ``drop_intermediate`` a point is kept only where the curve bends: the
    first and last points, and points whose step differs from the next one
    (collinear points dropped, as the usual ROC library default does)."""
    c = score_curve(df, **kw)
    if drop_intermediate:
        first = (F.col("tp_ge") == F.col("pos")) & (F.col("fp_ge") == F.col("neg"))
        last = F.col("next_pos").isNull()
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        c = c.where(first | last | bend)
    return c.select(F.col("score").alias("threshold"), F.col("tp_ge").alias("tp"), F.col("fp_ge").alias("fp"),
                    F.bround(_divide0(F.col("tp_ge"), F.col("P")), 6).alias("tpr"),
                    F.bround(_divide0(F.col("fp_ge"), F.col("N")), 6).alias("fpr"))


def pr_points(df: DataFrame, **kw) -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    c = score_curve(df, **kw)
    return c.select(F.col("score").alias("threshold"),
                    F.bround(_divide0(F.col("tp_ge"), F.col("tp_ge") + F.col("fp_ge")), 6).alias("precision"),
                    F.bround(_divide0(F.col("tp_ge"), F.col("P")), 6).alias("recall"))


def average_precision(df: DataFrame, **kw) -> DataFrame:
    """Step-wise sum (R_n - R_{n-1}) * P_n (not the trapezoid area)."""
    return ranking_summary(df, **kw).select("average_precision")


# E11 -----------------------------------------------------------------------
def metrics_record(df: DataFrame, threshold: float, model_name: str = "scorecard",
                   p: str = "churn_probability", label: str = "Exited", clv: str = "clv_estimated",
                   f1_threshold_from: DataFrame | None = None, **sweep_kw) -> DataFrame:
    """One nested row with every metric and the curve as arrays.
    Metrics are taken at ``threshold`` - the F1-optimal threshold chosen
    elsewhere (validation rows in the pipeline), reported as
    ``f1_optimal_threshold``; business optimum and curve come from ``df``, both
    out of one sweep.  Every figure is rounded once."""
    m = classification_metrics(df, threshold, p, label)
    rank = ranking_summary(df, 4, p=p, label=label).select("auc", "average_precision")
    sweep = sweep_core(df, p=p, label=label, clv=clv, **sweep_kw)
    f1t = (f1_threshold_from.select(F.col("threshold").alias("f1_optimal_threshold"))
           if f1_threshold_from is not None
           else df.sparkSession.range(1).select(F.lit(float(threshold)).alias("f1_optimal_threshold")))
    curve = sweep.agg(
        F.sort_array(F.collect_list(F.struct("j", "threshold", F.bround("f1", 4).alias("f1"),
                                             F.bround("net_value", 2).alias("net")))).alias("_c"),
        F.max(F.struct("net_value", (-F.col("j")).alias("first"), "threshold")).alias("_best"),
        F.first("avg_clv").alias("avg_clv"))
    row = (m.crossJoin(rank).crossJoin(f1t).crossJoin(curve))
    return row.select(
        F.lit(model_name).alias("model_name"),
        F.col("auc").alias("test_auc"),
        F.col("f1").alias("test_f1"), F.col("precision").alias("test_precision"),
        F.col("recall").alias("test_recall"), F.col("accuracy").alias("test_accuracy"),
        "average_precision", "catch_rate", "false_alarm_rate",
        F.struct(F.col("tp").alias("TP"), F.col("fp").alias("FP"), F.col("tn").alias("TN"),
                 F.col("fn").alias("FN")).alias("confusion_matrix"),
        "f1_optimal_threshold",
        F.col("_best.threshold").alias("business_optimal_threshold"),
        F.bround("_best.net_value", 2).alias("net_value_at_optimal_threshold"),
        F.bround("avg_clv", 2).alias("avg_clv"),
        F.lit(RETENTION_SUCCESS_RATE).alias("retention_success_rate"),
        F.lit(OUTREACH_COST).alias("cost_per_outreach"),
        F.struct(F.transform("_c", lambda s: s["threshold"]).alias("thresholds"),
                 F.transform("_c", lambda s: s["f1"]).alias("f1_scores"),
                 F.transform("_c", lambda s: s["net"]).alias("net_values")).alias("threshold_analysis"),
    )
