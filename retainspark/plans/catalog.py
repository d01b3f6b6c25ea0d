"""Named queries (spark, sf_dir) -> DataFrame, each with a DuckDB twin.

Every query reads the driver tables (``customer`` and ``orders``) in full and
derives everything else from them, so its work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import reports as rp
from ..operators.features import train_serve_skew
from . import base
from . import oracle as O
from .registry import register

_div0 = O.div0

_RAW_COLS = ("RowNumber, CustomerId, Surname, CreditScore, Geography, Gender, Age, Tenure, Balance, "
             "NumOfProducts, HasCrCard, IsActiveMember, EstimatedSalary, Exited")
_FEAT_COLS = ("RowNumber, CustomerId, CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts, "
              "HasCrCard, IsActiveMember, EstimatedSalary, balance_salary_ratio, products_per_year, age_group, "
              "engagement_score, credit_score_band, is_zero_balance, high_value_customer, tenure_stability, "
              "age_tenure_ratio, inactive_high_balance, clv_estimated, Exited")


# --- S3, F1-F14 -------------------------------------------------------------
@register("customer_base", O.with_ctes(O.CUST) + f" SELECT {_RAW_COLS} FROM cust")
def q_customer_base(spark, sf):
    return base.cust(spark, sf)


@register("features", O.with_ctes(O.CUST, O.FEAT) + f" SELECT {_FEAT_COLS} FROM feat")
def q_features(spark, sf):
    return base.Plan(spark, sf).feat


@register("train_serve_skew", O.with_ctes(O.CUST, O.FEAT) + f"""
 , sk AS (SELECT clv_estimated, high_value_customer, {O.clv_sql(O.CLV_SERVING)} AS clv_serving FROM feat)
 SELECT count(*) AS n,
        round_even(avg(abs(clv_serving - clv_estimated)), 4) AS mean_abs_clv_gap,
        round_even(max(abs(clv_serving - clv_estimated)), 2) AS max_abs_clv_gap,
        round_even(avg(clv_estimated), 4) AS mean_clv_training,
        round_even(avg(clv_serving), 4) AS mean_clv_serving,
        CAST(sum(high_value_customer) AS BIGINT) AS high_value_flag_lost
 FROM sk""")
def q_train_serve_skew(spark, sf):
    return train_serve_skew(base.Plan(spark, sf).cust)


# --- C1, C3, F15-F19 -------------------------------------------------------------
@register("scorecard", O.with_ctes(*O.BASE_TO_PROB) + " SELECT CustomerId, churn_probability FROM prob")
def q_scorecard(spark, sf):
    return base.Plan(spark, sf).prob.select("CustomerId", "churn_probability")


_SCORED_COLS = ("CustomerId, churn_probability, churn_prediction, retention_value, risk_level, action_code, "
                "recommended_action, Geography_Label, Gender_Label, Age_Group_Label, Tenure_Label, Credit_Label")


@register("scored", O.with_ctes(*O.BASE_TO_SCORED) + f" SELECT {_SCORED_COLS} FROM scored")
def q_scored(spark, sf):
    return base.Plan(spark, sf).scored.select(*[c.strip() for c in _SCORED_COLS.split(",")])


# --- R4 / T1 -----------------------------------------------------------------
_TOP = ", ".join(rp.TOP_COLUMNS)


@register("first_call_list", O.with_ctes(*O.BASE_TO_SCORED)
          + f" SELECT {_TOP} FROM scored ORDER BY retention_value DESC, CustomerId ASC LIMIT 10")
def q_first_call_list(spark, sf):
    return rp.first_call_list(base.Plan(spark, sf).report)


# --- E1-E4, E9-E12 --------------------------------------------------------------
@register("confusion", O.with_ctes(*O.BASE_TO_PROB) + """
 SELECT count(*) FILTER (WHERE churn_probability >= 0.5e0 AND Exited = 1) AS tp,
        count(*) FILTER (WHERE churn_probability >= 0.5e0 AND Exited = 0) AS fp,
        count(*) FILTER (WHERE churn_probability < 0.5e0 AND Exited = 0) AS tn,
        count(*) FILTER (WHERE churn_probability < 0.5e0 AND Exited = 1) AS fn FROM prob""")
def q_confusion(spark, sf):
    return ev.confusion(base.Plan(spark, sf).prob, 0.5)


@register("classification_metrics", O.with_ctes(*O.BASE_TO_PROB) + f"""
 , cm AS (SELECT count(*) FILTER (WHERE churn_probability >= 0.5e0 AND Exited = 1) AS tp,
        count(*) FILTER (WHERE churn_probability >= 0.5e0 AND Exited = 0) AS fp,
        count(*) FILTER (WHERE churn_probability < 0.5e0 AND Exited = 0) AS tn,
        count(*) FILTER (WHERE churn_probability < 0.5e0 AND Exited = 1) AS fn FROM prob)
 SELECT tp, fp, tn, fn,
        round_even({_div0('tp', 'tp + fp')}, 4) AS precision,
        round_even({_div0('tp', 'tp + fn')}, 4) AS recall,
        round_even({_div0('2 * tp', '2 * tp + fp + fn')}, 4) AS f1,
        round_even({_div0('tp + tn', 'tp + fp + tn + fn')}, 4) AS accuracy,
        round_even({_div0('tp', 'tp + fn')}, 4) AS catch_rate,
        round_even({_div0('fp', 'fp + tn')}, 4) AS false_alarm_rate FROM cm""")
def q_classification_metrics(spark, sf):
    return ev.classification_metrics(base.Plan(spark, sf).prob, 0.5)


@register("threshold_sweep", O.with_ctes(*O.BASE_TO_PROB, O.sweep_ctes("prob")) + """
 SELECT threshold, tp, fp, outreach, round_even(revenue, 2) AS revenue, round_even(cost, 2) AS cost,
        round_even(net_value, 2) AS net_value, round_even(f1, 4) AS f1, net_value > 0 AS profitable FROM sw""")
def q_threshold_sweep(spark, sf):
    return ev.threshold_sweep(base.Plan(spark, sf).prob)


@register("best_f1_threshold", O.with_ctes(*O.BASE_TO_PROB, O.sweep_ctes("prob")) + """
 SELECT CASE WHEN f1_at_raw > 0 THEN threshold ELSE 0.5e0 END AS threshold, round_even(f1_at_raw, 4) AS f1
 FROM sw ORDER BY f1_at_raw DESC, j ASC LIMIT 1""")
def q_best_f1_threshold(spark, sf):
    return ev.best_f1_threshold(base.Plan(spark, sf).prob)


@register("best_business_threshold", O.with_ctes(*O.BASE_TO_PROB, O.sweep_ctes("prob")) + """
 SELECT threshold, round_even(net_value, 2) AS net_value, (j = 0 OR j = 61) AS at_edge
 FROM sw ORDER BY net_value DESC, j ASC LIMIT 1""")
def q_best_business_threshold(spark, sf):
    return ev.best_business_threshold(base.Plan(spark, sf).prob)


# --- E5-E8 --------------------------------------------------------------------
_CURVE = """
 , dist AS (SELECT churn_probability AS score, CAST(sum(Exited) AS BIGINT) AS pos,
                   CAST(count(*) - sum(Exited) AS BIGINT) AS neg FROM prob GROUP BY churn_probability)
 , tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM dist)
 , curve AS (SELECT score, pos, neg,
        sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_ge,
        sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_ge,
        P, N FROM dist CROSS JOIN tot)"""


@register("auc_exact", O.with_ctes(*O.BASE_TO_PROB) + _CURVE + f"""
 SELECT round_even({_div0('sum(pos * ((N - fp_ge) + 0.5e0 * neg))', 'first(P) * first(N)')}, 6) AS auc,
        CAST(first(P) AS BIGINT) AS positives, CAST(first(N) AS BIGINT) AS negatives FROM curve""")
def q_auc_exact(spark, sf):
    return ev.auc_exact(base.Plan(spark, sf).prob)


@register("roc_points", O.with_ctes(*O.BASE_TO_PROB) + _CURVE + f"""
 SELECT score AS threshold, CAST(tp_ge AS BIGINT) AS tp, CAST(fp_ge AS BIGINT) AS fp,
        round_even({_div0('tp_ge', 'P')}, 6) AS tpr, round_even({_div0('fp_ge', 'N')}, 6) AS fpr FROM curve""")
def q_roc_points(spark, sf):
    return ev.roc_points(base.Plan(spark, sf).prob)


@register("pr_points", O.with_ctes(*O.BASE_TO_PROB) + _CURVE + f"""
 SELECT score AS threshold, round_even({_div0('tp_ge', 'tp_ge + fp_ge')}, 6) AS precision,
        round_even({_div0('tp_ge', 'P')}, 6) AS recall FROM curve""")
def q_pr_points(spark, sf):
    return ev.pr_points(base.Plan(spark, sf).prob)


@register("average_precision", O.with_ctes(*O.BASE_TO_PROB) + _CURVE + """
 SELECT round_even(coalesce(sum(CASE WHEN pos > 0 THEN pos / P * (tp_ge / (tp_ge + fp_ge)) END), 0.0e0), 6)
        AS average_precision FROM curve""")
def q_average_precision(spark, sf):
    return ev.average_precision(base.Plan(spark, sf).prob)


# --- A12 / E12 ----------------------------------------------------------------------
@register("mean_clv", O.with_ctes(O.CUST, O.FEAT) + f" SELECT {O.mavg('clv_estimated')} AS avg_clv FROM feat")
def q_mean_clv(spark, sf):
    return rp.mean_clv(base.Plan(spark, sf).feat)


# --- E11 / R7 -----------------------------------------------------------------------
def _metrics_doc_sql() -> str:
    sw = O.sweep_ctes("prob")
    return O.with_ctes(*O.BASE_TO_PROB, sw) + _CURVE + f"""
 , f1t AS (SELECT CASE WHEN f1_at_raw > 0 THEN threshold ELSE 0.5e0 END AS t FROM sw ORDER BY f1_at_raw DESC, j LIMIT 1)
 , bz AS (SELECT threshold AS bt, net_value AS bn FROM sw ORDER BY net_value DESC, j LIMIT 1)
 , cm AS (SELECT count(*) FILTER (WHERE churn_probability >= t AND Exited = 1) AS tp,
                 count(*) FILTER (WHERE churn_probability >= t AND Exited = 0) AS fp,
                 count(*) FILTER (WHERE churn_probability < t AND Exited = 0) AS tn,
                 count(*) FILTER (WHERE churn_probability < t AND Exited = 1) AS fn FROM prob CROSS JOIN f1t)
 , au AS (SELECT {_div0('sum(pos * ((N - fp_ge) + 0.5e0 * neg))', 'first(P) * first(N)')} AS auc,
                 coalesce(sum(CASE WHEN pos > 0 THEN pos / P * (tp_ge / (tp_ge + fp_ge)) END), 0.0e0) AS ap FROM curve)
 , doc AS (SELECT round_even(auc, 4) AS test_auc, round_even({_div0('2 * tp', '2 * tp + fp + fn')}, 4) AS test_f1,
                  round_even({_div0('tp', 'tp + fp')}, 4) AS test_precision,
                  round_even({_div0('tp', 'tp + fn')}, 4) AS test_recall,
                  round_even({_div0('tp + tn', 'tp + fp + tn + fn')}, 4) AS test_accuracy,
                  round_even(ap, 4) AS average_precision, round_even({_div0('tp', 'tp + fn')}, 4) AS catch_rate,
                  round_even({_div0('fp', 'fp + tn')}, 4) AS false_alarm_rate, t AS f1_optimal_threshold,
                  bt AS business_optimal_threshold, round_even(bn, 2) AS net_value_at_optimal_threshold
           FROM cm CROSS JOIN au CROSS JOIN f1t CROSS JOIN bz)"""


def _metrics_table_sql() -> str:
    return _metrics_doc_sql() + """
 , vals AS (SELECT 0 AS position, 'Model' AS label, 'scorecard' AS value
 """ + "".join(
        f" UNION ALL SELECT {i}, '{lab}', CASE WHEN {key} < 10 THEN printf('%.4f', {key})"
        f" ELSE '€' || format('{{:,.2f}}', {key}) END FROM doc"
        for i, (key, lab) in enumerate(rp.METRIC_LABELS) if key != "model_name") + """)
 SELECT position, label, value FROM vals"""


_SCALARS = ["test_auc", "test_f1", "test_precision", "test_recall", "test_accuracy", "average_precision", "catch_rate", "false_alarm_rate",
            "f1_optimal_threshold", "business_optimal_threshold", "net_value_at_optimal_threshold"]


def _metrics_report_sql() -> str:
    parts = [f"SELECT '{c}' AS name, 0 AS position, CAST({c} AS DOUBLE) AS value FROM doc" for c in _SCALARS]
    parts += [f"SELECT '{n}', 0, CAST({c} AS DOUBLE) FROM cm" for n, c in (("TP", "tp"), ("FP", "fp"), ("TN", "tn"), ("FN", "fn"))]
    parts += ["SELECT 'avg_clv', 0, round_even(CAST(cents AS DOUBLE) / 100.0e0 / (P + N), 2) FROM sw_tot",
              "SELECT 'retention_success_rate', 0, 0.3e0", "SELECT 'cost_per_outreach', 0, 10.0e0",
              "SELECT 'thresholds', j, threshold FROM sw", "SELECT 'f1_scores', j, round_even(f1, 4) FROM sw",
              "SELECT 'net_values', j, round_even(net_value, 2) FROM sw"]
    return _metrics_doc_sql() + " " + " UNION ALL ".join(parts)


@register("metrics_report", _metrics_report_sql())
def q_metrics_report(spark, sf):
    """E11 flattened: (name, position, value); the curve's arrays by position."""
    p = base.Plan(spark, sf).prob
    f1t = ev.best_f1_threshold(p).first()["threshold"]       # one resolved value
    doc = ev.metrics_record(p, f1t, model_name="scorecard")
    one = lambda n, c: F.struct(F.lit(n).alias("name"), F.lit(0).alias("position"), c.cast("double").alias("value"))

    def curve(n):
        return F.transform(F.col(f"threshold_analysis.{n}"),
                           lambda x, i: F.struct(F.lit(n).alias("name"), i.alias("position"), x.cast("double").alias("value")))

    arrays = [curve(n) for n in ("thresholds", "f1_scores", "net_values")]
    scalars = [one(c, F.col(c)) for c in [*_SCALARS, "avg_clv", "retention_success_rate", "cost_per_outreach"]]
    scalars += [one(c, F.col(f"confusion_matrix.{c}")) for c in ("TP", "FP", "TN", "FN")]
    return doc.select(F.explode(F.concat(F.array(*scalars), *arrays)).alias("s")).select("s.*")


@register("metrics_table", _metrics_table_sql())
def q_metrics_table(spark, sf):
    p = base.Plan(spark, sf).prob
    f1t = ev.best_f1_threshold(p).first()["threshold"]       # one resolved value
    return rp.metrics_table(ev.metrics_record(p, f1t, model_name="scorecard"))


@register("roc_points_reduced", O.with_ctes(*O.BASE_TO_PROB) + _CURVE + f"""
 , rc AS (SELECT *, lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg
          FROM curve)
 SELECT score AS threshold, CAST(tp_ge AS BIGINT) AS tp, CAST(fp_ge AS BIGINT) AS fp,
        round_even({_div0('tp_ge', 'P')}, 6) AS tpr, round_even({_div0('fp_ge', 'N')}, 6) AS fpr FROM rc
 WHERE (tp_ge = pos AND fp_ge = neg) OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""")
def q_roc_points_reduced(spark, sf):
    return ev.roc_points(base.Plan(spark, sf).prob, drop_intermediate=True)
