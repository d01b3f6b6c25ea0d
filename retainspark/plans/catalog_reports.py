"""Report queries (dashboard data): R1-R11, A1-A12, T1-T5, P1-P6, S10, F15-F19."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import reports as rp
from ..schema import ENGINEERED
from . import base
from . import oracle as O
from .registry import register

S = O.with_ctes(*O.BASE_TO_SCORED)
S_F1 = O.with_ctes(*O.BASE_TO_SCORED) + """
 , f1t AS (SELECT CASE WHEN f1_at_raw > 0 THEN threshold ELSE 0.5e0 END AS f1_threshold
           FROM sw ORDER BY f1_at_raw DESC, j ASC LIMIT 1)"""


@register("actions", S + " SELECT CustomerId, action_code, recommended_action FROM scored")
def q_actions(spark, sf):
    return base.Plan(spark, sf).report.select("CustomerId", "action_code", "recommended_action")


@register("label_decode", S + " SELECT CustomerId, Geography_Label, Gender_Label, Age_Group_Label, Tenure_Label,"
          " Credit_Label FROM scored")
def q_label_decode(spark, sf):
    return base.Plan(spark, sf).report.select("CustomerId", "Geography_Label", "Gender_Label", "Age_Group_Label",
                                         "Tenure_Label", "Credit_Label")


@register("kpis", S + f"""
 , k AS (SELECT count(*) AS customers,
                count(*) FILTER (WHERE churn_probability >= biz_threshold) AS at_risk,
                {O.msum("CASE WHEN risk_level = 'HIGH' THEN retention_value END")} AS revenue_at_risk_high,
                {O.mavg("clv_estimated")} AS avg_clv
         FROM scored CROSS JOIN biz)
 SELECT customers, at_risk, revenue_at_risk_high, avg_clv,
        round_even(CASE WHEN customers > 0 THEN at_risk / customers ELSE 0.0e0 END, 6) AS at_risk_share,
        CASE WHEN (CASE WHEN customers > 0 THEN at_risk / customers ELSE 0.0e0 END) > 0.25e0 THEN 'red'
             WHEN (CASE WHEN customers > 0 THEN at_risk / customers ELSE 0.0e0 END) > 0.15e0 THEN 'amber'
             ELSE 'green' END AS risk_band
 FROM k""")
def q_kpis(spark, sf):
    plan = base.Plan(spark, sf)
    return rp.kpis(plan.scored, plan.biz)


def _display_sql(kind: str, x: str) -> str:
    return {"euros": f"'\u20ac' || format('{{:,.0f}}', round_even({x}, 0))", "percent": f"printf('%.1f%%', round_even(({x}) * 100, 1))"}[kind]


def _executive_sql() -> str:
    from .catalog import _metrics_doc_sql
    share = "CASE WHEN customers > 0 THEN at_risk / customers ELSE 0.0e0 END"
    return _metrics_doc_sql() + f""", {O.SCORED}
 , k AS (SELECT count(*) AS customers,
                count(*) FILTER (WHERE churn_probability >= biz_threshold) AS at_risk,
                {O.msum("CASE WHEN risk_level = 'HIGH' THEN retention_value END")} AS revenue_at_risk_high,
                {O.mavg("clv_estimated")} AS avg_clv
         FROM scored CROSS JOIN biz)
 , e AS (SELECT customers, at_risk, revenue_at_risk_high, avg_clv, round_even({share}, 6) AS at_risk_share,
        CASE WHEN ({share}) > 0.25e0 THEN 'red' WHEN ({share}) > 0.15e0 THEN 'amber' ELSE 'green' END AS risk_band,
        test_auc AS model_auc, catch_rate, net_value_at_optimal_threshold AS business_value
        FROM k CROSS JOIN doc)
 SELECT *, format('{{:,}}', at_risk) || ' (' || {_display_sql("percent", "at_risk_share")} || ' of base)' AS at_risk_card,
        {_display_sql("euros", "revenue_at_risk_high")} AS revenue_at_risk_card, printf('%.4f', model_auc) AS model_auc_card,
        {_display_sql("percent", "catch_rate")} AS catch_rate_card, {_display_sql("euros", "avg_clv")} AS avg_clv_card,
        {_display_sql("euros", "business_value")} AS business_value_card
 FROM e"""


@register("executive_kpis", _executive_sql())
def q_executive_kpis(spark, sf):
    plan = base.Plan(spark, sf)
    f1t = ev.best_f1_threshold(plan.prob).first()["threshold"]     # one resolved value
    return rp.executive_kpis(plan.scored, plan.biz, ev.metrics_record(plan.prob, f1t))


@register("score_histogram", S_F1 + """
 , h AS (SELECT CAST(least(39, greatest(0, floor(churn_probability * 40))) AS INTEGER) AS bin, count(*) AS n
         FROM scored GROUP BY 1)
 SELECT b.bin, round_even(b.bin / 40, 6) AS lower, round_even((b.bin + 1) / 40, 6) AS upper,
        CAST(coalesce(h.n, 0) AS BIGINT) AS customers, f1_threshold, biz_threshold AS business_threshold
 FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(40)) b LEFT JOIN h ON b.bin = h.bin
      CROSS JOIN f1t CROSS JOIN biz""")
def q_score_histogram(spark, sf):
    plan = base.Plan(spark, sf)
    f1t = ev.best_f1_threshold(plan.prob).first()["threshold"]     # one resolved value
    return rp.score_histogram(plan.scored).select("*", F.lit(f1t).alias("f1_threshold"),
                                                  F.lit(plan.biz).alias("business_threshold"))


@register("revenue_by_segment", S + f"""
 SELECT Geography_Label AS geography, Age_Group_Label AS age_group, {O.msum('retention_value')} AS retention_value
 FROM scored WHERE Geography_Label IS NOT NULL AND Age_Group_Label IS NOT NULL GROUP BY 1, 2""")
def q_revenue_by_segment(spark, sf):
    return rp.revenue_by_segment(base.Plan(spark, sf).report)


def _cohort_sql() -> str:
    dims = [("geography", "Geography_Label"), ("age_group", "Age_Group_Label"), ("tenure", "Tenure_Label"),
            ("credit_band", "Credit_Label"),
            ("activity", "CASE WHEN IsActiveMember = 1 THEN 'Active' WHEN IsActiveMember = 0 THEN 'Inactive' END")]
    parts = [f"SELECT '{d}' AS dimension, {e} AS segment, count(*) AS customers,"
             f" round_even(avg(Exited) * 100, 1) AS churn_rate_pct FROM scored WHERE {e} IS NOT NULL GROUP BY 2"
             for d, e in dims]
    return S + " " + " UNION ALL ".join(parts)


@register("cohort_churn", _cohort_sql())
def q_cohort_churn(spark, sf):
    return rp.cohort_churn(base.Plan(spark, sf).report)


@register("value_by_geography", S + f"""
 SELECT Geography_Label AS geography, {O.msum('retention_value')} AS total_retention_value,
        {O.mavg('retention_value')} AS avg_retention_value, count(*) AS customers
 FROM scored GROUP BY 1""")
def q_value_by_geography(spark, sf):
    return rp.value_by_geography(base.Plan(spark, sf).report)


@register("worst_segment", S + f"""
 , g AS (SELECT Geography_Label AS geography, avg(Exited) AS rate, {O.mavg('retention_value', 6)} AS avg_rv
         FROM scored GROUP BY 1)
 SELECT geography, round_even(rate, 6) AS churn_rate, round_even(avg_rv, 4) AS avg_retention_value
 FROM g ORDER BY rate DESC, geography LIMIT 1""")
def q_worst_segment(spark, sf):
    return rp.worst_segment(base.Plan(spark, sf).report)


# Dashboard filter state used by the call-list queries
CALL_ARGS = dict(risk="ALL", geo="Germany", min_rv=20.0, active="Inactive")
_CALL_WHERE = "Geography_Label = 'Germany' AND retention_value >= 20.0e0 AND IsActiveMember = 0"
_CALL_COLS = ", ".join(rp.CALL_COLUMNS)


@register("call_list", S + f"""
 SELECT {_CALL_COLS} FROM scored WHERE {_CALL_WHERE}
 ORDER BY churn_probability DESC, CustomerId ASC LIMIT 100""")
def q_call_list(spark, sf):
    return rp.call_list(base.Plan(spark, sf).report, sort_col="churn_probability", **CALL_ARGS)


@register("call_list_high_risk", S + f"""
 SELECT {_CALL_COLS} FROM scored WHERE risk_level = 'HIGH' AND retention_value >= 0.0e0
 ORDER BY retention_value DESC, CustomerId ASC LIMIT 100""")
def q_call_list_high_risk(spark, sf):
    return rp.call_list(base.Plan(spark, sf).report, risk="HIGH", sort_col="no_such_column")


@register("call_list_shown", S + f"""
 , l AS (SELECT {_CALL_COLS} FROM scored WHERE {_CALL_WHERE} ORDER BY churn_probability DESC, CustomerId ASC LIMIT 100)
 SELECT left(CAST(CustomerId AS VARCHAR), 10) AS CustomerId, CAST(Age AS VARCHAR) AS Age, left(Geography_Label, 40) AS Geography_Label,
        {_display_sql("euros", "Balance")} AS Balance, {_display_sql("euros", "clv_estimated")} AS clv_estimated,
        {_display_sql("percent", "churn_probability")} AS churn_probability, {_display_sql("euros", "retention_value")} AS retention_value,
        risk_level, left(recommended_action, 40) AS recommended_action FROM l""")
def q_call_list_shown(spark, sf):
    return rp.call_list_shown(rp.call_list(base.Plan(spark, sf).report, sort_col="churn_probability", **CALL_ARGS))


@register("call_list_total", S + f"""
 , shown AS (SELECT retention_value FROM scored WHERE {_CALL_WHERE}
             ORDER BY churn_probability DESC, CustomerId ASC LIMIT 100)
 SELECT count(*) AS customers, {O.msum('retention_value')} AS total_retention_value FROM shown""")
def q_call_list_total(spark, sf):
    return rp.call_list_total(base.Plan(spark, sf).report, sort_col="churn_probability", **CALL_ARGS)


@register("export_rows", S + f" SELECT {_CALL_COLS} FROM scored WHERE {_CALL_WHERE}")
def q_export_rows(spark, sf):
    return rp.export_rows(base.Plan(spark, sf).report, **CALL_ARGS).select(*rp.CALL_COLUMNS)


@register("customer_picker", S + """
 SELECT CustomerId, 'ID ' || CustomerId || ' | Age ' || Age || ' | ' || coalesce(Geography_Label, '?') || ' | '
        || coalesce(risk_level, '?') AS label
 FROM scored ORDER BY CustomerId LIMIT 200""")
def q_customer_picker(spark, sf):
    return rp.customer_picker(base.Plan(spark, sf).report)


@register("masked_aggregates", S + f"""
 SELECT {O.msum("CASE WHEN risk_level = 'HIGH' THEN retention_value END")} AS high_value_sum,
        count(*) FILTER (WHERE risk_level = 'HIGH' AND IsActiveMember = 0) AS high_and_inactive,
        {O.mavg("CASE WHEN IsActiveMember = 0 THEN retention_value END")} AS inactive_avg_value
 FROM scored""")
def q_masked_aggregates(spark, sf):
    return rp.masked_sums(base.Plan(spark, sf).report)


@register("customer_lookup", S + f""" SELECT {', '.join(rp.TOP_COLUMNS)} FROM scored WHERE CustomerId = 10000007""")
def q_customer_lookup(spark, sf):
    return rp.customer_lookup(base.Plan(spark, sf).report, 10000007).select(*rp.TOP_COLUMNS)


@register("max_retention_value", S + """ SELECT coalesce(CAST(max(retention_value) AS DOUBLE), 500.0e0)
 AS max_retention_value FROM scored""")
def q_max_retention_value(spark, sf):
    return rp.column_max(base.Plan(spark, sf).report, "retention_value", 500.0)


# --- A1 / A2 ----------------------------------------------------------------------------
_CORR = O.with_ctes(O.CUST, O.FEAT) + " , cr AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round_even(corr(CAST({c} AS DOUBLE), CAST(Exited AS DOUBLE)), 6) AS r FROM feat"
    for c in ENGINEERED) + ")"


@register("correlations", _CORR + " SELECT feature, r FROM cr")
def q_correlations(spark, sf):
    return rp.correlations(base.Plan(spark, sf).feat)


@register("top_correlations", _CORR + """
 , ca AS (SELECT feature, r, CASE WHEN NOT isnan(r) THEN abs(r) END AS abs_r FROM cr)
 SELECT feature, r, abs_r FROM ca ORDER BY abs_r DESC NULLS LAST, feature LIMIT 5""")
def q_top_correlations(spark, sf):
    return rp.top_correlations(base.Plan(spark, sf).feat)
