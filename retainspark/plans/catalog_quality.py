"""Quality, split and serving queries: V1-V7, M1, M2, A11, F12b, C4, A10, R10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as qa
from ..operators import serve
from ..operators import split as sp
from ..operators.features import serving_features
from ..operators.reports import split_rates
from ..schema import RAW_SCHEMA
from ..sources.requests import requests_from_base
from . import base
from . import oracle as O
from .registry import register

_RAW_NAMES = [f.name for f in RAW_SCHEMA.fields]


@register("dq_gates", O.with_ctes(O.CUST) + f"""
 , g AS (SELECT count(*) AS n, {' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in _RAW_NAMES)} AS nulls,
                avg(Exited) AS rate FROM cust)
 SELECT n AS rows, CAST(nulls AS BIGINT) AS null_cells, round_even(rate, 6) AS label_rate, n > 0 AS rows_ok,
        nulls = 0 AS nulls_ok, rate BETWEEN 0.15e0 AND 0.25e0 AS label_rate_ok FROM g""")
def q_dq_gates(spark, sf):
    return qa.quality_gates(base.cust(spark, sf))


_NUMERIC = ["RowNumber", "CustomerId", "CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard",
            "IsActiveMember", "EstimatedSalary", "Exited"]


@register("profile", O.with_ctes(O.CUST) + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round_even(avg({c}), 4) AS mean,
        round_even(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min,
        round_even(quantile_cont({c}, 0.25), 4) AS p25, round_even(quantile_cont({c}, 0.5), 4) AS p50,
        round_even(quantile_cont({c}, 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM cust"""
    for c in _NUMERIC))
def q_profile(spark, sf):
    return qa.profile(base.Plan(spark, sf).cust)


_REQ = O.with_ctes(O.CUST, O.requests_sql("cust"))


@register("contract_violations", _REQ + " , viol AS (" + " UNION ALL ".join(
    f"SELECT '{r}' AS rule FROM req WHERE NOT coalesce({c}, false)" for r, c in O.CONTRACT_SQL.items())
    + ") SELECT rule, count(*) AS violations FROM viol GROUP BY rule")
def q_contract_violations(spark, sf):
    return qa.violation_counts(requests_from_base(base.cust(spark, sf)))


def _whatif_sql(zero_is_missing: bool) -> str:
    d = qa.WHATIF_DEFAULTS

    def num(c, t):
        x = f"nullif({c}, 0)" if zero_is_missing else c
        return f"CAST(coalesce({x}, {O._lit(d[c])}) AS {t}) AS {c}"

    def txt(c):
        return f"coalesce(nullif({c}, ''), '{d[c]}') AS {c}"
    cols = [num("CreditScore", "INTEGER"), txt("Geography"), txt("Gender"), num("Age", "INTEGER"),
            num("Tenure", "INTEGER"), num("Balance", "DOUBLE"), num("NumOfProducts", "INTEGER"),
            "1 AS HasCrCard", f"CAST(coalesce(IsActiveMember, {d['IsActiveMember']}) AS INTEGER) AS IsActiveMember",
            num("EstimatedSalary", "DOUBLE")]
    return _REQ + f" SELECT CustomerId, {', '.join(cols)} FROM req"


@register("whatif_defaults", _whatif_sql(zero_is_missing=True))
def q_whatif_defaults(spark, sf):
    """Original form handling: a 0 counts as missing."""
    return qa.whatif_defaults(requests_from_base(base.cust(spark, sf)), zero_is_missing=True)


@register("whatif_defaults_null_only", _whatif_sql(zero_is_missing=False))
def q_whatif_defaults_null_only(spark, sf):
    return qa.whatif_defaults(requests_from_base(base.cust(spark, sf)))


# --- M1 / M2 / A11 --------------------------------------------------------------------
SPLIT = """
 , sp_n AS (SELECT count(*) AS n, sum(Exited) AS npos FROM feat)
 , sp_q1 AS (SELECT n, npos, CAST(ceil(n * 0.2e0) AS BIGINT) AS n_test FROM sp_n)
 , sp_q2 AS (SELECT *, CAST(floor(n_test * npos / n + 0.5e0) AS BIGINT) AS pos_test FROM sp_q1)
 , sp_q3 AS (SELECT *, CAST(ceil((n - n_test) * 0.125e0) AS BIGINT) AS n_val FROM sp_q2)
 , sp_q AS (SELECT pos_test, n_test - pos_test AS neg_test,
                   CAST(CASE WHEN n - n_test > 0 THEN floor(n_val * (npos - pos_test) / (n - n_test) + 0.5e0)
                        ELSE 0 END AS BIGINT) AS pos_val, n_val FROM sp_q3)
 , sp_r AS (SELECT feat.*, row_number() OVER (PARTITION BY Exited
                ORDER BY md5(CAST(CustomerId AS VARCHAR) || ':42'), CustomerId) AS _rank FROM feat)
 , splits AS (SELECT sp_r.*,
        CASE WHEN _rank <= CASE WHEN Exited = 1 THEN pos_test ELSE neg_test END THEN 'test'
             WHEN _rank <= CASE WHEN Exited = 1 THEN pos_test + pos_val ELSE neg_test + n_val - pos_val END
             THEN 'val' ELSE 'train' END AS split
    FROM sp_r CROSS JOIN sp_q)"""


@register("split_membership", O.with_ctes(O.CUST, O.FEAT) + SPLIT + " SELECT CustomerId, split FROM splits")
def q_split_membership(spark, sf):
    return sp.stratified_split(base.Plan(spark, sf).feat).select("CustomerId", "split")


@register("split_rates", O.with_ctes(O.CUST, O.FEAT) + SPLIT + """
 SELECT split, count(*) AS rows, round_even(avg(Exited), 6) AS churn_rate FROM splits GROUP BY split""")
def q_split_rates(spark, sf):
    return split_rates(sp.stratified_split(base.Plan(spark, sf).feat))


@register("class_weights", O.with_ctes(O.CUST, O.FEAT) + """
 , per AS (SELECT Exited AS label, count(*) AS rows FROM feat GROUP BY Exited)
 , tot AS (SELECT sum(rows) AS n, count(*) AS k FROM per)
 SELECT label, rows, round_even(n / (k * rows), 6) AS weight FROM per CROSS JOIN tot""")
def q_class_weights(spark, sf):
    return sp.class_weights(base.Plan(spark, sf).feat)


# --- F12b, C4, A10, R10 --------------------------------------------------------------
@register("serving_features", O.with_ctes(O.CUST) + f"""
 , c AS (SELECT RowNumber, CustomerId, {O.CODED_COLS}, Exited FROM cust)
 SELECT RowNumber, CustomerId, CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts, HasCrCard,
        IsActiveMember, EstimatedSalary, {O.engineered_sql(O.CLV_SERVING)}, Exited FROM c""")
def q_serving_features(spark, sf):
    return serving_features(base.cust(spark, sf))


def _serve_sql() -> str:
    return (O.with_ctes(*O.BASE_TO_PROB, O.sweep_ctes("prob"), O.requests_sql("cust")) + f"""
 , sv AS (SELECT CustomerId, {O.CODED_COLS} FROM req WHERE {O.valid_where()})
 , sf AS (SELECT CustomerId, CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts, HasCrCard,
                 IsActiveMember, EstimatedSalary, {O.engineered_sql(O.CLV_SERVING)} FROM sv)
 , sp AS (SELECT *, round_even(1.0e0 / (1.0e0 + exp(-{O.scorecard_logit_sql()})), 6) AS _p FROM sf)
 , att AS ({O.att_select('sp', O.term_means_sql('feat'))})
 , lng AS ({O.long_phi_sql('att')})
 , rk AS (SELECT *, row_number() OVER (PARTITION BY CustomerId ORDER BY abs(phi) DESC, feature_index DESC) AS rnk
          FROM lng)
 , fac AS (SELECT CustomerId, string_agg({O.factor_text_sql(False)}, ' | ' ORDER BY rnk) AS top_risk_factors
           FROM rk WHERE rnk <= 3 GROUP BY CustomerId)
 , resp AS (
   SELECT sp.CustomerId, round_even(_p, 4) AS churn_probability,
          CAST(_p >= biz_threshold AS INTEGER) AS churn_prediction, {O.risk_sql('_p')} AS risk_level,
          round_even(clv_estimated * _p * 0.3e0, 2) AS retention_value_eur, fac.top_risk_factors,
          {O.action_text_sql(O.action_code_sql())} AS recommended_action,
          'scorecard-2.0.0' AS model_version, biz_threshold AS threshold_used, true AS business_optimal
   FROM sp JOIN fac ON sp.CustomerId = fac.CustomerId CROSS JOIN biz)""")


def _responses(spark, sf):
    plan = base.Plan(spark, sf)
    resp, _ = serve.score_requests(requests_from_base(plan.cust), plan.biz, background=plan.feat, legacy=True)
    return resp


@register("batch_scores", _serve_sql() + " SELECT * FROM resp")
def q_batch_scores(spark, sf):
    r = _responses(spark, sf)
    return r.withColumn("top_risk_factors", F.array_join("top_risk_factors", " | "))


@register("batch_summary", _serve_sql() + f"""
 SELECT count(*) AS total, count(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk,
        count(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk,
        count(*) - count(*) FILTER (WHERE risk_level = 'HIGH') - count(*) FILTER (WHERE risk_level = 'MEDIUM')
          AS low_risk, {O.msum('retention_value_eur')} AS total_retention_value_at_risk FROM resp""")
def q_batch_summary(spark, sf):
    return serve.batch_summary(_responses(spark, sf))


PROFILE_ID = 10000042


@register("customer_profile", _serve_sql() + f"""
 , con AS (SELECT CustomerId, string_agg(feature || ':' || printf('%.6f', phi + 0.0e0), '|' ORDER BY rnk) AS contributions
           FROM rk WHERE rnk <= 10 GROUP BY CustomerId)
 , rea AS (SELECT CustomerId, string_agg(CASE WHEN phi > 0 THEN '\u2191 ' ELSE '\u2193 ' END || split_part({O.factor_text_sql(False)}, ' (', 1), ' | ' ORDER BY rnk) AS reasons
           FROM rk WHERE rnk <= 3 GROUP BY CustomerId)
 SELECT c.CustomerId, c.Geography, c.Gender, c.Age, c.CreditScore, c.Tenure, c.Balance, c.NumOfProducts,
        c.IsActiveMember, c.EstimatedSalary, sf.clv_estimated, r.churn_probability, r.retention_value_eur,
        r.risk_level, r.recommended_action, r.top_risk_factors, con.contributions, rea.reasons,
        'This customer has a ' || printf('%.1f%%', round_even(r.churn_probability * 100, 1)) || ' probability of leaving within 30 days.' AS headline
 FROM cust c JOIN sf ON c.CustomerId = sf.CustomerId JOIN resp r ON c.CustomerId = r.CustomerId
      JOIN con ON c.CustomerId = con.CustomerId JOIN rea ON c.CustomerId = rea.CustomerId
 WHERE c.CustomerId = {PROFILE_ID}""")
def q_customer_profile(spark, sf):
    plan = base.Plan(spark, sf)
    cust = plan.cust.where(F.col("CustomerId") == PROFILE_ID)
    resp, _ = serve.score_requests(cust.select(*[c for c in cust.columns if c != "Exited"]), plan.biz,
                                   background=plan.feat, legacy=True)
    return serve.customer_profile(cust, resp, plan.feat)
