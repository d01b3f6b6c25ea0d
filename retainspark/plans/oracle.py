"""ANSI/DuckDB twins of the catalog queries, composed from CTE fragments.

Literals are written as ``0.2e0`` so neither engine picks DECIMAL; rounding
uses ``round_even`` to match Spark's ``bround``.
"""

from __future__ import annotations

from ..schema import (ACTIONS, AGE_GROUP_LABELS, CLV_SERVING, CLV_TRAINING, CREDIT_LABELS, FEATURES,
                      GENDER_LABELS, GEOGRAPHY_LABELS, RISK_LABELS, SCORECARD_INTERCEPT, SCORECARD_WEIGHTS,
                      TENURE_LABELS, THRESHOLD_GRID, THRESHOLD_GRID_RAW)


def f(x: float) -> str:
    return repr(float(x)) + ("e0" if "e" not in repr(float(x)) else "")


def _case_map(col: str, mapping: dict, quote_keys: bool = False) -> str:
    parts = []
    for k, v in mapping.items():
        key = f"'{k}'" if quote_keys else str(k)
        val = f"'{v}'" if isinstance(v, str) else str(v)
        parts.append(f"WHEN {col} = {key} THEN {val}")
    return "CASE " + " ".join(parts) + " END"


def _q(s: str) -> str:
    return s.replace("'", "''")


CUST = """
cust_o AS (
  SELECT o_custkey,
         count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2000-07-01') AS n,
         count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2000-07-01' AND o_orderdate >= TIMESTAMP '1999-01-01') AS n_recent,
         min(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '2000-07-01') AS d0,
         max(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '2000-07-01') AS d1,
         sum(CAST(round(o_totalprice * 100, 0) AS BIGINT)) FILTER (WHERE o_orderdate < TIMESTAMP '2000-07-01') AS cents,
         count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-07-01') AS after_n
  FROM orders GROUP BY o_custkey
), cust AS (
  SELECT CAST(c_custkey + 1 AS BIGINT) AS RowNumber,
         CAST(c_custkey + 10000000 AS BIGINT) AS CustomerId,
         c_name AS Surname,
         CAST(300 + least(550, coalesce(cents, 0) // greatest(coalesce(n, 0), 1) // 70000) AS INTEGER) AS CreditScore,
         CASE c_nationkey % 3 WHEN 0 THEN 'France' WHEN 1 THEN 'Germany' ELSE 'Spain' END AS Geography,
         CASE c_nationkey % 2 WHEN 0 THEN 'Male' ELSE 'Female' END AS Gender,
         CAST(18 + least(77, greatest(0, floor((c_acctbal + 1000) / 143))) AS INTEGER) AS Age,
         CAST(least(10, coalesce(date_diff('day', CAST(d0 AS DATE), DATE '2000-07-01') // 180, 0)) AS INTEGER) AS Tenure,
         CAST(CASE WHEN c_acctbal < 2500 THEN 0.0e0 ELSE round((c_acctbal - 2500) * 33, 2) END AS DOUBLE) AS Balance,
         CAST(least(4, greatest(1, coalesce(n_recent, 0))) AS INTEGER) AS NumOfProducts,
         CAST(CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD') THEN 1 ELSE 0 END AS INTEGER) AS HasCrCard,
         CAST(CASE WHEN d1 >= TIMESTAMP '2000-01-01' THEN 1 ELSE 0 END AS INTEGER) AS IsActiveMember,
         10000.0e0 + CAST(least(19000000, coalesce(cents, 0) // 24) AS DOUBLE) / 100 AS EstimatedSalary,
         CAST(coalesce(after_n, 0) = 0 AS INTEGER) AS Exited
  FROM customer LEFT JOIN cust_o ON c_custkey = o_custkey
)"""


def bins_sql(col: str, edges: list) -> str:
    parts = [f"WHEN {col} > {edges[i]} AND {col} <= {edges[i + 1]} THEN {i}" for i in range(len(edges) - 1)]
    return "CAST(CASE " + " ".join(parts) + " END AS INTEGER)"


def clv_sql(p: dict) -> str:
    raw = (f"EstimatedSalary * {f(p['salary'])} * (1.0e0 + NumOfProducts * {f(p['product'])})"
           f" * (1.0e0 + Tenure * {f(p['tenure'])}) + Balance * {f(p['balance'])} / 1000"
           f" + (CreditScore - 300) / 550 * {f(p['credit'])}")
    return f"round_even(greatest({f(p['lo'])}, least({f(p['hi'])}, {raw})), 2)"


def engineered_sql(clv_profile: dict = CLV_TRAINING, hv: str = "CAST(0 AS INTEGER)") -> str:
    return f"""Balance / (EstimatedSalary + 1) AS balance_salary_ratio,
         NumOfProducts / (Tenure + 1) AS products_per_year,
         {bins_sql('Age', [0, 30, 45, 60, 200])} AS age_group,
         round_even(IsActiveMember * 0.5e0 + HasCrCard * 0.2e0 + least(NumOfProducts / 4, 1.0e0) * 0.3e0, 4) AS engagement_score,
         {bins_sql('CreditScore', [0, 579, 669, 739, 799, 900])} AS credit_score_band,
         CAST(Balance = 0 AS INTEGER) AS is_zero_balance,
         {hv} AS high_value_customer,
         {bins_sql('Tenure', [-1, 2, 5, 20])} AS tenure_stability,
         Age / (Tenure + 1) AS age_tenure_ratio,
         CAST(IsActiveMember = 0 AND Balance > 50000 AS INTEGER) AS inactive_high_balance,
         {clv_sql(clv_profile)} AS clv_estimated"""


CODED_COLS = """CreditScore,
         CAST(CASE Geography WHEN 'France' THEN 0 WHEN 'Germany' THEN 1 WHEN 'Spain' THEN 2 END AS INTEGER) AS Geography,
         CAST(CASE Gender WHEN 'Female' THEN 0 WHEN 'Male' THEN 1 END AS INTEGER) AS Gender,
         Age, Tenure, Balance, NumOfProducts, HasCrCard, IsActiveMember, EstimatedSalary"""

FEAT = f"""
feat_q AS (
  SELECT quantile_cont(Balance, 0.75) AS q_balance, quantile_cont(EstimatedSalary, 0.75) AS q_salary FROM cust
), feat_c AS (
  SELECT RowNumber, CustomerId, {CODED_COLS}, Exited FROM cust
), feat AS (
  SELECT RowNumber, CustomerId, CreditScore, Geography, Gender, Age, Tenure, Balance, NumOfProducts,
         HasCrCard, IsActiveMember, EstimatedSalary,
         {engineered_sql(CLV_TRAINING, "CAST(Balance > q_balance AND EstimatedSalary > q_salary AS INTEGER)")},
         Exited
  FROM feat_c CROSS JOIN feat_q
)"""


def scorecard_logit_sql() -> str:
    w = SCORECARD_WEIGHTS
    terms = [
        ("germany", "Geography = 1"), ("inactive", "IsActiveMember = 0"), ("age_over_60", "Age > 60"),
        ("age_over_45", "Age > 45"), ("inactive_high_balance", "IsActiveMember = 0 AND Balance > 50000"),
        ("products_3_plus", "NumOfProducts >= 3"), ("tenure_2_or_less", "Tenure <= 2"),
        ("credit_below_580", "CreditScore < 580"),
    ]
    s = f(SCORECARD_INTERCEPT)
    for name, cond in terms:
        s = f"({s} + CAST(coalesce({cond}, false) AS INTEGER) * {f(w[name])})"
    return s


PROB = f"""
prob AS (
  SELECT *, round_even(1.0e0 / (1.0e0 + exp(-{scorecard_logit_sql()})), 6) AS churn_probability FROM feat
)"""


def grid_values() -> str:
    rows = ", ".join(f"({j}, {f(THRESHOLD_GRID_RAW[j])}, {f(THRESHOLD_GRID[j])})" for j in range(len(THRESHOLD_GRID)))
    return f"SELECT * FROM (VALUES {rows}) g(j, t_raw, threshold)"


def sweep_ctes(src: str, success: float = 0.3, cost: float = 10.0) -> str:
    return f"""
sw_grid AS ({grid_values()}),
sw_tot AS (
  SELECT sum(Exited) AS P, count(*) - sum(Exited) AS N,
         sum(CAST(round(clv_estimated * 100, 0) AS BIGINT)) AS cents FROM {src}
), sw_cnt AS (
  SELECT g.j, g.t_raw, g.threshold,
         count(s.Exited) FILTER (WHERE s.churn_probability >= g.t_raw AND s.Exited = 1) AS tp,
         count(s.Exited) FILTER (WHERE s.churn_probability >= g.t_raw AND s.Exited = 0) AS fp,
         count(s.Exited) FILTER (WHERE s.churn_probability >= g.threshold AND s.Exited = 1) AS tp_r,
         count(s.Exited) FILTER (WHERE s.churn_probability >= g.threshold AND s.Exited = 0) AS fp_r
  FROM sw_grid g LEFT JOIN {src} s ON true
  GROUP BY g.j, g.t_raw, g.threshold
), sw AS (
  SELECT j, t_raw, threshold, tp, fp, tp + fp AS outreach,
         tp * (CAST(cents AS DOUBLE) / 100.0e0 / (P + N)) * {f(success)} AS revenue,
         (tp + fp) * {f(cost)} AS cost,
         tp * (CAST(cents AS DOUBLE) / 100.0e0 / (P + N)) * {f(success)} - (tp + fp) * {f(cost)} AS net_value,
         CASE WHEN tp_r + fp_r + P = 0 THEN 0.0e0 ELSE 2 * tp_r / (tp_r + fp_r + P) END AS f1,
         CASE WHEN tp + fp + P = 0 THEN 0.0e0 ELSE 2 * tp / (tp + fp + P) END AS f1_at_raw,
         P, N
  FROM sw_cnt CROSS JOIN sw_tot
), biz AS (
  SELECT threshold AS biz_threshold FROM sw ORDER BY net_value DESC, j ASC LIMIT 1
)"""


def action_code_sql() -> str:
    return """CAST(CASE WHEN coalesce(inactive_high_balance, 0) = 1 THEN 1
              WHEN coalesce(is_zero_balance, 0) = 1 THEN 2
              WHEN coalesce(engagement_score, 1.0e0) < 0.3e0 THEN 3
              WHEN coalesce(Age, 0) > 55 THEN 4
              WHEN coalesce(NumOfProducts, 0) >= 3 THEN 5 ELSE 6 END AS INTEGER)"""


def action_text_sql(code: str = "action_code") -> str:
    return "CASE " + " ".join(f"WHEN {code} = {k} THEN '{_q(v)}'" for k, v in ACTIONS.items()) + " END"


def risk_sql(p: str = "churn_probability") -> str:
    return f"CASE WHEN {p} >= 0.6e0 THEN 'HIGH' WHEN {p} >= 0.35e0 THEN 'MEDIUM' ELSE 'LOW' END"


SCORED = f"""
scored0 AS (
  SELECT prob.*, CAST(churn_probability >= biz_threshold AS INTEGER) AS churn_prediction,
         round_even(clv_estimated * churn_probability * 0.3e0, 2) AS retention_value,
         {risk_sql()} AS risk_level,
         {action_code_sql()} AS action_code
  FROM prob CROSS JOIN biz
), scored AS (
  SELECT *, {action_text_sql()} AS recommended_action,
         {_case_map('Geography', GEOGRAPHY_LABELS)} AS Geography_Label,
         {_case_map('Gender', GENDER_LABELS)} AS Gender_Label,
         {_case_map('age_group', AGE_GROUP_LABELS)} AS Age_Group_Label,
         {_case_map('tenure_stability', TENURE_LABELS)} AS Tenure_Label,
         {_case_map('credit_score_band', CREDIT_LABELS)} AS Credit_Label
  FROM scored0
)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


BASE_TO_PROB = (CUST, FEAT, PROB)
BASE_TO_SCORED = (CUST, FEAT, PROB, sweep_ctes("prob"), SCORED)

def msum(x: str) -> str:
    return f"CAST(coalesce(sum(CAST(round({x} * 100, 0) AS BIGINT)), 0) AS DOUBLE) / 100.0e0"


def mavg(x: str, digits: int = 4) -> str:
    return f"round_even(CAST(sum(CAST(round({x} * 100, 0) AS BIGINT)) AS DOUBLE) / 100.0e0 / count({x}), {digits})"


def div0(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) = 0 THEN 0.0e0 ELSE CAST({n} AS DOUBLE) / ({d}) END"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return f"'{_q(v)}'"
    if isinstance(v, float):
        return f(v)
    return str(v)


def requests_sql(src: str = "cust") -> str:
    """Twin of sources.requests.requests_from_base as a CTE named ``req``."""
    from ..schema import REQUEST_SCHEMA
    from ..sources.requests import DEFECTS
    sqltype = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR"}
    cols = []
    for fld in REQUEST_SCHEMA.fields:
        whens = [f"WHEN _k = {code} THEN {_lit(v)}" for code, (field, v) in DEFECTS.items() if field == fld.name]
        expr = f"CASE {' '.join(whens)} ELSE {fld.name} END" if whens else fld.name
        cols.append(f"CAST({expr} AS {sqltype[type(fld.dataType).__name__]}) AS {fld.name}")
    return f"req AS (SELECT {', '.join(cols)} FROM (SELECT *, (RowNumber * 37) % 101 AS _k FROM {src}))"


CONTRACT_SQL = {
    "CreditScore_range": "CreditScore BETWEEN 300 AND 850",
    "Age_range": "Age BETWEEN 18 AND 95",
    "Tenure_range": "Tenure BETWEEN 0 AND 10",
    "NumOfProducts_range": "NumOfProducts BETWEEN 1 AND 4",
    "HasCrCard_range": "HasCrCard BETWEEN 0 AND 1",
    "IsActiveMember_range": "IsActiveMember BETWEEN 0 AND 1",
    "Balance_range": "Balance >= 0",
    "EstimatedSalary_range": "EstimatedSalary > 0",
    "Geography_value": "Geography IN ('France', 'Germany', 'Spain')",
    "Gender_value": "Gender IN ('Female', 'Male')",
}


def valid_where() -> str:
    return " AND ".join(f"coalesce({c}, false)" for c in CONTRACT_SQL.values())


# scorecard terms over coded columns, and which feature each is attributed to
TERM_SQL = {
    "germany": "Geography = 1", "inactive": "IsActiveMember = 0", "age_over_60": "Age > 60",
    "age_over_45": "Age > 45", "inactive_high_balance": "IsActiveMember = 0 AND Balance > 50000",
    "products_3_plus": "NumOfProducts >= 3", "tenure_2_or_less": "Tenure <= 2",
    "credit_below_580": "CreditScore < 580",
}


def term_means_sql(src: str) -> str:
    cols = ", ".join(f"CAST(sum(CAST(coalesce({c}, false) AS INTEGER)) AS DOUBLE) / count(*) AS m_{n}"
                     for n, c in TERM_SQL.items())
    return f"SELECT {cols} FROM {src}"


def phi_sql(feature: str) -> str:
    from ..functions.scorecard import TERM_FEATURES
    names = TERM_FEATURES.get(feature)
    if not names:
        return "0.0e0"
    parts = [f"{f(SCORECARD_WEIGHTS[n])} * (CAST(coalesce({TERM_SQL[n]}, false) AS INTEGER) - m_{n})" for n in names]
    expr = parts[0]
    for p in parts[1:]:
        expr = f"({expr} + {p})"
    return f"round_even({expr}, 6)"


def att_select(src: str, means: str) -> str:
    phis = ", ".join(f"{phi_sql(x)} AS phi_{x}" for x in FEATURES)
    return f"SELECT {src}.*, {phis} FROM {src} CROSS JOIN ({means}) bgm"


def long_phi_sql(src: str, id_col: str = "CustomerId") -> str:
    return " UNION ALL ".join(
        f"SELECT {id_col}, {i} AS feature_index, '{x}' AS feature, phi_{x} AS phi FROM {src}"
        for i, x in enumerate(FEATURES))


def feature_label_case(col: str = "feature") -> str:
    labels = {x: RISK_LABELS.get(x, x.replace("_", " ").title()) for x in FEATURES}
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{_q(v)}'" for k, v in labels.items()) + " END"


def factor_text_sql(with_magnitude: bool) -> str:
    direction = "CASE WHEN phi > 0 THEN 'increases' ELSE 'decreases' END"
    if with_magnitude:
        return (f"{feature_label_case()} || ' (' || {direction} || ' risk, magnitude=' "
                f"|| printf('%.3f', round_even(abs(phi), 3)) || ')'")
    return f"{feature_label_case()} || ' (' || {direction} || ' risk)'"
