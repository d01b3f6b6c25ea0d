"""Column expressions for the feature projection.

Each function returns a ``Column``; callers put them into one ``select`` so
the whole feature table is a single codegen'd projection (no shuffle).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (ACTIONS, AGE_GROUP_LABELS, CLV_TRAINING, CREDIT_LABELS, GENDER_CODES,
                      GENDER_LABELS, GEOGRAPHY_CODES, GEOGRAPHY_LABELS, HIGH_BALANCE, RISK_HIGH,
                      RISK_MEDIUM, RETENTION_SUCCESS_RATE, TENURE_LABELS)


def lookup(mapping: dict, c: Column) -> Column:
    """Literal map lookup; unknown keys give null."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return m[c]


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


# F1 ------------------------------------------------------------------------
def geography_code(c: str | Column = "Geography") -> Column:
    return lookup(GEOGRAPHY_CODES, _c(c)).cast("int")


def gender_code(c: str | Column = "Gender") -> Column:
    return lookup(GENDER_CODES, _c(c)).cast("int")


# F2, F3, F10 ---------------------------------------------------------------
def balance_salary_ratio() -> Column:
    return F.col("Balance") / (F.col("EstimatedSalary") + 1)


def products_per_year() -> Column:
    return F.col("NumOfProducts") / (F.col("Tenure") + 1)


def age_tenure_ratio() -> Column:
    return F.col("Age") / (F.col("Tenure") + 1)


# right-closed bins; outside every bin gives null ---------------
def right_closed_bins(c: Column, edges: list[float]) -> Column:
    """Code i for edges[i] < x <= edges[i+1] (like pandas cut, right=True)."""
    expr = None
    for i in range(len(edges) - 1):
        cond = (c > edges[i]) & (c <= edges[i + 1])
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.cast("int")


# Bin edges
AGE_EDGES = [0, 30, 45, 60, 200]
CREDIT_EDGES = [0, 579, 669, 739, 799, 900]
TENURE_EDGES = [-1, 2, 5, 20]


def age_group() -> Column:
    return right_closed_bins(F.col("Age"), AGE_EDGES)


def credit_score_band() -> Column:
    return right_closed_bins(F.col("CreditScore"), CREDIT_EDGES)


def tenure_stability() -> Column:
    return right_closed_bins(F.col("Tenure"), TENURE_EDGES)


# F5 ------------------------------------------------------------------------
def engagement_score() -> Column:
    return F.bround(F.col("IsActiveMember") * 0.5 + F.col("HasCrCard") * 0.2
                    + F.least(F.col("NumOfProducts") / 4, F.lit(1.0)) * 0.3, 4)


# F7, F11 -------------------------------------------------------------------
def is_zero_balance() -> Column:
    return (F.col("Balance") == 0).cast("int")


def inactive_high_balance() -> Column:
    return ((F.col("IsActiveMember") == 0) & (F.col("Balance") > HIGH_BALANCE)).cast("int")


# F8 ------------------------------------------------------------------------
def high_value_customer(balance_q75: Column, salary_q75: Column) -> Column:
    return ((F.col("Balance") > balance_q75) & (F.col("EstimatedSalary") > salary_q75)).cast("int")


# F12a / F12b ---------------------------------------------------------------
def clv(profile: dict = CLV_TRAINING) -> Column:
    """Clipped, rounded customer-lifetime-value estimate for a coefficient profile."""
    base = F.col("EstimatedSalary") * profile["salary"]
    prod = F.lit(1.0) + F.col("NumOfProducts") * profile["product"]
    ten = F.lit(1.0) + F.col("Tenure") * profile["tenure"]
    bal = F.col("Balance") * profile["balance"] / 1000
    cred = (F.col("CreditScore") - 300) / 550 * profile["credit"]
    raw = base * prod * ten + bal + cred
    return F.bround(F.greatest(F.lit(profile["lo"]), F.least(F.lit(profile["hi"]), raw)), 2)


# F15 -----------------------------------------------------------------------
def decode_labels() -> dict[str, Column]:
    return {
        "Geography_Label": lookup(GEOGRAPHY_LABELS, F.col("Geography")),
        "Gender_Label": lookup(GENDER_LABELS, F.col("Gender")),
        "Age_Group_Label": lookup(AGE_GROUP_LABELS, F.col("age_group")),
        "Tenure_Label": lookup(TENURE_LABELS, F.col("tenure_stability")),
        "Credit_Label": lookup(CREDIT_LABELS, F.col("credit_score_band")),
    }


# F16 -----------------------------------------------------------------------
def risk_level(p: str | Column = "churn_probability") -> Column:
    p = _c(p)
    return F.when(p >= RISK_HIGH, "HIGH").when(p >= RISK_MEDIUM, "MEDIUM").otherwise("LOW")


# F17 -----------------------------------------------------------------------
def retention_value(p: str | Column = "churn_probability", clv_col: str | Column = "clv_estimated",
                    success_rate: float = RETENTION_SUCCESS_RATE) -> Column:
    return F.bround(_c(clv_col) * _c(p) * success_rate, 2)


# F18 -----------------------------------------------------------------------
def prediction(threshold: float | Column, p: str | Column = "churn_probability") -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_c(p) >= t).cast("int")


# F19 -----------------------------------------------------------------------
def action_code() -> Column:
    """First matching rule 1..6; missing inputs count as 0 (engagement as 1.0)."""
    ihb = F.coalesce(F.col("inactive_high_balance"), F.lit(0))
    zb = F.coalesce(F.col("is_zero_balance"), F.lit(0))
    eng = F.coalesce(F.col("engagement_score"), F.lit(1.0))
    age = F.coalesce(F.col("Age"), F.lit(0))
    prods = F.coalesce(F.col("NumOfProducts"), F.lit(0))
    return (F.when(ihb == 1, 1).when(zb == 1, 2).when(eng < 0.3, 3)
            .when(age > 55, 4).when(prods >= 3, 5).otherwise(6)).cast("int")


def action_text(code: str | Column = "action_code") -> Column:
    return lookup(ACTIONS, _c(code))


def feature_label(name: Column) -> Column:
    """Display label of a feature name: fixed map, else '_'->' ' title case."""
    from ..schema import RISK_LABELS
    return F.coalesce(lookup(RISK_LABELS, name), F.initcap(F.regexp_replace(name, "_", " ")))
