"""The deterministic scorecard (a logistic formula over indicators).

Terms are attributed to named model features so the linear Shapley operator
(X1) can explain the score in the model's own vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SCORECARD_INTERCEPT, SCORECARD_WEIGHTS


def _ind(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def scorecard_terms(germany: Column | None = None) -> dict[str, Column]:
    """Indicator terms (0/1 ints) over the feature table (codes) columns.

    ``germany`` overrides the Germany test (e.g. on raw string Geography)."""
    inactive = F.col("IsActiveMember") == 0
    germany = F.col("Geography") == 1 if germany is None else germany
    return {
        "germany": _ind(germany),
        "inactive": _ind(inactive),
        "age_over_60": _ind(F.col("Age") > 60),
        "age_over_45": _ind(F.col("Age") > 45),
        "inactive_high_balance": _ind(inactive & (F.col("Balance") > 50000)),
        "products_3_plus": _ind(F.col("NumOfProducts") >= 3),
        "tenure_2_or_less": _ind(F.col("Tenure") <= 2),
        "credit_below_580": _ind(F.col("CreditScore") < 580),
    }


# Which model feature each scorecard term is attributed to (feature, term list)
TERM_FEATURES = {
    "Geography": ["germany"],
    "IsActiveMember": ["inactive"],
    "Age": ["age_over_60", "age_over_45"],
    "inactive_high_balance": ["inactive_high_balance"],
    "NumOfProducts": ["products_3_plus"],
    "tenure_stability": ["tenure_2_or_less"],
    "credit_score_band": ["credit_below_580"],
}


def feature_contributions(germany: Column | None = None) -> dict[str, Column]:
    """Weighted term sum per attributed feature (doubles)."""
    terms = scorecard_terms(germany)
    out = {}
    for feat, names in TERM_FEATURES.items():
        expr = None
        for n in names:
            part = terms[n] * F.lit(SCORECARD_WEIGHTS[n])
            expr = part if expr is None else expr + part
        out[feat] = expr
    return out


def scorecard_logit(germany: Column | None = None) -> Column:
    terms = scorecard_terms(germany)
    expr = F.lit(SCORECARD_INTERCEPT)
    for name, w in SCORECARD_WEIGHTS.items():
        expr = expr + terms[name] * F.lit(w)
    return expr


def scorecard_probability(germany: Column | None = None) -> Column:
    """p = 1 / (1 + exp(-logit)), rounded half-even to 6 digits."""
    return F.bround(F.lit(1.0) / (F.lit(1.0) + F.exp(-scorecard_logit(germany))), 6)
