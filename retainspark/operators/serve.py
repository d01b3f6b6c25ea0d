"""C4: single / batch customer scoring as one set-at-a-time plan.

requests -> contract (V5) -> serving features (F12b; F8 = 0 unless stored
quantiles are given) -> probability -> prediction at the threshold, risk
level, retention value, top-3 factors, action, model version.  Invalid rows
go to quarantine with their violations instead of failing the batch, and
there is no 500-row cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display
from ..functions import features as fx
from ..operators.explain import contributions, factor_array, factors_of, linear_shapley, sampled_shapley, scorecard_shapley, with_fallback
from ..operators.features import high_value_quantiles, serving_features
from ..operators.quality import split_valid
from ..operators.scoring import score_model, score_scorecard
from ..operators.train import is_linear, linear_weights
from ..schema import MODEL_VERSION_SUFFIX
from ..sources.files import explainer_weights
from ..sources.published import Published


def explained(probs: DataFrame, model=None, explainer: DataFrame | None = None, background: DataFrame | None = None,
              means: DataFrame | None = None, id_col: str = "CustomerId") -> DataFrame:
    """``probs`` plus ``top_risk_factors`` of what gave the probabilities:

    * the scorecard (no model): X1 on its terms;
    * a model with a stored explainer (S8): X1 with its weights and means, or X2
      over its background sample;
    * a linear model with a background: X1 with the model's own weights;
    * any other model with a background: X2;
    * else the fallback list (X6)."""
    if model is None:
        if means is None and background is None:
            return with_fallback(probs, None, id_col)
        att = scorecard_shapley(probs, background, means)
    elif explainer is not None and "bvec" in explainer.columns:
        return with_fallback(probs, factors_of(sampled_shapley(model, probs, explainer, id_col=id_col), 3, id_col), id_col)
    elif explainer is not None:
        rows = explainer_weights(explainer).collect()             # one row per feature
        if not rows:
            return with_fallback(probs, None, id_col)
        att = linear_shapley(probs, {r["feature"]: r["weight"] for r in rows}, means={r["feature"]: r["background_mean"] for r in rows})
    elif background is None:
        return with_fallback(probs, None, id_col)
    elif is_linear(model):
        att = linear_shapley(probs, linear_weights(model), background)
    else:
        return with_fallback(probs, factors_of(sampled_shapley(model, probs, background, id_col=id_col), 3, id_col), id_col)
    return att.withColumn("top_risk_factors", factor_array(3, with_magnitude=False))


def score_requests(requests: DataFrame, threshold, background: DataFrame | None = None, model=None,
                   model_name: str = "scorecard", quantiles=None,
                   legacy: bool = False, id_col: str = "CustomerId",
                   means: DataFrame | None = None, explainer: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (responses, quarantined).  ``threshold`` is a float or a
    one-row DataFrame; ``background`` is the training feature table the
    attributions are measured against (or pass its precomputed ``means``).
    With ``model`` the reasons are the model's own, see ``explained``.

    high_value_customer: by default from the training quantiles (``quantiles``,
    else computed once from ``background``); ``legacy=True`` keeps the
    original serving constant 0."""
    valid, quarantined = split_valid(requests)
    if not legacy and quantiles is None:
        if background is None:
            raise ValueError("pass quantiles or a background table, or legacy=True")
        r = high_value_quantiles(background).first()          # one row
        quantiles = (r["q_balance"], r["q_salary"])
    feat = serving_features(valid, quantiles, legacy=legacy)
    probs = score_model(model, feat, "_p") if model is not None else score_scorecard(feat, "_p")
    att = explained(probs, model, explainer, background, means, id_col)
    if isinstance(threshold, DataFrame):
        t = threshold.select(F.col(threshold.columns[0]).cast("double").alias("threshold_used"))
        att = att.crossJoin(F.broadcast(t))
    else:
        att = att.withColumn("threshold_used", F.lit(float(threshold)))
    out = att.select(
        F.col(id_col),
        F.bround("_p", 4).alias("churn_probability"),
        (F.col("_p") >= F.col("threshold_used")).cast("int").alias("churn_prediction"),
        fx.risk_level("_p").alias("risk_level"),
        fx.retention_value("_p").alias("retention_value_eur"),
        "top_risk_factors",
        fx.action_text(fx.action_code()).alias("recommended_action"),
        F.lit(f"{model_name}-{MODEL_VERSION_SUFFIX}").alias("model_version"),
        F.col("threshold_used"),
        F.lit(True).alias("business_optimal"),
    )
    return out, quarantined


def score_published(requests: DataFrame, published: Published) -> tuple[DataFrame, DataFrame]:
    """(responses, quarantined) by what is published (``load_published``), without
    the training table: the model or else the scorecard, its explainer or else the
    fallback reasons, its threshold or else the default."""
    return score_requests(requests, published.business_threshold, model=published.model, model_name=published.name,
                          quantiles=published.quantiles, legacy=published.quantiles is None, explainer=published.explainer)


#: Attributes shown beside a customer's scores.
PROFILE_COLUMNS = ["CustomerId", "Geography", "Gender", "Age", "CreditScore", "Tenure", "Balance", "NumOfProducts", "IsActiveMember", "EstimatedSalary"]


def customer_profile(cust: DataFrame, responses: DataFrame, background: DataFrame) -> DataFrame:
    """Attributes, CLV, score, action, the three reasons as listed (arrow and
    name), the ten largest contributions (X4) and the sentence above them."""
    feat = serving_features(cust, legacy=True)
    ten = scorecard_shapley(feat, background).withColumn("_c", contributions(10))
    ten = ten.select("CustomerId", "clv_estimated", F.array_join(F.transform(
        "_c", lambda s: F.concat(s["feature"], F.lit(":"), F.format_string("%.6f", s["phi"] + F.lit(0.0)))), "|").alias("contributions"))
    reasons = F.transform("top_risk_factors", lambda f: F.concat(display.direction(f), F.lit(" "), display.before(f, " (")))
    headline = F.concat(F.lit("This customer has a "), display.percent(F.col("churn_probability")), F.lit(" probability of leaving within 30 days."))
    return (cust.select(*PROFILE_COLUMNS).join(ten, "CustomerId").join(responses, "CustomerId")
            .select(*PROFILE_COLUMNS, "clv_estimated", "churn_probability", "retention_value_eur", "risk_level", "recommended_action",
                    F.array_join("top_risk_factors", " | ").alias("top_risk_factors"), "contributions",
                    F.array_join(reasons, " | ").alias("reasons"), headline.alias("headline")))


def batch_summary(responses: DataFrame) -> DataFrame:
    """A10 over responses (retention value in the response's own column)."""
    from .reports import batch_summary as _bs
    return _bs(responses, rv="retention_value_eur")
