"""Feature table (F1-F14) and the train/serve skew report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from ..schema import CLV_SERVING, CLV_TRAINING, FEATURES, ID_COLS, LABEL
from .quantile import column_quantiles

def coded(raw: DataFrame) -> DataFrame:
    """categorical codes; other raw columns pass through (V6: absent ids skipped)."""
    keep_ids = [c for c in ID_COLS if c in raw.columns]
    label = [F.col(LABEL).cast("int").alias(LABEL)] if LABEL in raw.columns else []
    return raw.select(
        *keep_ids,
        F.col("CreditScore").cast("int").alias("CreditScore"),
        fx.geography_code().alias("Geography"),
        fx.gender_code().alias("Gender"),
        *[F.col(c) for c in ["Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember",
                             "EstimatedSalary"]],
        *label,
    )


def high_value_quantiles(raw: DataFrame) -> DataFrame:
    """One-row table (q_balance, q_salary): 75 % quantiles, linear interpolation."""
    return column_quantiles(raw, {"Balance": "q_balance", "EstimatedSalary": "q_salary"}, 0.75)


def engineered_columns(clv_profile: dict = CLV_TRAINING, hv=None) -> list:
    """F2-F12 in model order; ``hv`` is the high_value_customer column."""
    hv = F.lit(0).cast("int") if hv is None else hv
    return [
        fx.balance_salary_ratio().alias("balance_salary_ratio"),
        fx.products_per_year().alias("products_per_year"),
        fx.age_group().alias("age_group"),
        fx.engagement_score().alias("engagement_score"),
        fx.credit_score_band().alias("credit_score_band"),
        fx.is_zero_balance().alias("is_zero_balance"),
        hv.alias("high_value_customer"),
        fx.tenure_stability().alias("tenure_stability"),
        fx.age_tenure_ratio().alias("age_tenure_ratio"),
        fx.inactive_high_balance().alias("inactive_high_balance"),
        fx.clv(clv_profile).alias("clv_estimated"),
    ]


def feature_table(raw: DataFrame, quantiles: DataFrame | None = None, clv_profile: dict = CLV_TRAINING) -> DataFrame:
    """F1-F12a + F14: ids, the 21 model features in order, label.

    The whole-table quantiles of F8 are a one-row aggregate joined back as a
    broadcast (size is one row by construction); pass ``quantiles`` to reuse
    stored training quantiles (e.g. when serving), either as that one-row
    DataFrame or as resolved ``(q_balance, q_salary)`` values (literals: the
    projection then needs no join at all)."""
    c = coded(raw)
    ids = [x for x in ID_COLS if x in raw.columns]
    label = [F.col(LABEL)] if LABEL in raw.columns else []
    if isinstance(quantiles, tuple):
        hv = fx.high_value_customer(F.lit(float(quantiles[0])), F.lit(float(quantiles[1])))
        return c.select(*ids, *[F.col(x) for x in FEATURES[:10]], *engineered_columns(clv_profile, hv), *label)
    q = quantiles if quantiles is not None else high_value_quantiles(raw)
    j = c.crossJoin(F.broadcast(q.select("q_balance", "q_salary")))
    hv = fx.high_value_customer(F.col("q_balance"), F.col("q_salary"))
    return j.select(*ids, *[F.col(x) for x in FEATURES[:10]], *engineered_columns(clv_profile, hv), *label)


def serving_features(raw: DataFrame, quantiles=None, legacy: bool = True) -> DataFrame:
    """F12b serving profile.  ``legacy=True`` (or no quantiles) keeps
    high_value_customer = 0 as the original serving code does; otherwise the
    stored training quantiles (one-row DataFrame or resolved values) are used."""
    c = coded(raw)
    ids = [x for x in ID_COLS if x in raw.columns]
    label = [F.col(LABEL)] if LABEL in raw.columns else []
    if legacy or quantiles is None:
        return c.select(*ids, *[F.col(x) for x in FEATURES[:10]], *engineered_columns(CLV_SERVING), *label)
    if isinstance(quantiles, tuple):
        hv = fx.high_value_customer(F.lit(float(quantiles[0])), F.lit(float(quantiles[1])))
        return c.select(*ids, *[F.col(x) for x in FEATURES[:10]], *engineered_columns(CLV_SERVING, hv), *label)
    j = c.crossJoin(F.broadcast(quantiles.select("q_balance", "q_salary")))
    hv = fx.high_value_customer(F.col("q_balance"), F.col("q_salary"))
    return j.select(*ids, *[F.col(x) for x in FEATURES[:10]], *engineered_columns(CLV_SERVING, hv), *label)


def train_serve_skew(raw: DataFrame) -> DataFrame:
    """gap between the training and serving CLV profiles and between the
    high-value flag and its serving constant 0, in one aggregate."""
    feat = feature_table(raw)
    gap = F.col("clv_serving") - F.col("clv_estimated")
    return (feat.select("clv_estimated", "high_value_customer", fx.clv(CLV_SERVING).alias("clv_serving"))
            .agg(F.count("*").alias("n"),
                 F.bround(F.avg(F.abs(gap)), 4).alias("mean_abs_clv_gap"),
                 F.bround(F.max(F.abs(gap)), 2).alias("max_abs_clv_gap"),
                 F.bround(F.avg("clv_estimated"), 4).alias("mean_clv_training"),
                 F.bround(F.avg("clv_serving"), 4).alias("mean_clv_serving"),
                 F.sum("high_value_customer").cast("long").alias("high_value_flag_lost")))
