"""Explanation queries on the scorecard: X1, X3, X4, X5, X7."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as xp
from . import base
from . import oracle as O
from .registry import register

ATT = O.with_ctes(*O.BASE_TO_PROB) + f"""
 , att AS ({O.att_select('prob', O.term_means_sql('prob'))})
 , lng AS ({O.long_phi_sql('att')})"""

CONTRIB_ID = 10000042


def _att(spark, sf):
    return xp.scorecard_shapley(base.Plan(spark, sf).prob)


@register("linear_shapley", ATT + " SELECT CustomerId, feature, feature_index, phi FROM lng")
def q_linear_shapley(spark, sf):
    return xp.long_attributions(_att(spark, sf))


@register("top_factors", ATT + f"""
 , rk AS (SELECT *, row_number() OVER (PARTITION BY CustomerId ORDER BY abs(phi) DESC, feature_index DESC) AS rank
          FROM lng)
 SELECT CustomerId, rank, feature, feature_index, phi, {O.factor_text_sql(True)} AS factor FROM rk WHERE rank <= 3""")
def q_top_factors(spark, sf):
    return xp.top_k(_att(spark, sf), 3).withColumn("rank", F.col("rank").cast("long"))


@register("top_contributions", ATT + f"""
 , rk AS (SELECT *, row_number() OVER (PARTITION BY CustomerId ORDER BY abs(phi) DESC, feature_index DESC) AS rank
          FROM lng WHERE CustomerId = {CONTRIB_ID})
 SELECT CustomerId, rank, feature, feature_index, phi FROM rk WHERE rank <= 10""")
def q_top_contributions(spark, sf):
    att = _att(spark, sf).where(F.col("CustomerId") == CONTRIB_ID)
    return (xp.top_k(att, 10).withColumn("rank", F.col("rank").cast("long"))
            .select("CustomerId", "rank", "feature", "feature_index", "phi"))


_IMP = """
 , imp AS (SELECT feature, feature_index, round_even(avg(abs(phi)), 6) AS mean_abs_shap FROM lng
           GROUP BY feature, feature_index)
 , top AS (SELECT * FROM imp ORDER BY mean_abs_shap DESC, feature_index LIMIT 15)"""


@register("global_importance", ATT + _IMP + " SELECT feature, feature_index, mean_abs_shap FROM top")
def q_global_importance(spark, sf):
    return xp.global_importance(_att(spark, sf))


def _values_sql() -> str:
    vals = " UNION ALL ".join(f"SELECT CustomerId, '{x}' AS feature, CAST({x} AS DOUBLE) AS value, phi_{x} AS phi"
                              f" FROM att" for x in O.FEATURES)
    return ATT + _IMP + f" , vals AS ({vals}) SELECT CustomerId, feature, value, phi FROM vals" \
                        f" WHERE feature IN (SELECT feature FROM top)"


@register("attribution_values", _values_sql())
def q_attribution_values(spark, sf):
    return xp.attribution_values(_att(spark, sf)).select("CustomerId", "feature", "value", "phi")
