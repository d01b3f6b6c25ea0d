"""Scoring: C1 scorecard, C2 model scores, C3 scored-table build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions.scorecard import scorecard_probability


def score_scorecard(feat: DataFrame, out: str = "churn_probability") -> DataFrame:
    """Deterministic scorecard probability (a projection)."""
    return feat.withColumn(out, scorecard_probability())


def score_model(model, feat: DataFrame, out: str = "churn_probability") -> DataFrame:
    """Positive-class probability of a fitted Spark ML pipeline."""
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(feat)
    keep = [c for c in feat.columns]
    return scored.select(*keep, vector_to_array(F.col("probability"))[1].alias(out))


def _threshold_col(threshold) -> tuple[DataFrame | None, Column]:
    if isinstance(threshold, DataFrame):
        return threshold.select(F.col(threshold.columns[0]).cast("double").alias("_threshold")), F.col("_threshold")
    return None, F.lit(float(threshold))


def scored_table(probs: DataFrame, threshold=0.5, p: str = "churn_probability") -> DataFrame:
    """C3 + F16-F19: prediction at ``threshold`` (a float, or a one-row
    DataFrame whose first column is the threshold, joined as a broadcast),
    retention value, risk level and recommended action."""
    tdf, t = _threshold_col(threshold)
    df = probs if tdf is None else probs.crossJoin(F.broadcast(tdf))
    out = df.select(
        *[F.col(c) for c in probs.columns],
        fx.prediction(t, p).alias("churn_prediction"),
        fx.retention_value(p).alias("retention_value"),
        fx.risk_level(p).alias("risk_level"),
        fx.action_code().alias("action_code"),
    )
    return out.withColumn("recommended_action", fx.action_text("action_code"))


def labelled(scored: DataFrame) -> DataFrame:
    """add display labels for coded columns; a column that is already a
    string (e.g. raw Geography) passes through as its own label."""
    from pyspark.sql import types as T
    strings = {f.name for f in scored.schema.fields if isinstance(f.dataType, T.StringType)}
    source = {"Geography_Label": "Geography", "Gender_Label": "Gender"}
    cols = [F.col(source[n]) if source.get(n) in strings else c for n, c in fx.decode_labels().items()]
    return scored.select("*", *[c.alias(n) for n, c in zip(fx.decode_labels(), cols)])
