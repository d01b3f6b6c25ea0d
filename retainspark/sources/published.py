"""Published models (S7) and their optional load.

A version is a folder with a model and its explainer (S8); a record naming it, with its
thresholds and the training quantiles (F8), is written last, in one file.  Readers go by records alone: what a killed run
leaves behind has none and is never seen, and a model without its name can't be.  The
newest record counts.  Where nothing is published, there is no model and no explainer,
and the thresholds are the defaults, so that serving falls back (X6).
"""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import DEFAULT_THRESHOLD
from .files import optional_table

RECORD = T.StructType([T.StructField("version", T.StringType()), T.StructField("model_name", T.StringType()), T.StructField("has_explainer", T.BooleanType()),
                       T.StructField("f1_optimal", T.DoubleType()), T.StructField("business_optimal", T.DoubleType()),
                       T.StructField("q_balance", T.DoubleType()), T.StructField("q_salary", T.DoubleType())])


@dataclass
class Published:
    """What serving needs; ``model`` and ``explainer`` are None where absent."""

    version: str | None = None
    name: str = "scorecard"
    model: PipelineModel | None = None
    explainer: DataFrame | None = None
    f1_threshold: float = DEFAULT_THRESHOLD
    business_threshold: float = DEFAULT_THRESHOLD
    quantiles: tuple[float, float] | None = None


def publish(model: PipelineModel, name: str, path: str, explainer: DataFrame | None = None,
            f1_threshold: float = DEFAULT_THRESHOLD, business_threshold: float = DEFAULT_THRESHOLD,
            quantiles: tuple[float, float] | None = None) -> str:
    """Write a version under ``path`` and make it the newest; returns its name."""
    spark = SparkSession.getActiveSession()
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    at = os.path.join(path, "versions", version)
    model.write().save(os.path.join(at, "model"))
    if explainer is not None:
        explainer.write.parquet(os.path.join(at, "explainer"))
    record = spark.createDataFrame([(version, name, explainer is not None, float(f1_threshold), float(business_threshold),
                                      *(map(float, quantiles) if quantiles else (None, None)))], RECORD)
    record.coalesce(1).write.parquet(os.path.join(path, "records", f"record={version}"))
    return version


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every published version, newest first."""
    return optional_table(spark, os.path.join(path, "records"), RECORD).select(*RECORD.names).orderBy("version", ascending=False)


def load_published(spark: SparkSession, path: str, version: str | None = None) -> Published:
    """The newest version (or the one named), else the defaults."""
    found = records(spark, path)
    r = (found if version is None else found.where(found["version"] == version)).first()
    if r is None:
        return Published()
    at = os.path.join(path, "versions", r["version"])
    explainer = spark.read.parquet(os.path.join(at, "explainer")) if r["has_explainer"] else None
    return Published(r["version"], r["model_name"], PipelineModel.load(os.path.join(at, "model")), explainer, r["f1_optimal"], r["business_optimal"],
                     None if r["q_balance"] is None else (r["q_balance"], r["q_salary"]))
