"""Streaming customer scoring (stateless).

JSON customer records arriving in a folder -> contract (V5) -> scoring (C4)
-> parquet sinks for responses and for quarantined records.  Each micro-batch
goes through exactly the batch functions (``foreachBatch``), so a stream and
a batch run over the same files give the same rows.  The background means
and the threshold are computed once, before the stream starts, as one-row
tables; nothing per-batch reaches the driver.  Progress lives in the
checkpoint folder, so a restarted query resumes where it stopped.

A batch has two sinks.  A manifest record, written after both, makes them
visible together: ``read_output`` shows a batch's rows only with its record, so a
run killed between the two writes shows neither, and a replayed batch that has a
record is not written again.  ``compact`` puts the folders of many batches into
one and swaps them by the same records.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.explain import term_means
from ..operators.features import high_value_quantiles
from ..operators.serve import score_requests
from ..sources.files import optional_table
from ..sources.requests import intake


def score_stream(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str,
                 threshold, background: DataFrame | None = None, available_now: bool = True,
                 max_files_per_trigger: int | None = None, legacy: bool = False, model=None,
                 model_name: str = "scorecard", explainer: DataFrame | None = None, quantiles=None):
    """Start the stream; returns the ``StreamingQuery``.  Responses land in
    ``output_dir/responses``, bad records in ``output_dir/quarantine``; read
    them with ``read_output``.
    Background term means and (unless ``legacy``) the training quantiles for
    high_value_customer are resolved once, before the first micro-batch.  With
    ``model`` (and its ``explainer``) the stream serves the trained model; with
    these and the ``quantiles`` it needs no ``background``."""
    means = term_means(background).checkpoint(eager=True) if background is not None else None
    if not legacy and quantiles is None:
        if background is None:
            raise ValueError("pass quantiles or a background table, or legacy=True")
        r = high_value_quantiles(background).first()        # one row
        quantiles = (r["q_balance"], r["q_salary"])
    if isinstance(threshold, DataFrame):
        threshold = threshold.select(F.col(threshold.columns[0]).cast("double").alias("t")).checkpoint(eager=True)
    reader = intake(spark.readStream)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(input_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not manifest(spark, output_dir).where(F.col("batch_id") == batch_id).isEmpty():
            return                                          # replayed after its record
        batch = batch.persist()                             # read and parsed once for both sinks
        resp, bad = score_requests(batch, threshold, background if model is not None else None, model, model_name, quantiles,
                                   legacy, means=means, explainer=explainer)
        # one folder per batch id, overwritten on replay: idempotent after a restart
        for rows, sink in ((resp, "responses"), (bad, "quarantine")):
            rows.write.mode("overwrite").parquet(os.path.join(output_dir, sink, f"batch_id={batch_id}"))
        batch.unpersist()
        _record(spark, output_dir, [(batch_id, f"batch_id={batch_id}")])

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


MANIFEST = "batch_id long, folder string"
SINKS = ("responses", "quarantine")


def _record(spark: SparkSession, output_dir: str, rows: list[tuple[int, str]]) -> None:
    """One file, so that all of ``rows`` appear together, in a folder of its own, so
    that a stream and a compaction can both write."""
    name = f"record={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(os.path.join(output_dir, "manifest", name))


def manifest(spark: SparkSession, output_dir: str) -> DataFrame:
    """(batch_id, folder) of every finished batch; a compacted batch has the folder
    it went into."""
    found = optional_table(spark, os.path.join(output_dir, "manifest"), T.StructType.fromDDL(MANIFEST))
    return found.groupBy("batch_id").agg(F.max("folder").alias("folder"))   # "compacted=" is above "batch_id="


def read_output(spark: SparkSession, output_dir: str, sink: str = "responses") -> DataFrame:
    """The rows of a sink's finished batches, with their ``batch_id``."""
    folders = [r[0] for r in manifest(spark, output_dir).select("folder").distinct().collect()]   # bounded by compaction
    if not folders:
        raise FileNotFoundError(f"no finished batch under {output_dir}")
    parts = []
    for kind in ("batch_id=", "compacted="):
        paths = [os.path.join(output_dir, sink, f) for f in sorted(folders) if f.startswith(kind)]
        if paths:
            rows = spark.read.option("basePath", os.path.join(output_dir, sink)).parquet(*paths)
            parts.append(rows.drop("compacted") if kind == "compacted=" else rows.withColumn("batch_id", F.col("batch_id").cast("long")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact(spark: SparkSession, output_dir: str, files: int = 1) -> str | None:
    """Rewrite all finished batches into one folder of ``files`` files a sink; the
    old folders stay for readers that have begun with them, and no new reader
    takes them.  Returns the new folder, or None if there is nothing to compact."""
    done = manifest(spark, output_dir)
    batches = [r[0] for r in done.select("batch_id").collect()]
    if done.select("folder").distinct().count() < 2:
        return None
    folder = f"compacted={time.time_ns():020d}"
    for sink in SINKS:
        read_output(spark, output_dir, sink).coalesce(files).write.parquet(os.path.join(output_dir, sink, folder))
    _record(spark, output_dir, [(b, folder) for b in batches])
    return folder
