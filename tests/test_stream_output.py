"""Both sinks of a batch appear together; compaction."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from retainspark.plans import base
from retainspark.session import ensure_checkpoint_dir
from retainspark.sources.requests import requests_from_base
from retainspark.streaming import scoring as st


@pytest.fixture
def run(spark, sf_small):
    ensure_checkpoint_dir(spark)
    plan = base.Plan(spark, sf_small)
    root = tempfile.mkdtemp(prefix="sinks-", dir="/tmp")
    out = os.path.join(root, "out")
    req = requests_from_base(plan.cust)

    def go(part, parts, expect=None):
        req.where(F.col("CustomerId") % parts == part).coalesce(1).write.json(os.path.join(root, "in", f"p{part}"))
        q = st.score_stream(spark, os.path.join(root, "in", "*"), out, os.path.join(root, "chk"), 0.4, background=plan.feat, max_files_per_trigger=1)
        if expect:
            with pytest.raises(Exception, match=expect):
                q.awaitTermination()
        else:
            q.awaitTermination()
    return go, out, req


def test_killed_between_the_writes_shows_neither(spark, run, monkeypatch):
    go, out, req = run
    go(0, 2)
    n = st.read_output(spark, out).count()
    write = st._record
    monkeypatch.setattr(st, "_record", lambda *a: (_ for _ in ()).throw(RuntimeError("killed before the record")))
    go(1, 2, "killed before the record")
    assert len(os.listdir(os.path.join(out, "responses"))) == 2  # both sinks are written
    assert st.read_output(spark, out).count() == n and st.read_output(spark, out, "quarantine").agg(F.max("batch_id")).first()[0] == 0
    monkeypatch.setattr(st, "_record", write)
    q = os.path.join(os.path.dirname(out), "in")
    st.score_stream(spark, os.path.join(q, "*"), out, os.path.join(os.path.dirname(out), "chk"), 0.4, background=base.feat(spark, "/root/testdata/sf0.001"),
                    max_files_per_trigger=1).awaitTermination()
    total = st.read_output(spark, out).count() + st.read_output(spark, out, "quarantine").count()
    assert total == req.count()


def test_compaction_keeps_every_row(spark, run):
    go, out, req = run
    for part in range(3):
        go(part, 4)
    rows = lambda sink: sorted(map(str, st.read_output(spark, out, sink).orderBy("CustomerId").collect()))
    before = {sink: rows(sink) for sink in st.SINKS}
    assert st.compact(spark, out) and {sink: rows(sink) for sink in st.SINKS} == before
    assert st.compact(spark, out) is None
    go(3, 4)  # new batches beside the compacted ones, and compacted again
    assert st.read_output(spark, out).select("batch_id").distinct().count() == 4
    st.compact(spark, out, files=2)
    assert st.manifest(spark, out).select("folder").distinct().count() == 1
    assert st.read_output(spark, out).count() + st.read_output(spark, out, "quarantine").count() == req.count()


def test_no_finished_batch(spark):
    with pytest.raises(FileNotFoundError):
        st.read_output(spark, tempfile.mkdtemp(prefix="none-", dir="/tmp"))
