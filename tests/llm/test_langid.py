import zlib

import numpy as np
import pytest

from retainspark.llm import langid as m


def test_gradients_by_finite_differences():
    net = m.Network(["a", "b", "c"], 4)
    rng = np.random.default_rng(0)
    text, label = rng.integers(0, 257, (6, 5)), np.array([0, 1, 2, 1, 0])
    _, grads = net.gradients(text, label)
    for w, g in zip(net.weights(), grads):
        at = np.unravel_index(np.abs(g).argmax(), w.shape)
        was, e = w[at], 1e-2
        w[at] = was + e
        up, _ = net.gradients(text, label)
        w[at] = was - e
        down, _ = net.gradients(text, label)
        w[at] = was
        assert (up - down) / (2 * e) == pytest.approx(float(g[at]), rel=0.03, abs=2e-4)


def slow(net, data):
    """One position at a time, segment by segment."""
    total = np.zeros(len(net.langs))
    for at in range(0, len(data), m.SEGMENT):
        lo, hi = max(0, at - m.CONTEXT), min(len(data), at + m.SEGMENT + m.CONTEXT)
        part = np.frombuffer(data[lo:hi], np.uint8).astype(np.int64)
        states = []
        for gru, order in ((net.f, range(len(part))), (net.b, range(len(part) - 1, -1, -1))):
            h, out = np.zeros((1, gru.h[0].shape[0]), np.float32), {}
            for t in order:
                h = out[t] = gru.step(part[t:t + 1], h)[0]
            states.append(out)
        for t in range(at - lo, min(at + m.SEGMENT, len(data)) - lo):
            z = np.concatenate([states[0][t], states[1][t]], axis=1) @ net.out + net.bias
            e = np.exp(z - z.max())
            total += (e / e.sum())[0]
    return total / max(1, len(data))


def test_every_position_counts_at_any_length(prose):
    net = m.Network(["a", "b"], 4).seal()
    texts = [prose(i, n).encode() for i, n in enumerate([1, 40, 200, 700])] + [b"", b"x" * m.SEGMENT, b"y" * (m.SEGMENT + 1)]
    got = m.probabilities(net, texts)
    for p, t in zip(got, texts):
        assert p == pytest.approx(slow(net, t), abs=1e-4)
    assert np.array_equal(m.probabilities(net, texts[::-1])[::-1].round(5), got.round(5))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = m.op3_langid(spark, sf).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) >= 0.97


def test_hard_rows_and_stage(spark, make_docs, hard, prose):
    from pyspark.sql import functions as F
    rows = hard + [(20 + i, prose(i, 40), "en") for i in range(20)] + [(50 + i, "ñó ción " * 30, "es") for i in range(20)]
    docs = make_docs(rows, clashes=True)
    net = m.train(m.sample(docs), steps=60)
    assert net.langs == ["en", "es"]
    got = m.predict(docs, net).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 9)} == {"und"} and all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = m.langid_stage(spark, docs, "")
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and not {1, 2, 3, 9} & set(ids) and {4, 6, 7, 20, 50} <= set(ids)
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in m.identify(bare).collect()} == {"und"}
    assert m.identify(make_docs([])).collect() == []
