import zlib

import numpy as np
import pytest

from retainspark.llm import quality as m


def test_statistics_are_finite_and_bounded():
    for t in (None, "", " ", "a", "a" * 300_000, "🙂 é\x00", "x y\n" * 1000):
        s = np.array(m.statistics(t))
        assert len(s) == len(m.STATISTICS) and np.isfinite(s).all()


def test_pooled_is_isotonic_regression():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 12))
        y, w = rng.integers(0, 5, n).astype(float), rng.integers(1, 4, n).astype(float)
        got = m.pooled(np.arange(n), y, w)
        # the max-min formula of isotonic regression
        mean = lambda a, b: (y[a:b + 1] * w[a:b + 1]).sum() / w[a:b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert got == pytest.approx(want)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    f = m.Fourier(np.zeros(6), np.ones(6), features=6000, bandwidth=2.0)
    z = f(x)[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-d / (2 * 2.0 ** 2))).max() < 0.1


def test_sums_equal_a_direct_solution(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(m.STATISTICS)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y)], "x array<double>, label int").repartition(7)
    s = m.fit(df, features=50)
    f = m.Fourier(x.mean(axis=0), x.std(axis=0), 50)
    z = f(x)
    p = np.eye(51) * m.RIDGE
    p[-1, -1] = 0
    beta = np.linalg.solve(z.T @ z / 300 + p, z.T @ y / 300)
    assert s.beta == pytest.approx(beta, rel=1e-6, abs=1e-6)
    assert (np.diff(s.values) >= 0).all() and (np.diff(s.knots) > 0).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in m.op2_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels if x.doc_id in rows and rows[x.doc_id].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) >= 0.95


def test_labels_of_the_held_out_fold_are_not_seen(spark, make_docs, prose):
    docs = make_docs([(i, prose(i, 30) + (" ***" * 20 if i % 3 == 0 else "")) for i in range(80)])
    fold = {i for i in range(80) if zlib.crc32(str(i).encode()) % 4 == 2}
    label = lambda flip: spark.createDataFrame([(i, int((i % 3 != 0) != (flip and i in fold))) for i in range(80)], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in m.score(docs, label(f)).collect()} for f in (False, True))
    assert a == pytest.approx(b)


def test_hard_rows_and_missing_labels(spark, make_docs, hard):
    docs = make_docs(hard, clashes=True)
    none = spark.createDataFrame([], "doc_id long, quality int, score string")
    assert {r.score for r in m.score(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (6, 1), (None, 0), (1, None)], "doc_id long, quality int")
    rows = m.score(docs, one).collect()
    assert len(rows) == len(hard) and {r.score for r in rows} == {1.0}
    both = spark.createDataFrame([(4, 1), (6, 1), (2, 0), (2, 0), (3, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in m.score(docs, both).collect())
    assert m.score(make_docs([]), both).collect() == []
