"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a few statistics (lengths, character classes, repetition).
Standardised, they pass random cosine features, which approximate a Gaussian
kernel.  Ridge regression on these needs only the normal equations, whose sums
are formed per partition over all labelled rows, added up in groups and solved on
the driver: what moves is one fixed-size matrix per partition.  The raw
scores of all labelled rows, counted into bins, give the isotonic calibration by
pooling adjacent violators.

Defined results: null text is scored as empty text.  Without a labelled row every
score is 0.5; with a single class it is that class's share.  Null labels are
ignored, repeated labels count each.  A null doc_id is never learned from and is
not held out.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, keyed, stored, table

FEATURES = 192
BANDWIDTH = 4.0
RIDGE = 1e-3
BINS = 1000
HELD_OUT_MOD, HELD_OUT = 4, 2
THRESHOLD = 0.7
STATISTICS = ("words", "bytes", "word_length", "upper", "digits", "symbols", "punctuation", "bars", "bangs", "non_ascii", "longest_word",
              "distinct_words", "distinct_triples", "repeated_lines", "line_words", "sentence_ends", "capitalised", "single_letters")
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&<>@^~=+\\{}[]"
_MARKS = b".,;:?'\"()-"
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, each of a bounded or logarithmic size."""
    b = (text or "").encode()
    n = max(1, len(b))
    words = b.split()
    w = max(1, len(words))
    share = lambda chars: (len(b) - len(b.translate(None, chars))) / n
    lines = [x for x in b.split(b"\n") if x.strip()]
    triples = max(0, len(words) - 2)
    lengths = list(map(len, words))
    return [
        math.log1p(len(words)), math.log1p(len(b)), sum(lengths) / w, share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_MARKS),
        share(b"|"), share(b"!"), share(_HIGH), math.log1p(max(lengths, default=0)), len(set(words)) / w,
        len(set(zip(words, words[1:], words[2:]))) / triples if triples else 1.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(len(words) / max(1, len(lines))),
        sum(x.endswith((b".", b"!", b"?")) for x in words) / w, sum(65 <= x[0] <= 90 for x in words) / w, lengths.count(1) / w,
    ]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of every document."""
    def fn(batch: pa.RecordBatch) -> dict:
        x = [statistics(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "x": pa.array(x, pa.list_(pa.float64()))}

    return arrow_map(keyed(docs), fn, "doc_id long, x array<double>")


def _matrix(column: pa.Array, width: int = len(STATISTICS)) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Fourier:
    """cos(W x + b) features of standardised statistics, and an intercept."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, bandwidth: float = BANDWIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = rng.normal(0, 1 / bandwidth, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([math.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])


def _summed(rows: DataFrame, sums, groups: int) -> np.ndarray | None:
    """The total over all rows of a fixed-size vector that ``sums`` gets from a
    batch: summed in each partition, then in groups of partitions."""
    def local(batches):
        total, n = None, 0
        for n, batch in enumerate(batches, 1):
            part = sums(batch)
            total = part if total is None else total + part
        if n:
            from pyspark import TaskContext
            group = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_pydict({"g": pa.array([group], pa.int64()), "v": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    def joined(batches):
        last, total = None, None
        for batch in batches:
            for g, v in zip(batch.column("g").to_pylist(), batch.column("v").to_pylist()):
                if total is not None and g != last:
                    yield pa.RecordBatch.from_pydict({"g": pa.array([last], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})
                    total = None
                last, part = g, np.frombuffer(v, "<f8")
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"g": pa.array([last], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(local, "g long, v binary").repartition(groups, "g").sortWithinPartitions("g")
    total = None
    for r in parts.mapInArrow(joined, "g long, v binary").toLocalIterator():
        part = np.frombuffer(bytes(r[1]), "<f8")
        total = part.copy() if total is None else total + part
    return total


def pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Isotonic regression of means ``y`` with weights ``w`` in the order of x."""
    out: list[list[float]] = []
    for value, weight in zip(y, w):
        out.append([float(value), float(weight), 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            b, a = out.pop(), out.pop()
            out.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in out]) if out else np.empty(0)


class Scorer:
    """Raw ridge scores and their calibration."""

    def __init__(self, fourier: Fourier | None, beta: np.ndarray | None, constant: float = 0.5):
        self.fourier, self.beta, self.constant = fourier, beta, constant
        self.knots, self.values = np.array([0.0]), np.array([constant])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.fourier(x) @ self.beta, -0.5, 1.5) if self.fourier else np.full(len(x), 0.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Scorer:
    """Fit on all rows of (x, label): two passes of sums and one of counts."""
    d = len(STATISTICS)
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def moments(batch):
        x = _matrix(batch.column("x"))
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
        return np.r_[len(x), y.sum(), x.sum(axis=0), (x * x).sum(axis=0)]

    m = _summed(rows, moments, groups)
    if m is None or not m[0]:
        return Scorer(None, None)
    n, share, mean = m[0], m[1] / m[0], m[2:2 + d] / m[0]
    if share in (0.0, 1.0):
        return Scorer(None, None, share)
    spread = np.sqrt(np.maximum(m[2 + d:] / n - mean * mean, 0))
    fourier = Fourier(mean, np.where(spread > 1e-9, spread, 1.0), features)

    def normal(batch):
        z = fourier(_matrix(batch.column("x")))
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
        return np.r_[(z.T @ z).ravel(), z.T @ y]

    s = _summed(rows, normal, groups)
    k = features + 1
    gram, target = s[:k * k].reshape(k, k) / n, s[k * k:] / n
    penalty = np.eye(k) * ridge
    penalty[-1, -1] = 0
    scorer = Scorer(fourier, np.linalg.solve(gram + penalty, target))

    def binned(batch):
        raw = scorer.raw(_matrix(batch.column("x")))
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
        at = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
        return np.r_[np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)]

    c = _summed(rows, binned, groups).reshape(3, BINS)
    have = c[0] > 0
    scorer.knots = c[2][have] / c[0][have]
    scorer.values = pooled(scorer.knots, c[1][have] / c[0][have], c[0][have])
    return scorer


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score) for every document, learned from the labelled
    ones that are not held out."""
    held = F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT_MOD) == HELD_OUT, F.lit(False))
    rows = stored(described(docs).withColumn("held_out", held), "quality-statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("label")).where(F.col("label").isNotNull())
    train = rows.where(~F.col("held_out")).join(known, F.col("doc_id") == F.col("of")).select("x", "label")
    scorer = fit(stored(train, "quality-training"))

    def fn(batches):
        for batch in batches:
            s = scorer(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(s)})

    return rows.mapInArrow(fn, "doc_id long, held_out boolean, score double")


def op2_quality(spark, sf_dir) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
