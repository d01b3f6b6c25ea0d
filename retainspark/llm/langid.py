"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read the bytes of a segment, one from each side; from both states every
position gets a distribution over the languages, and a document's probabilities
are the mean over its positions.  A long text is read whole, as segments with a
few bytes of context on either side, so all segments of a slice advance together
as the lanes of one matrix and memory doesn't grow with a text.

The network is trained in numpy by backpropagation through time, on windows of a
bounded sample: at most ``SAMPLE`` documents of each language, those with the
smallest hash, found without moving any text.  A text over ``SAMPLE_BYTES`` gives
windows from anywhere in it.

Defined results: text that is null or has no letter: ``und``, score 0.  With
nothing to learn from, all are ``und``.  Repeated rows are predicted each; an
empty table gives an empty result.  A null doc_id is never learned from and is
not held out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, keep_rows, keyed, pieces, table

UNKNOWN = "und"
#: The bound of the training sample: documents per language, bytes of each, and of a
#: window where a document is longer.
SAMPLE = 400
SAMPLE_BYTES, DRAWN_BYTES = 4096, 256
HIDDEN = 8
STEPS, LANES, WINDOW, RATE = 500, 128, 48, 0.02
SEGMENT, CONTEXT = 512, 24
SLICE_BYTES = 2 << 20
LANES_AT_ONCE = 4096
HELD_OUT_MOD, HELD_OUT = 5, 0
#: A document whose best language has a lower mean probability is rejected.
MIN_SCORE = 0.4
_PAD = 256
_LETTER = re.compile(r"[^\W\d_]")


class Gru:
    """One direction: weights by gate (update z, reset r, candidate n)."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        s = 1 / np.sqrt(hidden)
        self.x = [rng.normal(0, 0.3, (_PAD + 1, hidden)).astype(np.float32) for _ in range(3)]
        self.h = [rng.uniform(-s, s, (hidden, hidden)).astype(np.float32) for _ in range(3)]

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state and what the backward pass needs."""
        z = _sigmoid(self.x[0][byte] + h @ self.h[0])
        r = _sigmoid(self.x[1][byte] + h @ self.h[1])
        u = h @ self.h[2]
        n = np.tanh(self.x[2][byte] + r * u)
        return n + z * (h - n), z, r, u, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Both directions and the output layer over ``langs``."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.f, self.b = Gru(rng, hidden), Gru(rng, hidden)
        self.out = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.f.x, *self.f.h, *self.b.x, *self.b.h, self.out, self.bias]

    def gradients(self, text: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of ``text`` (time x lane) and
        its gradient with respect to ``weights()``, back through time."""
        time, lanes = text.shape
        hidden = self.f.h[0].shape[0]
        runs = []
        for gru, order in ((self.f, range(time)), (self.b, range(time - 1, -1, -1))):
            h, saved, states = np.zeros((lanes, hidden), np.float32), {}, np.empty((time, lanes, hidden), np.float32)
            for t in order:
                new, z, r, u, n = gru.step(text[t], h)
                saved[t] = (h, z, r, u, n)
                h = states[t] = new
            runs.append((gru, order, saved, states))
        both = np.concatenate([runs[0][3], runs[1][3]], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        at = np.arange(lanes)
        loss = float(-np.log(p[:, at, label] + 1e-9).mean())
        p[:, at, label] -= 1
        p /= time * lanes
        d_out = np.einsum("tlh,tlc->hc", both, p)
        d_bias = p.sum(axis=(0, 1))
        d_both = p @ self.out.T
        grads = []
        for k, (gru, order, saved, _) in enumerate(runs):
            by_gate = [np.empty((time, lanes, hidden), np.float32) for _ in gru.x]
            dh = [np.zeros_like(w) for w in gru.h]
            carry = np.zeros((lanes, hidden), np.float32)
            for t in reversed(order):
                h, z, r, u, n = saved[t]
                g = carry + d_both[t, :, k * hidden:(k + 1) * hidden]
                dn = g * (1 - z) * (1 - n * n)
                dz = g * (h - n) * z * (1 - z)
                dr = dn * u * r * (1 - r)
                du = dn * r
                for kept, d in zip(by_gate, (dz, dr, dn)):
                    kept[t] = d
                dh[0] += h.T @ dz
                dh[1] += h.T @ dr
                dh[2] += h.T @ du
                carry = g * z + dz @ gru.h[0].T + dr @ gru.h[1].T + du @ gru.h[2].T
            flat = text.ravel()
            dx = [np.stack([np.bincount(flat, d[..., j].ravel(), _PAD + 1) for j in range(hidden)], axis=1).astype(np.float32) for d in by_gate]
            grads += dx + dh
        return loss, [*grads, d_out, d_bias]

    def seal(self) -> Network:
        """Make the padding byte keep the state as it is."""
        for gru in (self.f, self.b):
            gru.x[0][_PAD] = 60.0
        return self


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on random windows of the samples, as many of each language."""
    langs = sorted({g for _, g in samples})
    net = Network(langs, hidden, seed)
    by = [[np.frombuffer(t, np.uint8).astype(np.int64) for t, g in samples if g == x and t] for x in langs]
    by = [(i, x) for i, x in enumerate(by) if x]
    if len(langs) < 2:
        return net.seal()
    rng = np.random.default_rng(seed)
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        text, label = np.full((WINDOW, LANES), _PAD, np.int64), np.empty(LANES, np.int64)
        for lane in range(LANES):
            label[lane], pool = by[lane % len(by)]
            t = pool[rng.integers(len(pool))]
            at = rng.integers(max(1, len(t) - WINDOW + 1))
            part = t[at:at + WINDOW]
            text[:len(part), lane] = part
        _, grads = net.gradients(text, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 1.0 / (norm + 1e-9)) * (1 - 0.9 * step / steps)
        for w, g, m, v in zip(net.weights(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net.seal()


def _lanes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all texts, with context, as time x lane; the text of each
    lane; how many bytes are the lane's own."""
    rows, owner, own = [], [], []
    size = SEGMENT + 2 * CONTEXT
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        for at in range(0, len(b), SEGMENT):
            row = np.full(size, _PAD, np.int16)
            lo, hi = max(0, at - CONTEXT), min(len(b), at + SEGMENT + CONTEXT)
            row[lo - at + CONTEXT:hi - at + CONTEXT] = b[lo:hi]
            rows.append(row)
            owner.append(i)
            own.append(min(SEGMENT, len(b) - at))
    grid = np.ascontiguousarray(np.array(rows, np.int16).T) if rows else np.empty((size, 0), np.int16)
    return grid, np.array(owner, np.int64), np.array(own, np.int64)


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """For each text the mean over all its positions of the languages'
    probabilities (zeros for an empty text)."""
    grid, owner, own = _lanes(texts)
    total = np.zeros((len(texts), len(net.langs)))
    for at in range(0, len(owner), LANES_AT_ONCE):  # however short the texts, the states of so many lanes at most
        to = at + LANES_AT_ONCE
        np.add.at(total, owner[at:to], _pooled(net, np.ascontiguousarray(grid[:, at:to]), own[at:to]))
    return total / np.maximum(np.array([len(t) for t in texts]), 1)[:, None]


def _pooled(net: Network, grid: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Each lane's probabilities, summed over its own positions."""
    time, lanes = grid.shape
    classes, hidden = len(net.langs), net.f.h[0].shape[0]
    ahead = np.empty((time, lanes, classes), np.float32)
    h = np.zeros((lanes, hidden), np.float32)
    for t in range(time):
        h = _advance(net.f, grid[t], h)
        np.matmul(h, net.out[:hidden], out=ahead[t])
    h = np.zeros((lanes, hidden), np.float32)
    pooled = np.zeros((lanes, classes), np.float32)
    for t in range(time - 1, -1, -1):
        h = _advance(net.b, grid[t], h)
        if CONTEXT <= t < CONTEXT + SEGMENT:
            p = ahead[t]
            p += h @ net.out[hidden:]
            p += net.bias
            np.clip(p, -30, 30, out=p)
            np.exp(p, out=p)
            p *= ((own > t - CONTEXT) / p.sum(axis=1))[:, None].astype(np.float32)
            pooled += p
    return pooled


def _advance(gru: Gru, byte: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``Gru.step`` in place, for states that are not kept."""
    z = h @ gru.h[0]
    z += gru.x[0].take(byte, axis=0)
    z *= 0.5
    np.tanh(z, out=z)
    z += 1
    z *= 0.5
    r = h @ gru.h[1]
    r += gru.x[1].take(byte, axis=0)
    r *= 0.5
    np.tanh(r, out=r)
    r += 1
    r *= 0.5
    r *= h @ gru.h[2]
    r += gru.x[2].take(byte, axis=0)
    np.tanh(r, out=r)
    h -= r
    h *= z
    h += r
    return h


def drawn(text: bytes, seed: int) -> bytes:
    """What a text gives to the sample: all of it, or of a longer one windows from
    anywhere in it."""
    if len(text) <= SAMPLE_BYTES:
        return text
    starts = np.sort(np.random.default_rng(seed).integers(0, len(text) - DRAWN_BYTES + 1, SAMPLE_BYTES // DRAWN_BYTES))
    return b"".join(text[a:a + DRAWN_BYTES] for a in starts.tolist())


def sample(docs: DataFrame, per_lang: int = SAMPLE) -> list[tuple[bytes, str]]:
    """The training sample: (text or windows of it, language) of rows outside the
    held-out fold, ``per_lang`` of each language, those with the smallest hash.
    A language's count says which hashes can be among them; only these few meet."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), HELD_OUT_MOD) != HELD_OUT))
    usable = usable.withColumn("h", F.xxhash64("doc_id", "text"))
    counts = usable.groupBy(F.col("lang").alias("of")).agg(F.approx_count_distinct("h").alias("n"))
    share = F.least(F.lit(1.0), 2.0 * per_lang / F.col("n"))
    low = usable.select("doc_id", "lang", "h").join(F.broadcast(counts), F.col("lang") == F.col("of"))  # counts: a row for each language
    low = low.where(F.col("h").cast("double") <= share * 2.0 ** 64 - 2.0 ** 63)
    n = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = low.select("doc_id", "lang", "h").distinct().withColumn("n", n).where(F.col("n") <= per_lang)

    def run(batches):
        for batch in batches:
            h = batch.column("h").to_pylist()
            text = [drawn(t, x & 0xFFFFFFFF) for t, x in zip(batch.column("text").cast(pa.binary()).to_pylist(), h)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "h": batch.column("h"), "text": pa.array(text, pa.binary())})

    got = usable.join(F.broadcast(chosen.drop("n")), ["doc_id", "lang", "h"]).select("doc_id", "lang", "h", "text")
    got = got.mapInArrow(run, "doc_id long, lang string, h long, text binary").dropDuplicates(["doc_id", "lang", "h"])
    return [(bytes(r[3]), r[1]) for r in sorted(got.collect())]


def judged(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Each text's language and its probability; ``und`` and 0 without a letter."""
    known = [bool(net.langs) and bool(t) and bool(_LETTER.search(t)) for t in texts]
    p = probabilities(net, [t.encode() if k else b"" for t, k in zip(texts, known)]) if net.langs else np.zeros((len(texts), 1))
    best = p.argmax(axis=1)
    score = np.clip(p[np.arange(len(best)), best], 0, 1)
    return [net.langs[b] if k else UNKNOWN for b, k in zip(best, known)], [float(s) if k else 0.0 for s, k in zip(score, known)]


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``."""
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", SLICE_BYTES):
                lang, score = judged(net, part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return keyed(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the sample of ``docs`` and predict all of it."""
    return predict(docs, train(sample(docs)))


def op3_langid(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT_MOD) == HELD_OUT, F.lit(False))
    return identify(docs).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def langid_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: ``und``, or no language reaches a mean
    probability of ``MIN_SCORE``."""
    net = train(sample(docs))

    def known(texts: list[str | None]) -> np.ndarray:
        lang, score = judged(net, texts)
        return np.array([x != UNKNOWN and s >= MIN_SCORE for x, s in zip(lang, score)], bool)

    return keep_rows(docs, known, SLICE_BYTES)
