"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles.  Two documents are linked if their fingerprints differ in at
most ``distance`` bits.  The 64 bits are cut into segments; of two fingerprints
that differ in ``distance`` bits, one segment differs in at most
``distance // segments``.  For each segment a table holds the fingerprints under
their segment's value and each fingerprint looks up the small Hamming ball
around its own value; what meets there is verified on all 64 bits.

Defined results: null or empty text and text without a word: fingerprint zero,
linked like any other.  Repeated rows share a fingerprint and stay separate
rows.  An empty table gives an empty result.  A row with a null id is returned
and linked, but never names a component; alone, its component is null.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, keyed, stored

SHINGLE_WORDS = 3
MAX_BITS = 3
SEGMENTS = 2
SEED = 42
#: Members of one table cell above which its pairs are searched by byte.
CELL = 2048
_BLOCK = 1 << 16


def simhash(data: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 text (A-Z lower-cased)."""
    w = (data or b"").lower().split()
    if not w:
        return 0
    h64 = partial(xxhash.xxh64_intdigest, seed=SEED)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    hashes = np.fromiter(map(h64, shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at:at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, digest, fp) with the fingerprint's bit pattern as a long, and a digest
    of the text, which tells rows with one id apart."""
    def fn(batch: pa.RecordBatch) -> dict:
        data = batch.column("text").cast(pa.binary()).to_pylist()
        fps = np.array([simhash(x, words) for x in data], np.uint64).view(np.int64)
        return {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "fp": pa.array(fps)}

    return arrow_map(keyed(docs).withColumn("digest", F.xxhash64("text")), fn, "doc_id long, digest long, fp long")


def ball(values: np.ndarray, width: int, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, value) of the half of each value's Hamming ball that only clears
    bits.  Wherever two values differ one of them has a bit to clear, so any two
    within ``radius`` meet at the value with all their differing bits cleared."""
    out = []
    for r in range(radius + 1):
        for bits in combinations(range(width), r):
            m = np.uint64(sum(1 << b for b in bits))
            rows = np.flatnonzero((values & m) == m)
            out.append((rows, values[rows] ^ m))
    return out


def probes(distinct: DataFrame, bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(key, fp, own) for each segment: a row under the segment's own value and
    one under each value of its ball.  ``own`` marks rows that can make a key
    worth a look: with a radius of one, of two rows that link one is its own."""
    width, radius = 64 // segments, bits // segments
    if 64 % segments or width > 48:
        raise ValueError("segments must divide 64 into at most 48 bits")

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for s in range(segments):
                own = (fp >> np.uint64(s * width)) & np.uint64((1 << width) - 1)
                tag = np.uint64(s << width)
                keys, rows, table = [], [], []
                for i, (at, value) in enumerate(ball(own, width, radius)):
                    keys.append(value | tag)
                    rows.append(at)
                    table.append(np.full(len(at), i == 0 or radius > 1))
                for lo in range(0, len(keys), 16):
                    at = np.concatenate(rows[lo:lo + 16])
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array(np.concatenate(keys[lo:lo + 16]).view(np.int64)),
                        "fp": pa.array(fp[at].view(np.int64)),
                        "own": pa.array(np.concatenate(table[lo:lo + 16]))})

    return distinct.select("fp").mapInArrow(run, "key long, fp long, own boolean")


def join_within(fps: np.ndarray, bits: int) -> np.ndarray:
    """For distinct fingerprints, the index of each one's group representative
    under links of at most ``bits`` differing bits.  Grows groups outwards from
    a member over what isn't reached yet, so a dense group costs few passes;
    a large cell is searched byte by byte (of ``bits`` < 8 differing bits some
    byte is equal), so scattered members are not compared with each other."""
    n = len(fps)
    root = np.arange(n)
    if n <= CELL or bits >= 8:
        _grow(fps, np.arange(n), root, bits)
        return _flat(root)
    for b in range(8):
        byte = (fps >> np.uint64(8 * b)) & np.uint64(255)
        order = np.argsort(byte, kind="stable")
        for cell in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1):
            # one call per cell: members already known to be joined still link others
            _grow(fps, cell, root, bits)
        root = _flat(root)
        if (root == root[0]).all():
            break
    return root


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _flat(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def _grow(fps: np.ndarray, cell: np.ndarray, root: np.ndarray, bits: int) -> None:
    left = cell
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= bits
            if near.any():
                a = _find(root, i)
                for j in left[near]:
                    b = _find(root, j)
                    a, b = min(a, b), max(a, b)
                    root[b] = a
                todo.extend(left[near])
                left = left[~near]


def links(distinct: DataFrame, bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(u, v) edges that join exactly the fingerprints which links of at most
    ``bits`` differing bits join.  Rows of one key arrive together and sorted;
    a key without a table entry is passed over, and for the rest only a
    spanning forest is returned, never all pairs."""
    def run(batches):
        keep_k, keep_f, keep_o = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)

        def solve(k, f, o):
            us, vs = [], []
            if len(k):
                starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                ends = np.r_[starts[1:], len(k)]
                has = np.logical_or.reduceat(o, starts)
                for s, e in zip(starts[has & (ends - starts > 1)], ends[has & (ends - starts > 1)]):
                    g = f[s:e]
                    root = join_within(g, bits)
                    at = np.flatnonzero(root != np.arange(len(g)))
                    us.append(g[at])
                    vs.append(g[root[at]])
            join = lambda x: np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64)
            return pa.RecordBatch.from_pydict({"u": pa.array(join(us)), "v": pa.array(join(vs))})

        for batch in batches:
            k = np.r_[keep_k, batch.column("key").to_numpy()]
            f = np.r_[keep_f, batch.column("fp").to_numpy().view(np.uint64)]
            o = np.r_[keep_o, batch.column("own").to_numpy(zero_copy_only=False)]
            cut = int(np.searchsorted(k, k[-1], side="left")) if len(k) else 0
            if cut:
                yield solve(k[:cut], f[:cut], o[:cut])
            keep_k, keep_f, keep_o = k[cut:], f[cut:], o[cut:]
        yield solve(keep_k, keep_f, keep_o)

    met = probes(distinct, bits, segments).repartition("key").sortWithinPartitions("key", "fp")
    return met.mapInArrow(run, "u long, v long")


def grouped(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, digest, fp, root, component_id) for every row of ``docs``; a component
    is known by its ``root``, the smallest fingerprint in it."""
    fps = stored(fingerprints(docs, words), "simhash-fps")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = components(links(distinct, bits), "simhash")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    named = named.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    place = named.join(lowest, "root").select(F.col("fp").alias("fp_"), "root", "component_id")
    return fps.join(place, fps["fp"] == place["fp_"]).select("doc_id", "digest", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    return grouped(docs, words, bits).select("doc_id", "fp", "component_id")


def hex_digits(fp):
    """A fingerprint column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash(spark, sf_dir) -> DataFrame:
    from .common import table
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group the document with the smallest id (one row of it if rows
    repeat; of several texts with that id one).  Texts that share an id are told
    apart, so each group keeps its own.  Rows with a null id are kept."""
    found = grouped(docs).where(F.col("doc_id").isNotNull())
    keep = found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("k")).select(F.col("k.doc_id").alias("__keep"), F.col("k.digest").alias("__of"))
    known = docs.withColumn("__digest", F.xxhash64(F.col("text").cast("string")))
    held = known.join(keep, (F.col("doc_id") == F.col("__keep")) & (F.col("__digest") == F.col("__of")), "left_semi")
    held = held.dropDuplicates(["doc_id", "__digest"]).drop("__digest")
    return held.unionByName(docs.where(F.col("doc_id").isNull()))
