import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from retainspark.llm import repeats as m


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        on = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if n[d[i:i + length]] > 1:
                on[i:i + length] = True
        runs = int((np.diff(np.r_[0, on.astype(int)]) == 1).sum())
        out.append((len(d), int(on.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~on].tobytes()).hexdigest()))
    return out


def check(make_docs, texts, length):
    docs = make_docs(list(enumerate(texts)), clashes=True)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in m.repeated(docs, length).collect()}
    want = dict(enumerate(brute(texts, length)))
    assert got == want
    return want


def test_every_string_has_a_trigger_of_its_own(prose):
    for text in (prose(1, 400), "ab" * 500, "a" * 900, "é🙂" * 200):
        d = text.encode()
        for length in (40, 200, 400):
            x, lo, hi = m.triggers(d, length)
            starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)]) if len(x) else np.empty(0)
            assert starts.tolist() == list(range(max(0, len(d) - length + 1)))
            for t, a, b in zip(x, lo, hi):
                for i in {a, b}:  # the string alone gives the same trigger
                    alone, _, _ = m.triggers(d[i:i + length], length)
                    assert alone.tolist() == [t - i]


def test_blocks_join(monkeypatch, prose):
    d = prose(3, 600).encode()
    want = m.triggers(d, 100)
    monkeypatch.setattr(m, "_BLOCK", 137)
    assert all(np.array_equal(a, b) for a, b in zip(m.triggers(d, 100), want))


@pytest.mark.parametrize("length", [40, 100])
def test_edges_nesting_and_periods(make_docs, prose, length):
    p = prose(7, 80)
    texts = [f"{prose(1, 20)} {p} {prose(2, 20)}", f"{prose(3, 9)} {p[:len(p) // 2]}", f"{p[len(p) // 3:]} {prose(4, 30)}", f"x{p[10:10 + length]}y", f"x{p[10:9 + length]}z",
             "ab" * length, "abc" * length, "a" * (length + 1), prose(5, 60), prose(5, 60), f"{prose(5, 60)}.", f"{p} {p}", "", None, "short"]
    want = check(make_docs, texts, length)
    assert want[4][1] < length or want[4][2] >= 0
    assert sum(w[1] for w in want.values()) > 10 * length


def test_random_mixes(make_docs, prose):
    rng = np.random.default_rng(5)
    base = prose(11, 400)
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.integers(1, 5)):
            a = int(rng.integers(0, len(base) - 200))
            parts.append(base[a:a + int(rng.integers(10, 200))])
        texts.append("".join(parts))
    check(make_docs, texts, 60)


def test_query_equals_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], 400)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in m.op8_repeats(spark, sf_small).collect()}
    assert got == want


def test_query_equals_brute_force_on_a_larger_table(spark):
    """Strings by 128-bit digest, as a table of them whole would fill the memory."""
    import xxhash
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    digest, length = xxhash.xxh3_128_digest, m.LENGTH
    strings = [[digest(d[i:i + length]) for i in range(len(d) - length + 1)] for _, d in docs]
    n = Counter(x for xs in strings for x in xs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in m.op8_repeats(spark, sf).collect()}
    lost = 0
    for (doc, d), xs in zip(docs, strings):
        edge = np.zeros(len(d) + 1, np.int64)
        at = np.array([i for i, x in enumerate(xs) if n[x] > 1], np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        on = np.cumsum(edge[:-1]) > 0
        runs = int((np.diff(np.r_[0, on.astype(int)]) == 1).sum())
        assert got[doc] == (len(d), int(on.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~on].tobytes()).hexdigest())
        lost += bool(len(at))
    assert len(got) == len(docs) and lost > 100


def test_hard_rows(spark, make_docs, hard):
    rows = m.repeated(make_docs(hard, clashes=True), 200).collect()
    assert len(rows) == len(hard)
    assert all(r.n_removed == r.n_bytes > 200 for r in rows if r.doc_id in (4, 7)) and m.repeated(make_docs([])).collect() == []


def test_a_common_surrounding_is_split_over_tasks(spark, make_docs, prose):
    """A passage that many texts hold with the same bytes around it, and a few cut off: its triggers don't meet in one task."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    common = prose(1, 60)
    texts = [f"{prose(i, 12)} {common} {prose(i + 1000, 12)}" for i in range(2, 600)] + [f"{prose(i, 12)} {common[k:]}" for i, k in ((700, 90), (701, 110), (702, 130))]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = m.repeated(make_docs(list(enumerate(texts))), 60)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == dict(enumerate(brute(texts, 60)))
    assert re.search(r"SortMergeJoin\(skew=true\)[^\n]*LeftSemi", plan)
