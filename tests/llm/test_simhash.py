import random

import numpy as np
import pytest

from retainspark.llm import simhash as m
from retainspark.llm.common import components


def brute(fps, ids, bits=3):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits):
            x, y = find(i), find(int(j))
            up[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(a)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for g in groups.values():
        low = min((ids[i] for i in g if ids[i] is not None), default=None)
        out.update({i: low for i in g})
    return out


def test_fingerprint_by_hand():
    import xxhash
    assert m.simhash(None) == m.simhash(b" \n ") == 0
    assert m.simhash(b"Ab c") == xxhash.xxh64_intdigest(b"ab c", seed=42)
    a, b = (xxhash.xxh64_intdigest(x, seed=42) for x in (b"a b c", b"b c d"))
    assert m.simhash(b"a b C d") == a & b  # set in over half of two: in both
    assert m.simhash("É b c".encode()) == xxhash.xxh64_intdigest("É b c".encode(), seed=42)  # only A-Z is lowered


def test_query_equals_brute_force(spark, sf_small):
    rows = m.op7_simhash(spark, sf_small).collect()
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    ids = [r.doc_id for r in docs]
    fps = [m.simhash((r.text or "").encode()) for r in docs]
    want = {ids[i]: (format(fps[i], "016x"), c) for i, c in brute(fps, ids).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want and len(rows) == len(docs)


@pytest.mark.parametrize("n", [300, 5000])
def test_dense_and_scattered_cells(n):
    rng = random.Random(n)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(n // 2)} | {rng.getrandbits(64) for _ in range(n // 2)}
    fps = np.array(sorted(fps), np.uint64)
    root = m.join_within(fps, 3)
    want = brute(fps.tolist(), list(range(len(fps))))
    same = {}
    for i in range(len(fps)):
        assert same.setdefault(root[i], want[i]) == want[i]
    assert len(same) == len(set(want.values()))


def test_links_find_every_pair_of_bits(spark):
    rng = random.Random(4)
    fps = []
    for _ in range(200):
        a = rng.getrandbits(64)
        fps += [a, a ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])))]
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in set(fps)], "fp long")
    got = components(m.links(df), "t").collect()
    root = {r.node: r.root for r in got}
    ids = sorted(r.fp for r in df.collect())
    want = brute([int(np.int64(x).view(np.uint64)) for x in ids], ids)
    assert {x: root.get(x, x) for x in ids} == {ids[i]: w for i, w in want.items()}


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(200)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "u long, v long"), "t").collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(201)}} and len(got) == 242


def test_hard_rows(spark, make_docs, hard):
    rows = m.near_duplicates(make_docs(hard, clashes=True)).collect()
    assert len(rows) == len(hard)
    by = {r.doc_id: r for r in rows}
    assert {by[i].component_id for i in (1, 2, 3, 9)} == {1} and by[1].fp == 0
    assert by[7].component_id == by[4].component_id == 4 and by[None].component_id is None
    assert m.near_duplicates(make_docs([])).collect() == []


def test_stage_keeps_one_of_each_group(spark, make_docs, hard):
    docs = make_docs(hard, clashes=True)
    kept = m.simhash_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 8), (True, None)]
