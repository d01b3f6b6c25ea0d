import random

import numpy as np
import pytest

from retainspark.llm import decontaminate as m


def slow(item, text, most):
    """Fewest edits from item to a prefix of text, by the whole table."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(min(row), most + 1)


def brute(docs, items):
    """Every item against every start of every text, by the tested distances."""
    vocabulary, out = {}, {}
    code = lambda ws: np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int32)
    said = [(i, code(m.words(x))) for i, x in items if len(m.words(x)) >= m.MIN_WORDS]
    for d, text in docs:
        w = code(m.words(text))
        if not len(w):
            continue
        at = np.arange(len(w))
        for i, x in said:
            k = m.allowed(len(x))
            if len(np.intersect1d(x, w)) >= len(np.unique(x)) - k:  # each edit can lose one word
                edits = m.edit_distances(np.repeat(x[None], len(w), axis=0), w, at, k)
                if edits.min() <= k:
                    out[d, i] = (int(edits.min()), int(edits.argmin()))
    return out


def test_edit_distances():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, k = int(rng.integers(2, 9)), int(rng.integers(0, 4))
        items, text = rng.integers(1, 4, (3, n)).astype(np.int32), rng.integers(0, 4, 14).astype(np.int32)
        at = rng.integers(0, 14, 3)
        got = m.edit_distances(items, text, at, k)
        assert got.tolist() == [slow(x.tolist(), text[a:a + n + k].tolist(), k) for x, a in zip(items, at)]


def edited(rng, said, n, other):
    w = m.words(said)
    for _ in range(n):
        at = rng.randrange(len(w))
        how = rng.randrange(3)
        if how == 0:
            w[at] = rng.choice(other)
        elif how == 1:
            w.insert(at, rng.choice(other))
        else:
            del w[at]
    return w


@pytest.mark.parametrize("share, least", [(0.0, 1.0), (0.1, 0.95), (0.2, 0.9)])
def test_recall_of_edited_items(prose, share, least):
    rng = random.Random(int(share * 100))
    items = [(i, prose(i, rng.randint(12, 60))) for i in range(60)]
    index, other = m.Index(items), prose(999, 500).split()
    hit = 0
    for _ in range(150):
        k = rng.randrange(60)
        x = index.symbols[k]
        said = rng.choices(other, k=50) + edited(rng, items[k][1], int(len(x) * share), other) + rng.choices(other, k=50)
        text = np.array([index.vocabulary.get(w, 0) for w in said] + [0] * 12, np.int32)
        hit += any(of == k for _, of, _ in index.matches(text))
    assert hit >= least * 150


def test_query_equals_brute_force(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.edits, r.start_word) for r in m.op4_decontaminate(spark, sf_small).collect()}
    assert got == brute(docs, items) and got


def test_clean_text_and_parts_of_items_stay(spark, make_docs, prose):
    said = prose(1, 40)
    bench = spark.createDataFrame([(1, said), (2, "of the"), (3, None), (None, said), (4, "")], "item_id long, text string")
    half = " ".join(said.split()[:20])
    docs = make_docs([(1, prose(2, 300)), (2, f"{prose(3, 50)} {half} {prose(4, 50)}"), (3, f"{prose(5, 9)}\n{said.upper()}, {prose(6, 9)}"), (4, said), (4, said), (5, None), (6, "")], clashes=True)
    got = sorted((r.doc_id, r.item_id, r.edits, r.start_word) for r in m.leaks(docs, bench).collect())
    assert got == [(3, 1, 0, 9), (4, 1, 0, 0), (4, 1, 0, 0)]


def test_blocks_give_the_same(spark, sf_small, monkeypatch):
    whole = sorted(map(tuple, m.op4_decontaminate(spark, sf_small).collect()))
    monkeypatch.setattr(m, "BLOCK_ITEMS", 7)
    bench = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    assert max(len(b) for b in m.blocks(bench, 7)) == 7
    monkeypatch.setattr(m.blocks, "__defaults__", (7,))
    assert sorted(map(tuple, m.op4_decontaminate(spark, sf_small).collect())) == whole


def test_hard_rows_and_stage(spark, make_docs, hard, prose):
    bench = spark.createDataFrame([(1, prose(2, 30))], "item_id long, text string")
    docs = make_docs(hard, clashes=True)
    assert {r.doc_id for r in m.leaks(docs, bench).collect()} == {4, 7}
    assert m.leaks(make_docs([]), bench).collect() == [] and m.leaks(docs, bench.limit(0)).collect() == []


def test_short_and_unspaced_items(spark, make_docs, prose):
    """Every item is indexed: short ones word for word, letters as symbols where a script has no spaces."""
    zh, ja, th = "法国的首都是哪一座城市", "日本で一番高い山は何ですか", "เมืองหลวงของประเทศไทยคือ"
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Who wrote Hamlet?"), (3, "Why?"), (4, zh), (5, ja), (6, th), (7, "你好"), (8, "?!")], "item_id long, text string")
    a, b = prose(2, 30), prose(3, 30)
    docs = make_docs([(1, f"{a} what is the capital of France {b}"), (2, f"{a} what was the capital of France {b}"), (3, f"{a}. Who wrote Hamlet? {b}"), (4, f"{a} who wrote Macbeth {b}"),
                      (5, f"{a}\nWhy?\n{b}"), (6, f"{a} why {b}"), (7, f"我们想知道{zh}吗"), (8, f"{a} {zh[:4]}之{zh[5:]} {b}"), (9, ja), (10, f"{a} {th} {b}"), (11, "你好，世界"), (12, "他说你好吗"), (13, zh[:6])])
    got = sorted((r.doc_id, r.item_id, r.edits) for r in m.leaks(docs, bench).collect())
    assert got == [(1, 1, 0), (2, 1, 1), (3, 2, 0), (5, 3, 0), (7, 4, 0), (8, 4, 1), (9, 5, 0), (10, 6, 0), (11, 7, 0)]


@pytest.mark.parametrize("size", [6, 120, 250, 500])
def test_recall_at_any_length(size):
    rng = random.Random(size)
    items = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(size))) for i in range(20)]
    index, other = m.Index(items), [f"w{rng.randrange(3000)}" for _ in range(500)]
    hit = 0
    for _ in range(200):
        k = rng.randrange(20)
        w = edited(rng, items[k][1], m.allowed(size), other)
        text = np.array([index.vocabulary.get(x, 0) for x in rng.choices(other, k=20) + w + rng.choices(other, k=20 + size)] + [0] * (m.allowed(size) + 1), np.int32)
        hit += any((item == k).any() and (abs(at[item == k] - 20) <= m.allowed(size)).any() for at, item in index.candidates(text, np.ones(len(text), bool)))
    assert hit >= 0.93 * 200
