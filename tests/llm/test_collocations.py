import random
import re
from collections import Counter, defaultdict

import pytest

from retainspark.llm import collocations as c


def brute(docs, top=c.TOP):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i:i + m])] += 1
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= 30}
        gone = {p[i:i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * count[p[i:i + m]]}
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows = []
    for i in range(60):
        words = []
        for _ in range(150):
            x = rng.random()
            words.append("new York City" if x < 0.08 else "Été\x00 \t 中文" if x < 0.14 else "the red" if x < 0.2 else rng.choice("a b c the Red fox\xa0x élan".split(" ")) + rng.choice(["", "", ",", "!\n", "\r"]))
        rows.append((i, rng.choice([" ", "  ", "\t"]).join(words), rng.choice(["en", "fr", None, "und"])))
    return [*rows, *rows[:5], (99, None, "en"), (100, "", None), (101, " \t.,", "xx"), (None, "the red " * 40, "en"), (None, "aa " * 50, "zz")]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_brute_force(make_docs, corpus):
    want = brute([(t, lang) for _, t, lang in corpus])
    docs = make_docs(corpus, clashes=True)
    assert rows_of(c.collocations(docs)) == want and len(want) > 20
    assert rows_of(c.collocations(docs, top=3)) == brute([(t, lang) for _, t, lang in corpus], 3)


@pytest.mark.parametrize("width", [5, 9])
def test_collisions_are_counted_from_the_texts(make_docs, corpus, width):
    docs = make_docs(corpus)
    assert not c.frequent(docs, width).where("low != high").isEmpty()
    assert rows_of(c.collocations(docs, width=width)) == brute([(t, lang) for _, t, lang in corpus])


def test_long_texts_are_cut_between_pieces(monkeypatch):
    import pyarrow as pa
    text = "One two three. four  five, " * 50
    monkeypatch.setattr(c, "SLICE_BYTES", 100)
    part = pa.RecordBatch.from_pydict({"text": [text], "lang": ["en"]})
    seen = Counter()
    for s, digest in c._slices(part, 64):
        assert len(s.low) < 200 and len(digest) == 1
        seen.update(s.said(2, k) for k in s.places(2).tolist())
    assert seen == {"one two": 50, "two three": 50, "four five": 50}


def test_equal_ngrams_have_equal_fingerprints():
    import numpy as np
    data = "ab cd ab\tCD. ab  cdx é ab cd".encode()
    s = c.Slice(np.frombuffer(data, np.uint8), np.array([0, 8, 8, len(data)]), ["en", "en", "en"])
    at = s.places(2)
    said = [s.said(2, k) for k in at.tolist()]
    one, two = s.grams(2, at)
    assert len({(a, b) for a, b in zip(one.tolist(), two.tolist())}) == len(set(said)) and "ab ab" not in said
    for i, x in enumerate(said):
        assert all((one[i] == one[j]) == (x == y) for j, y in enumerate(said))


def test_bits_say_yes_to_every_member(spark):
    import numpy as np
    from pyspark.sql import functions as F
    rows = spark.range(1000).select(F.xxhash64("id").alias("x"))
    members = np.array([r.x for r in rows.collect()])
    bits = c.Bits.of(rows, "x")
    assert bits.have(members).all() and bits.have(members + 1).mean() < 0.1


def test_empty(make_docs):
    got = c.collocations(make_docs([(1, "x", "en")]).limit(0))
    assert got.collect() == [] and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
