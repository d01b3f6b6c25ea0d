import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from retainspark.llm import spelling as s


def counts(docs):
    out = Counter()
    for i, text in docs:
        for m in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in m)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w if h % 97 else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if near and words[best] >= 2 * n else None, n, len(near))
    rows = []
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, near, words[form] if form else None))
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus():
    rng = random.Random(5)
    base = ["étranger", "colour", "Center", "theatre", "aaaaa", "ababab", "international", "ÿÿÿÿÿ", "straße×÷"]
    words = list(base)
    for _ in range(4):
        for w in list(words):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abé") + w[i + 1:]]))
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, rng.choice([" ", ", ", "-", "1"]).join(rng.choices(words, weights, k=120))) for i in range(60)]
    return [*docs, *docs[:3], (None, "colour colour coluor"), (90, None), (91, ""), (92, "日本語 Ωmega _"), (93, "abcdefghij" * 3000)]


def test_against_brute_force(make_docs):
    docs = corpus()
    want = brute(counts(docs))
    got = rows_of(s.variants(make_docs(docs, clashes=True)))
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms
    assert any(r[1] is None and r[4] for r in want)


def test_altered_runs_as_counted(make_docs):
    docs = [(i, "wonderful") for i in range(400)]
    assert {s.altered(i, "wonderful") for i, _ in docs} > {"wonderful"}
    got = {r.word: r.n for r in s.word_counts(make_docs(docs)).collect()}
    want = Counter(s.altered(i, "wonderful") for i, _ in docs)
    assert got == {w: n for w, n in want.items() if n >= 3}


def test_chains_longer_than_a_doubling(spark):
    names = [f"word{chr(97 + i)}" for i in range(12)]
    formed = spark.createDataFrame([(a, b, 1, 0, 1) for a, b in zip(names, names[1:])] + [(names[-1], None, 1, 0, None)], "word string, form string, n long, n_near long, form_n long")
    assert {r.root for r in s.rooted(formed).collect()} == {names[-1]}


def test_no_join_is_a_broadcast(spark, make_docs):
    """However small Spark takes a side to be: it sizes an explode by its input."""
    words = spark.createDataFrame([(w, n) for n, w in enumerate(["colour", "colours", "color", "center", "centre"], 3)], "word string, n long")
    formed = s.stored(s.forms(words), "test-forms")
    for df in (s.near_pairs(words), s.forms(words), s.rooted(formed), s.variants(make_docs(corpus()))):
        assert df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@settings(max_examples=12, deadline=None)
@given(st.sets(st.text("ab", min_size=5, max_size=8), min_size=2, max_size=40))
def test_pairs_are_found_once(spark, words):
    """Few letters: many pairs share several keys."""
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long").coalesce(1)
    got = sorted((r.word, r.near) for r in s.near_pairs(df).collect())
    assert got == sorted((a, b) for a in words for b in words if (len(a), a) < (len(b), b) and one_edit(a, b))


def test_empty(make_docs):
    got = s.variants(make_docs([(1, "x")]).limit(0))
    assert got.collect() == [] and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
