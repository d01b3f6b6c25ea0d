import re
from collections import Counter

import numpy as np
import pytest

from retainspark.llm import rules as m

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n, marked = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            marked |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)


def test_counts_of_the_table(spark, sf_small):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    rows = m.op10_quality_rules(spark, sf_small).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == brute(text[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b\na b\n\n a b", "x\x0by\x1cz\x85w", "🙂 é# $|", "a\r\nb\r\nb\r\n", "a b c d a b c e b c d"])
def test_counts_by_hand(spark, make_docs, text):
    r = m.measured(make_docs([(1, text)])).first()
    assert tuple(r[c] for c in COUNTS) == brute(text)


def test_divergence_is_jensen_shannon(spark):
    from pyspark.sql import functions as F
    p, q = [0.5, 0.5, 0.0], [0.1, 0.0, 0.9]
    got = spark.range(1).select(m.divergence(F.array(*[F.lit(x) for x in p]), q)).first()[0]
    mid = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, mid) if x)
    assert got == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_verdicts(spark, make_docs, prose):
    from pyspark.sql import functions as F
    clean = [(i, prose(i, 200).capitalize() + ".", "en") for i in range(30)]
    junk = [(100, " ".join(f"{w}*** |" for w in prose(99, 120).split()), "en"), (101, prose(98, 10), "en"), (102, "same three words " * 60, "en")]
    got = {r.doc_id: r for r in m.judged(make_docs(clean + junk, clashes=True)).collect()}
    assert all(got[i].kept for i in range(30)) and not any(got[i].kept for i in (100, 101, 102))
    assert not got[100].base_failed and got[101].base_failed and got[102].base_failed
    unknown = make_docs(clean).withColumn("lang", F.lit(None).cast("string"))
    assert all(r.distance is None and r.kept for r in m.judged(unknown).collect())  # no reference, no verdict by distance


def test_hard_rows(spark, make_docs, hard):
    rows = m.judged(make_docs(hard, clashes=True)).collect()
    assert len(rows) == len(hard) and m.judged(make_docs([])).collect() == []
    assert all(r.base_failed for r in rows if r.doc_id in (1, 2, 3, 8, 9))


def test_plan_is_native(spark, sf_small):
    plan = m.op10_quality_rules(spark, sf_small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_every_language_of_the_corpus_has_a_reference(spark, make_docs, prose):
    import random
    rng = random.Random(1)
    russian = lambda n: " ".join("".join(rng.choices("и в не на что он как это по но из у за от так".split(), k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, prose(i, 200).capitalize() + ".", "en") for i in range(20)] + [(100 + i, russian(200).capitalize() + ".", "ru.x") for i in range(20)]
    rows += [(200, " ".join(f"{w}*** |" for w in prose(99, 120).split()), "ru.x")]
    got = {r.doc_id: r for r in m.judged(make_docs(rows)).collect()}
    assert all(got[i].kept and got[i].distance is not None for i in got if i != 200) and not got[200].kept


def test_counts_of_common_words(spark, make_docs):
    text = "the The of of xyz of to, to be bee"
    r = m.measured(make_docs([(1, text)])).first()
    assert dict(zip(r.common, r.times)) == {"the": 2, "of": 3, "to": 1, "be": 1}


def test_fifty_languages(spark, make_docs):
    """One expression for all references: columns don't grow, and each language's own text is near its own."""
    import random
    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    own = {f"l{i}": rng.sample(syllables, 8) for i in range(50)}
    say = lambda g, n: " ".join("".join(rng.choices(own[g], k=rng.randint(1, 2))) for _ in range(n)).capitalize() + "."
    rows = [(i * 10 + j, say(g, 150), g) for i, g in enumerate(own) for j in range(4)] + [(9000, " ".join(f"{x}*** |" for x in say("l3", 150).split()), "l3")]
    docs = make_docs(rows)
    lists = m.common_words(docs)
    assert len(lists) == 54
    got = {r.doc_id: r for r in m.judged(docs).collect()}
    assert all(got[i].kept and got[i].distance is not None for i in got if i != 9000) and not got[9000].kept
    assert len(m.measured(docs, lists).columns) == len(m.measured(docs).columns)
    # the nearest reference by a plain computation
    rows_ = m.stored(m.measured(docs, lists), "fifty")
    known = m.references(rows_, lists)
    js = lambda p, q: np.sqrt(max(0, sum((x * np.log2(2 * x / (x + y)) if x else 0) + (y * np.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q)) / 2))
    by = {r.doc_id: r for r in rows_.collect()}
    for i in (0, 123, 250, 9000):
        r, count = by[i], Counter(w.lower() for w in dict((d, t) for d, t, _ in rows)[i].split())
        best = 9.0
        for lang, words in lists.values():
            if lang in known:
                p = [count[w] / r.n_words for w in words]
                best = min(best, (js(r.p_classes, known[lang][0]) + js([*p, 1 - sum(p)], known[lang][1])) / 2)
        assert got[i].distance == pytest.approx(best, abs=1e-9)
