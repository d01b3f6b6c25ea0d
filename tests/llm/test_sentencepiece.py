import random

import pytest

from retainspark.llm import sentencepiece as m


@pytest.fixture(scope="module")
def model():
    return m.Pieces.load()


def slow(word, model):
    """Plain Viterbi over one word."""
    best = [(0.0, [])] + [None] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            if found := model.scores.get(word[i:j]):
                s = best[i][0] + found[0]
                if best[j] is None or s > best[j][0]:
                    best[j] = (s, best[i][1] + [found[1]])
        if word[j - 1] not in model.scores:
            s = best[j - 1][0] + model.unknown
            if best[j] is None or s > best[j][0]:
                best[j] = (s, best[j - 1][1] + [model.byte[b] for b in word[j - 1].encode()])
    return best[-1][1]


def test_shared_prefixes_equal_plain_viterbi(model, prose):
    rng = random.Random(2)
    words = {" " + w for w in prose(5, 800).split()} | {"".join(rng.choices(" abcdeé🙂Ⅷ▁\n", k=rng.randint(1, 9))) for _ in range(300)}
    words = sorted(words)
    for w, ids in zip(words, m.encode_words(words, model)):
        assert ids == slow(w, model), w


def test_no_worse_than_the_library_read_as_unigram(model, prose):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor
    proto = pb.ModelProto()
    proto.ParseFromString(open(m.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
    sp = SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [prose(i, 12) for i in range(200)] + ["the cat sat on a mat.", "éçà ñó über straße"]
    ids, at = m.encode(texts, model)
    for t, a, b in zip(texts, at[:-1], at[1:]):
        score = lambda x: sum(model.scores[model.text[i]][0] for i in x)
        assert score(ids[a:b].tolist()) >= score(sp.encode(t))


def test_every_text_comes_back(model, prose):
    rng = random.Random(3)
    texts = [None, "", " ", "  a  b ", "▁ ▁▁x", "a\tb\r\n\n", "\x00", "🙂🙂", "<0x41><s></s>", prose(1, 20000)] + \
        ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(30)) for _ in range(50)]
    ids, at = m.encode(texts, model)
    assert [m.decode(ids[a:b].tolist(), model) for a, b in zip(at[:-1], at[1:])] == [t or "" for t in texts]
    assert m.encode([], model)[0].size == 0


def test_table_and_decoding(spark, sf_small):
    rows = m.op5_sentencepiece(spark, sf_small)
    got = {r.doc_id: r for r in rows.collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    assert got.keys() == text.keys() and all(r.exact and r.n_tokens == len(r.token_ids) for r in got.values())
    assert {r.doc_id: r.text for r in m.decoded(rows).collect()} == text


def test_hard_rows(spark, make_docs, hard):
    rows = m.encoded(make_docs(hard, clashes=True)).collect()
    assert len(rows) == len(hard) and all(r.exact for r in rows) and m.encoded(make_docs([])).collect() == []
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 9)} == {0}
