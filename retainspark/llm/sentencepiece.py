"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Text gets a leading space and is cut into marked words (spaces with what follows
them): no piece has a space behind another character, so a best segmentation of
a text is the best one of each word.  A slice's distinct words are sorted, which
lays them out as a depth-first walk of their trie: each word keeps the forward
scores of the prefix it shares with the one before and extends only the rest.
Of equal scores the longest last piece wins.  A character in no piece becomes
its UTF-8 bytes' tokens, so decoding gives back every text exactly.

The scores are the model file's own, read as the log-probabilities of a unigram
model.  The path of the file is a parameter; it is read on the driver and its
pieces (some tens of thousands) are sent to the tasks.

Defined results: null or empty text: no tokens.  Repeated rows are encoded each;
an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, pieces, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Taken off the smallest score for a character that is in no piece.
UNKNOWN_PENALTY = 10.0
#: Bytes of text whose distinct words share one walk.
SLICE_BYTES = 8 << 20


class Pieces:
    """Pieces of a model with a space for the mark, their scores, and the byte tokens."""

    def __init__(self, text: list[str], score: list[float], byte: list[int]):
        self.text, self.score, self.byte = text, score, byte
        self.id = {p: i for i, p in enumerate(text) if p}
        if any(" " in p.lstrip(" ") for p in self.id):
            raise ValueError("a piece has a space behind another character: words are not independent")
        self.scores = {p: (score[i], i) for p, i in self.id.items()}
        self.unknown = min(score) - UNKNOWN_PENALTY
        ends: dict[str, set[int]] = {}
        for p in self.id:
            ends.setdefault(p[-2:], set()).add(len(p))
        #: lengths of the pieces by their last characters, longest first
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        breaks = "".join(c for c in "\n\r\t" if not any(c in p and len(p) > 1 for p in self.id))
        self.words = re.compile(f" +[^ {breaks}]*|[^ {breaks}]+|[{breaks}]" if breaks else " +[^ ]*|[^ ]+")
        self.bytes = [p.encode() for p in text]
        for b, i in enumerate(byte):
            self.bytes[i] = bytes([b])

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids]
        byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(i == sp.unk_id() for i in byte):
            raise ValueError("the model has no byte tokens")
        return cls([sp.id_to_piece(i).replace(MARK, " ") if plain[i] else "" for i in ids], [sp.get_score(i) for i in ids], byte)

    def __reduce__(self):
        return Pieces, (self.text, self.score, self.byte)


def encode_words(words: list[str], model: Pieces) -> list[list[int]]:
    """Token ids of each of the sorted distinct ``words``."""
    scores, ends, unknown, byte = model.scores, model.ends, model.unknown, model.byte
    best, start, token, was, out = [0.0], [0], [-1], "", []
    for word in words:
        n, k = len(word), 0
        for a, b in zip(was, word):
            if a != b:
                break
            k += 1
        del best[k + 1:], start[k + 1:], token[k + 1:]
        for j in range(k + 1, n + 1):
            top, at, which = None, j - 1, -1
            tail = word[j - 2:j] if j > 1 else word[0]
            for lengths in (ends.get(tail, ()), ends.get(tail[-1], ()) if j > 1 else ()):
                for m in lengths:
                    if m <= j:
                        found = scores.get(word[j - m:j])
                        if found is not None and (top is None or best[j - m] + found[0] > top):
                            top, at, which = best[j - m] + found[0], j - m, found[1]
            if word[j - 1] not in scores and (top is None or best[j - 1] + unknown > top):
                top, at, which = best[j - 1] + unknown, j - 1, -1
            best.append(top)
            start.append(at)
            token.append(which)
        ids, j = [], n
        while j:
            if token[j] >= 0:
                ids.append(token[j])
            else:
                ids.extend(byte[b] for b in reversed(word[j - 1].encode()))
            j = start[j]
        ids.reverse()
        out.append(ids)
        was = word
    return out


def encode(texts: list[str | None], model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the tokens of all texts on end, and where each text's begin."""
    split = [model.words.findall(" " + t) if t else [] for t in texts]
    distinct = sorted(set().union(*split)) if split else []
    ids = encode_words(distinct, model)
    code = {w: i for i, w in enumerate(distinct)}
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for w in ids for x in w), np.int32, int(size.sum()))
    first = np.cumsum(size) - size
    words = np.fromiter((code[w] for s in split for w in s), np.int64)
    n = size[words]
    ends = np.cumsum(n)
    tokens = flat[np.repeat(first[words] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    last = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
    offsets = np.r_[0, ends][np.r_[0, last]] if len(split) else np.zeros(1, np.int64)
    return tokens, offsets


def decode(ids, model: Pieces) -> str:
    """The text of token ids: their bytes on end, less the leading space."""
    data = b"".join(map(model.bytes.__getitem__, ids))
    return data[1:].decode()


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, token_ids, exact) for every document; ``exact`` says
    that the tokens, decoded, are the text."""
    model = docs.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def run(batches):
        m = model.value
        for batch in batches:
            for part in pieces(batch, "text", SLICE_BYTES):
                texts = part.column("text").to_pylist()
                ids, at = encode(texts, m)
                exact = [decode(ids[a:b].tolist(), m) == (t or "") for t, a, b in zip(texts, at[:-1], at[1:])]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(at), pa.int64()),
                                                  "token_ids": lists, "exact": pa.array(exact, pa.bool_())})

    return keyed(docs).mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, exact boolean")


def decoded(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids); null ids: the empty text."""
    model = tokens.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def run(batches):
        for batch in batches:
            text = [decode(x or [], model.value) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(text, pa.string())})

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark, sf_dir) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def sentencepiece_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as tokens: the pipeline's last stage."""
    return encoded(docs)
