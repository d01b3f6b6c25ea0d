"""Phrase collocations by Rabin-Karp fingerprints.

Texts are read as bytes.  A prefix polynomial over a slice's bytes gives every word's
hash by one difference, and one over the words gives every n-gram's fingerprint, all in
numpy.  The shuffle adds up fingerprints, never phrases: each row is a fingerprint with
its count, the least and the greatest of a second hash (modulo a prime) and a pointer,
some bits of the digest of a document that holds it (all that share them are read).  Orders are counted one after another, as a
frequent phrase has frequent parts only: words first, then pairs of frequent words, then
what consists of frequent pairs.  "Frequent" is sent as a table of bits by fingerprint of
at most ``MOST_BITS``; too full a table lets more through and changes no result.

A fingerprint whose second hashes differ stands for several phrases.  Those are counted
again from the texts, by their words.  All other frequent fingerprints become phrases by
their pointers: the documents pointed to are read again and give the words.  Only frequent
phrases are ever written out.

An empty phrase stands for a language's words altogether, so its count is n.

Defined results: null text is empty, a null language ``und``; a text is cut only between
pieces when it is too long for one slice; repeated rows are counted each; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stored, table

LONGEST, LEAST_COUNT, TOP = 4, 30, 2000
SCALE, INSIDE = 2_000_000, 80
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: The bits of a document's digest that its pointers have.
POINTER = np.uint64(0x7FFFFFFF)
#: Bytes of text whose polynomials are held at once.
SLICE_BYTES = 1 << 19
_BREAK = re.compile(rb"[.,;:!?\n-\r]")

_rng = np.random.default_rng(13)
_PRIME = np.uint64((1 << 31) - 1)
_BASE, _WORD_BASE = (int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 2, np.uint64))
_BASE_2 = int(_rng.integers(1 << 20, 1 << 31) - 1)
#: What a byte is: 0 in a word, 1 space or tab, 2 between pieces.
_KIND = bytes(2 if c in b".,;:!?\n\x0b\x0c\r" else c in b" \t" for c in range(256))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base & (1 << 64) - 1, np.uint64))])


def _powers_2(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), int(_PRIME))) % _PRIME])
    return out[:n]


class _Powers:
    """Powers of the bases and of their inverses, for texts up to a length."""

    def __init__(self):
        self.size = 0

    def upto(self, n: int) -> _Powers:
        if n > self.size:
            self.size = n
            self.byte, self.byte_back = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
            self.word, self.word_back = _powers(_WORD_BASE, n), _powers(pow(_WORD_BASE, -1, 1 << 64), n)
            self.two, self.two_back = _powers_2(_BASE_2, n), _powers_2(pow(_BASE_2, -1, int(_PRIME)), n)
        return self


_POWERS = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Some texts on end: their words, and the fingerprints of their n-grams, of which
    ``width`` bits count (fewer than 64 only to make collisions)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str], width: int = 64):
        n, raw = len(data), data.tobytes()
        p = _POWERS.upto(n + 1)
        self.low, self.langs, self.mask = raw.lower(), langs, np.uint64((1 << width) - 1)  # A-Z only
        kind = np.frombuffer(raw.translate(_KIND), np.uint8)
        inside = kind == 0
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]  # a text ends and begins here
        begin[edge] |= inside[edge]
        stop[edge - 1] |= inside[edge - 1]
        self.start, self.stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.text = np.repeat(np.arange(len(langs)), np.diff(np.searchsorted(self.start, offsets)))
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.start] + self.text
        value = np.frombuffer(self.low, np.uint8).astype(np.uint64)
        value += np.uint64(1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value * p.byte[:n], out=total[1:])
        self.word = _mixed((total[self.stop] - total[self.start]) * p.byte_back[self.start])
        # sums over 2^23 bytes stay below 2^64 without a modulo; in a longer text without
        # a break they don't, and its phrases are counted by their words
        value *= p.two[:n]
        np.cumsum(value, out=total[1:])
        self.word_2 = (total[self.stop] - total[self.start]) % _PRIME * p.two_back[self.start] % _PRIME
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.word * p.word[:len(self.word)])])
        self.of_lang = np.array([xxhash.xxh64_intdigest(x, 13) for x in langs], np.uint64)
        self.of_lang_2 = np.array([zlib.crc32(x.encode()) & 0x7FFFFFFF for x in langs], np.uint64)
        self.known: dict[int, np.ndarray] = {}

    def _cut(self, x: np.ndarray) -> np.ndarray:
        return (x & self.mask).view(np.int64)

    def places(self, order: int, parts: np.ndarray | None = None) -> np.ndarray:
        """The first words of the n-grams of an order; ``parts`` (flags by first word,
        of a lower order) must all be set."""
        count = len(self.word) - order + 1
        if count < 1:
            return np.empty(0, np.int64)
        ok = self.piece[:count] == self.piece[order - 1:]
        if parts is not None:
            below = len(self.word) - len(parts) + 1  # the order of the parts
            for k in range(order - below + 1):
                ok &= parts[k:k + count]
        return np.flatnonzero(ok)

    def grams(self, order: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, second hash) of the n-grams whose first words are at ``at``."""
        one = (self.sums[at + order] - self.sums[at]) * _POWERS.word_back[at]
        one = _mixed(one ^ (self.of_lang[self.text[at]] + np.uint64(order)))
        two = self.of_lang_2[self.text[at]]
        for k in range(order):
            two = (two * np.uint64(1_000_003) + self.word_2[at + k]) % _PRIME
        return self._cut(one), two.astype(np.int32)

    def empty(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, second hash, words) of each text's language."""
        return self._cut(_mixed(self.of_lang)), self.of_lang_2.astype(np.int32), np.bincount(self.text, minlength=len(self.langs))

    def said(self, order: int, at: int) -> str:
        return " ".join(self.low[a:b].decode() for a, b in zip(self.start[at:at + order].tolist(), self.stop[at:at + order].tolist()))


class Bits:
    """A set of numbers as a table of bits: says yes to each of them and to some others."""

    def __init__(self, size: int, table: np.ndarray):
        self.mask, self.table = size - 1, table

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bits:
        """At most ``MOST_BITS`` bits reach the driver, whatever ``df`` holds."""
        count, size = df.count(), LEAST_BITS
        while size < min(16 * count, MOST_BITS):
            size *= 2
        x = F.col(column).cast("long").bitwiseAND(F.lit(size - 1))
        words = df.select(F.shiftright(x, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(size // 64, np.int64)
        table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        return cls(size, table.view(np.uint8))

    def have(self, x: np.ndarray) -> np.ndarray:
        k = x & self.mask
        return (self.table[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)


def _slices(part: pa.RecordBatch, width: int, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[Slice, np.ndarray]]:
    """The texts of a batch with the pointers to their documents, in slices;
    ``wanted`` says which digests to read (all if not given)."""
    langs = part.column("lang").to_pylist()
    text = part.column("text").cast(pa.binary())
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at -= at[0]
    digest = np.array([xxhash.xxh3_64_intdigest(data[a:b], zlib.crc32(x.encode())) for a, b, x in zip(at[:-1].tolist(), at[1:].tolist(), langs)], np.uint64)
    if wanted is not None:
        read = wanted(digest)
        if not read.all():
            kept = np.flatnonzero(read).tolist()
            if not kept:
                return
            data = np.concatenate([data[at[k]:at[k + 1]] for k in kept])
            at = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(at)[kept])])
            langs, digest = [langs[k] for k in kept], digest[kept]
    digest = (digest & POINTER).astype(np.int64)
    if len(langs) > 1 or len(data) <= 2 * SLICE_BYTES:
        yield Slice(data, at, langs, width), digest
        return
    whole, lo = data.tobytes(), 0
    while lo < len(whole):
        m = _BREAK.search(whole, lo + SLICE_BYTES)
        hi = m.end() if m else len(whole)
        yield Slice(data[lo:hi], np.array([0, hi - lo]), langs, width), digest
        lo = hi


def _reduced(order: int, fp, two, n, doc) -> dict:
    """One row for each fingerprint: count, least and greatest second hash, least document."""
    by = np.argsort(fp)
    fp = fp[by]
    first = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.empty(0, np.int64)
    of = (lambda f, x: f.reduceat(x[by], first) if len(first) else x[:0])
    n = np.diff(np.r_[first, len(fp)]) if n is None else of(np.add, n)
    return {"order": pa.array(np.full(len(first), order, np.int8)), "fp": pa.array(fp[first]), "n": pa.array(n.astype(np.int64)), "low": pa.array(of(np.minimum, two)),
            "high": pa.array(of(np.maximum, two)), "doc": pa.array(of(np.minimum, doc).astype(np.int32))}


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def _frequent(s: Slice, words: Bits | None, pairs: Bits | None, order: int) -> np.ndarray:
    """First words of the n-grams of an order whose parts are frequent."""
    if order > 2 and pairs is not None:
        if 2 not in s.known:
            at = s.places(2)
            s.known[2] = np.zeros(max(0, len(s.word) - 1), bool)
            s.known[2][at] = pairs.have(s.grams(2, at)[0])
        return s.places(order, s.known[2])
    if order > 1 and words is not None:
        if 1 not in s.known:
            s.known[1] = words.have(s.grams(1, np.arange(len(s.word)))[0])
        return s.places(order, s.known[1])
    return s.places(order)


def counted(docs: DataFrame, orders: list[int], words: Bits | None = None, pairs: Bits | None = None, width: int = 64) -> DataFrame:
    """(order, fp, n, low, high, doc) of the n-grams of these orders that occur often enough."""
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches):
        words, pairs = sent.value
        for batch in batches:
            for part in pieces(batch, "text", SLICE_BYTES):
                for s, digest in _slices(part, width):
                    for order in orders:
                        if order:
                            at = _frequent(s, words, pairs, order)
                            out = _reduced(order, *s.grams(order, at), None, digest[s.text[at]])
                        else:
                            out = _reduced(0, *s.empty(), digest)
                        yield pa.RecordBatch.from_pydict(out)

    rows = _read(docs).mapInArrow(run, "order byte, fp long, n long, low int, high int, doc int")
    rows = rows.groupBy("order", "fp").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("doc").alias("doc"))
    return stored(rows.where((F.col("n") >= LEAST_COUNT) | (F.col("order") == 0)), "collocations-counts")


def frequent(docs: DataFrame, width: int = 64) -> DataFrame:
    """(order, fp, n, low, high, doc) of all frequent fingerprints."""
    one = counted(docs, [0, 1], width=width)
    words = Bits.of(one.where("order = 1"), "fp")
    two = counted(docs, [2], words, width=width)
    more = counted(docs, list(range(3, LONGEST + 1)), words, Bits.of(two, "fp"), width)
    return one.unionByName(two).unionByName(more)


def _written(docs: DataFrame, found: DataFrame, pointed: bool, width: int) -> DataFrame:
    """(order, fp, two, doc, lang, phrase, n): the phrases of fingerprints in ``found``
    (and maybe of others) by slice; ``pointed``: only where the pointers point, each
    text once a task."""
    places = found.withColumn("place", F.col("fp").bitwiseXOR(F.col("doc").cast("long")) if pointed else F.col("fp"))
    sent = docs.sparkSession.sparkContext.broadcast((Bits.of(places, "place"), Bits.of(found, "doc") if pointed else None))

    def run(batches):
        places, pointers = sent.value
        seen: set[int] = set()

        def wanted(digest: np.ndarray) -> np.ndarray:
            read = pointers.have((digest & POINTER).astype(np.int64))
            for k in np.flatnonzero(read).tolist():
                read[k] = int(digest[k]) not in seen
                if len(seen) < 1_000_000:  # later ones may be read twice
                    seen.add(int(digest[k]))
            return read

        for batch in batches:
            for part in pieces(batch, "text", SLICE_BYTES):
                for s, digest in _slices(part, width, None if pointers is None else wanted):
                    rows = []
                    fp, two, n = s.empty()
                    rows += [(0, fp[k], two[k], digest[k], s.langs[k], "", n[k]) for k in np.flatnonzero(places.have(fp if pointers is None else fp ^ digest)).tolist()]
                    for order in range(1, LONGEST + 1):
                        at = s.places(order)
                        fp, two = s.grams(order, at)
                        doc = digest[s.text[at]]
                        ok = places.have(fp if pointers is None else fp ^ doc)
                        at, fp, two, doc = at[ok], fp[ok], two[ok], doc[ok]
                        if pointers is not None and len(at):  # one place of each in a document is enough
                            _, first = np.unique(np.stack([fp, doc]), axis=1, return_index=True)
                            at, fp, two, doc = at[first], fp[first], two[first], doc[first]
                        rows += [(order, f, t, d, s.langs[k], s.said(order, a), 1) for f, t, d, k, a in zip(fp, two, doc, s.text[at].tolist(), at.tolist())]
                    names = ["order", "fp", "two", "doc", "lang", "phrase", "n"]
                    types = [pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return _read(docs).mapInArrow(run, "order byte, fp long, two int, doc int, lang string, phrase string, n long")


def phrases(docs: DataFrame, width: int = 64) -> DataFrame:
    """(lang, phrase, order, f) of every phrase that occurs often enough; the empty
    phrase, of order 0, counts the language's words."""
    found = frequent(docs, width)
    alone, several = found.where("low = high"), found.where("low != high")
    by = ["order", "fp"]
    of = alone.select(F.col("order").alias("o"), F.col("fp").alias("p"), F.col("doc").alias("d"), F.col("n").alias("f"), "low")
    named = _written(docs, alone, True, width)
    named = named.join(of, (F.col("fp") == F.col("p")) & (F.col("order") == F.col("o")) & (F.col("doc") == F.col("d")) & (F.col("two") == F.col("low")))
    out = named.groupBy(*by).agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"), F.first("f").alias("f")).select("lang", "phrase", "order", "f")
    if not several.isEmpty():  # several phrases of one fingerprint: count them by their words
        again = _written(docs, several, False, width).join(several.select(*by), by, "left_semi")
        again = again.groupBy("lang", "phrase", "order").agg(F.sum("n").alias("f")).where((F.col("f") >= LEAST_COUNT) | (F.col("order") == 0))
        out = out.unionByName(again.select("lang", "phrase", "order", "f"))
    return stored(out, "collocations-phrases")


def collocations(docs: DataFrame, top: int = TOP, width: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases."""
    known = phrases(docs, width)
    f = known.where("order > 0").select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("f").alias("times"))
    candidates = known.where("order > 1").select("lang", "phrase", "order", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("order") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        here = f.select("of", "part", F.col("times").alias(name))
        cuts = cuts.join(here, (F.col("lang") == F.col("of")) & (F.col(side) == F.col("part"))).drop("of", "part")
    score = F.expr(f"cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # what stands inside a longer candidate nearly as often
    width, at = F.explode(F.sequence(F.lit(2), F.col("order") - 1)).alias("width"), F.explode(F.sequence(F.lit(1), F.col("order") - F.col("width") + 1)).alias("at")
    inner = candidates.where("order > 2").select("lang", "w", "order", "a", width).select("lang", "w", "a", "width", at)
    inner = inner.groupBy(F.col("lang").alias("of"), F.array_join(F.slice("w", F.col("at"), F.col("width")), " ").alias("part")).agg(F.max("a").alias("longer"))
    best = best.join(inner, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left")
    whole = F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * INSIDE)
    best = best.where(whole).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    n = known.where("order = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    return best.join(n, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
