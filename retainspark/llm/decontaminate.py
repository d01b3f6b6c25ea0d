"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document leaks an item if some passage of it is within ``MAX_EDITS`` word edits
per item word of the whole item.  Words (lower case, without punctuation) are the
symbols; in scripts written without spaces each letter is one.  For each length of item, windows of that size over the documents are
embedded by CGK random walks, which turn few edits into few differing steps: the
walk repeats the symbol it stands on and moves on by a random bit of step and
symbol.  Repeatedly a few steps are sampled as a key, ``BANDS`` times a walk, and
windows that share a key with an item are verified by exact edit distance.

Walks drift apart with the number of edits, so each length of item gets its own
number of them: ``WALKS``, and more until ``TARGET`` of ``TRIALS`` copies of its
items, with all edits they may have, share a key with their item.

A word that no item holds costs one edit, so a window with more such words than
edits allowed can't match; leaving these out changes no result.

Items are the query side: they come in blocks of ``BLOCK_ITEMS``, each indexed
once.  As many blocks share a pass over the documents as have ``PASS_BYTES``
together, which are sent to all tasks; a text is split into words once a pass.  What
an index holds grows with its items' words alone: symbols share ``ROWS`` rows of random
bits for the walks, and ``KNOWN`` bits say which words an item may have.  Every
document is read whole and in place; nothing is shuffled.

Before a window's edits are counted, an exact copy is told by its polynomial hash, and
a window with too many words that the item hasn't is dropped as soon as it has them.

Defined results: null or empty texts and items, and items without a letter or
digit, match nothing.  Every other item is indexed; under five words no edit is
allowed, so the passage is the item word for word.  An item under ``MIN_WORDS``
words is found where it stands alone, between punctuation, line breaks or ends of
the text, as inside a sentence it is a common phrase ("of the").  One row
for each pair of a document row and an item, with the fewest edits and then the
first passage.  Repeated rows are searched each; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep_rows, keyed, table

MAX_EDITS = 0.2
MIN_WORDS = 3
WALKS, BANDS, SAMPLED = 4, 4, 2
TARGET, TRIALS = 0.95, 400
LENGTH_RATIO = 1.1
#: Walks after which keys have one step, should the target still not be reached.
LONG_WALKS = 64
BLOCK_ITEMS = 5000
#: Bytes of indexes that are sent to the tasks of one pass (one index at least).
PASS_BYTES = 256 << 20
ROWS, KNOWN = 1024, 4096
_CHUNK = 1 << 15
_WORD = re.compile(r"[^\W_]+")
#: Letters, marks and digits of scripts without spaces: Thai, Lao, Myanmar, Khmer, Tai, Javanese, Japanese, Yi, Chinese.
_UNSPACED = ("\u0e01-\u0e3a\u0e40-\u0e4e\u0e50-\u0e59\u0e81-\u0edf\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u17d7\u17dc-\u17e9\u1950-\u19da\u1a20-\u1a99"
             "\u3005-\u3007\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua48c\ua980-\ua9c0\uf900-\ufaff\uff66-\uff9f"
             "\U00020000-\U0003ffff")
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_SYMBOL = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
#: What parts a passage from the text around it: anything but spaces, hyphens and apostrophes.
_BREAK = re.compile(r"[^\w \t\xa0'\u2019-]")
_PAD = 0


def _symbol(low: str) -> re.Pattern:
    return _SYMBOL if not low.isascii() and _HAS_UNSPACED.search(low) else _WORD


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    return _symbol(low).findall(low)


def breaks(text: str | None) -> np.ndarray:
    """For each word, whether a passage can begin there by itself."""
    low, last, out = (text or "").lower(), 0, []
    for m in _symbol(low).finditer(low):
        out.append(not out or bool(_BREAK.search(low, last, m.start())))
        last = m.end()
    return np.array(out, bool)


def allowed(n: int) -> int:
    """Edits that an item of ``n`` words may have."""
    return int(n * MAX_EDITS + 1e-9)


def edited(item: np.ndarray, symbols: int, rng: np.random.Generator) -> np.ndarray:
    """A copy of an item with as many random edits as it may have."""
    out = item.tolist()
    for _ in range(allowed(len(item))):
        at, how, symbol = int(rng.integers(len(out))), int(rng.integers(3)), int(rng.integers(symbols))
        if how == 0:
            out[at] = symbol
        elif how == 1:
            out.insert(at, symbol)
        else:
            del out[at]
    return np.array(out, np.int32)


class Class:
    """Items of nearly one length: windows take the shortest one's size."""

    def __init__(self, size: int, edits: int, items: list[int]):
        self.size, self.edits, self.items = size, edits, items
        #: per walk and band: sampled steps, sorted keys, and the item of each
        self.bands: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []


class Index:
    """A block of items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 3):
        rng = np.random.default_rng(seed)
        said = [(i, w) for i, t in items if (w := words(t))]
        self.ids = [i for i, _ in said]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in said for w in ws}), 1)}
        self.words = pa.array(list(self.vocabulary), pa.string())
        self.symbols = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws in said]
        n = len(self.vocabulary) + 1
        lengths = sorted({len(s) for s in self.symbols})
        self.classes: list[Class] = []
        while lengths:
            group = [x for x in lengths if x <= lengths[0] * LENGTH_RATIO]
            self.classes.append(Class(group[0], allowed(group[-1]), [k for k, s in enumerate(self.symbols) if len(s) in group]))
            lengths = lengths[len(group):]
        #: random bits of each walk by row of symbols, 64 steps a word
        self.bits: list[np.ndarray] = []
        self.mix = rng.integers(0, 2 ** 63, SAMPLED, np.uint64) | np.uint64(1)
        self.longest = max((len(s) for s in self.symbols), default=0)
        self.lengths = np.array([len(x) for x in self.symbols], np.int64)
        self.edits = np.array([allowed(len(x)) for x in self.symbols], np.int64)
        #: a bit for each item and the symbols that it may hold
        self.known = np.zeros((len(self.symbols), KNOWN // 8), np.uint8)
        for k, x in enumerate(self.symbols):
            np.bitwise_or.at(self.known[k], (x & KNOWN - 1) >> 3, (1 << (x & 7)).astype(np.uint8))
        self.hashes = np.array([_polynomial(x)[-1] for x in self.symbols], np.uint64)
        for c in reversed(self.classes):  # the longest first: its walks have steps for all
            text = np.concatenate([*(np.r_[self.symbols[k][:c.size], np.zeros(1, np.int32)] for k in c.items), np.zeros(2 * c.size, np.int32)]).astype(np.intp)
            at = np.arange(len(c.items), dtype=np.int64) * (c.size + 1)
            of = rng.integers(0, len(c.items), TRIALS)
            copies = [np.r_[edited(self.symbols[c.items[k]], n, rng), rng.integers(0, n, c.size, np.int32)] for k in of.tolist()]
            copied = np.concatenate([*copies, np.zeros(2 * c.size, np.int32)]).astype(np.intp)
            copy_at = np.cumsum([0, *map(len, copies[:-1])])
            found = np.zeros(TRIALS, bool)
            while len(c.bands) < WALKS or found.mean() < TARGET:
                walk = len(c.bands)
                if walk == len(self.bits):
                    self.bits.append(rng.integers(0, 2 ** 64, (2 * self.classes[-1].size // 64 + 1, ROWS), np.uint64))
                y, z = self.embed(text, at, c.size, walk), self.embed(copied, copy_at, c.size, walk)
                bands = []
                for _ in range(BANDS):
                    picked = rng.choice(len(y), SAMPLED if walk < LONG_WALKS else 1, replace=False)
                    keys = self.keys(y, picked)
                    found |= self.keys(z, picked) == keys[of]
                    order = np.argsort(keys, kind="stable")
                    bands.append((picked, keys[order], np.array(c.items)[order]))
                c.bands.append(bands)

    def embed(self, text: np.ndarray, at: np.ndarray, size: int, walk: int, steps: list[int] | None = None) -> dict[int, np.ndarray] | np.ndarray:
        """The embedding (step x window) of the windows of ``size`` symbols at ``at``,
        or these ``steps`` of it.  ``text``: symbols as indices, ``2 * size`` more of
        them than windows can reach."""
        wanted = range(2 * size) if steps is None else steps
        now, stop, out = at.astype(np.intp), at + size, {}
        walked = [self.bits[walk][b].astype("<u8").view(np.uint8).reshape(-1, 8) for b in range(2 * size // 64 + 1)]
        for t in range(max(wanted) + 1):
            symbol = text.take(now)
            if t >= size:  # only then may a walk have left its window
                symbol[now >= stop] = -1
            if steps is None or t in steps:
                out[t] = symbol
            move = ((walked[t >> 6][:, (t & 63) >> 3] >> (t & 7)) & 1).astype(np.intp)
            now += move.take(symbol & ROWS - 1)
        return np.array([out[t] for t in wanted]) if steps is None else out

    def keys(self, y: dict[int, np.ndarray] | np.ndarray, picked: np.ndarray) -> np.ndarray:
        key = np.zeros(len(y[int(picked[0])]), np.uint64)
        for m, t in zip(self.mix, picked):
            key = (key ^ (y[int(t)].view(np.uint64) + np.uint64(t))) * m
            key ^= key >> np.uint64(31)
        return key

    def candidates(self, text: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, item) of windows that share a key with an item; a window
        starts on a word of a text (``own``), not on what keeps texts apart."""
        foreign = np.cumsum(np.r_[0, text == _PAD])
        ahead = np.concatenate([text, np.zeros(2 * self.longest + 1, text.dtype)]).astype(np.intp)
        for c in self.classes:
            if len(text) < c.size:
                continue
            starts = np.flatnonzero((foreign[c.size:] - foreign[:-c.size] <= c.edits) & own[:len(text) - c.size + 1])
            for lo in range(0, len(starts), _CHUNK):
                at = starts[lo:lo + _CHUNK]
                found = []
                for walk, bands in enumerate(c.bands):
                    y = self.embed(ahead, at, c.size, walk, sorted({int(t) for picked, _, _ in bands for t in picked}))
                    for picked, keys, items in bands:
                        key = self.keys(y, picked)
                        shift = np.uint64(64 - max(12, (16 * len(keys)).bit_length()))
                        some = np.zeros(1 << (64 - int(shift)), bool)  # by first bits: nearly all windows end here
                        some[keys >> shift] = True
                        maybe = np.flatnonzero(some[key >> shift])
                        a, b = np.searchsorted(keys, key[maybe], "left"), np.searchsorted(keys, key[maybe], "right")
                        n = b - a
                        each = np.repeat(maybe, n)
                        of = items[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                        found.append(each * len(self.ids) + of)
                pair = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
                yield at[pair // max(1, len(self.ids))], pair % max(1, len(self.ids))

    def near(self, text: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which pairs could match: an item of n words within k edits of a
        passage shares n - k words at least with the n + k from its start, so 2k
        of these may be others."""
        here = np.arange(len(at))
        left = 2 * self.edits[item]
        size = self.lengths[item] + self.edits[item]
        ok = np.zeros(len(at), bool)
        for j in range(int(size.max(initial=0))):
            if not j & 7:  # those at their end, and those that can't get there
                ended = size[here] <= j
                ok[here[ended]] = True
                here = here[~ended]
            symbol = text[np.minimum(at[here] + j, len(text) - 1)]
            left[here] -= 1 - ((self.known[item[here], (symbol & KNOWN - 1) >> 3] >> (symbol & 7)) & 1) & (size[here] > j)
            if j & 3 == 3:
                here = here[left[here] >= 0]
        ok[here] = True
        return ok & (left >= 0)

    def exact(self, text: np.ndarray, total: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which windows are their item word for word; ``total``: the text's polynomial."""
        end = at + self.lengths[item]
        ok = np.flatnonzero(end <= len(text))
        same = total[end[ok]] - total[at[ok]] == self.hashes[item[ok]] * _POWERS(len(text))[at[ok]]
        out = np.zeros(len(at), bool)
        for k in ok[same].tolist():  # few: the hash is theirs already
            out[k] = np.array_equal(text[at[k]:end[k]], self.symbols[item[k]])
        return out

    @property
    def nbytes(self) -> int:
        """What the index takes, words of the vocabulary included."""
        bands = sum(x.nbytes for c in self.classes for walk in c.bands for band in walk for x in band)
        return bands + self.known.nbytes + sum(b.nbytes for b in self.bits) + sum(s.nbytes for s in self.symbols) + 100 * len(self.vocabulary)

    def matches(self, text: np.ndarray, own: np.ndarray | None = None, alone: np.ndarray | None = None, of_text: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """(start, item, edits) of verified windows; items under ``MIN_WORDS``
        words begin and end where ``alone`` (anywhere if not given).  Where a text
        (``of_text`` of each word) has an item word for word, its other windows of
        that item are passed over: none has fewer edits."""
        out, total = [], _polynomial(text)
        for at, item in self.candidates(text, np.ones(len(text), bool) if own is None else own):
            whole = self.exact(text, total, at, item)
            pair = item if of_text is None else item + of_text[at] * len(self.ids)
            ok = whole | ~np.isin(pair, pair[whole])
            at, item = at[ok], item[ok]
            ok = self.near(text, at, item)
            if alone is not None:
                end = np.minimum(at + self.lengths[item], len(text) - 1)
                ok &= (self.lengths[item] >= MIN_WORDS) | (alone[at] & alone[end])
            at, item = at[ok], item[ok]
            for n in np.unique(self.lengths[item]).tolist():
                here = self.lengths[item] == n
                edits = edit_distances(np.stack([self.symbols[k] for k in item[here].tolist()]), text, at[here], allowed(n))
                ok = edits <= allowed(n)
                out += zip(at[here][ok].tolist(), item[here][ok].tolist(), edits[ok].tolist())
        return out


class _Powers:
    """Powers of the base of the polynomials, as many as were asked for."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.found = np.uint64(base), np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.found) < n:
            self.found = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, self.base))])
        return self.found[:n]


_POWERS = _Powers()


def _polynomial(x: np.ndarray) -> np.ndarray:
    """Prefix sums of symbols times powers: equal windows differ by a power."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _POWERS(len(x)))])


def edit_distances(items: np.ndarray, text: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """For each row of ``items``, the fewest edits that turn it into some prefix
    of ``text`` from its place in ``at``; more than ``most`` is ``most + 1``.
    All rows advance together through the band of cells within ``most`` of the
    diagonal, a row of cells at a time: a cell is the best of its upper neighbours or
    of a cell to its left and the way from there, which is a running minimum."""
    far, wide, n = np.int16(most + 1), 2 * most + 1, items.shape[1]
    beyond = np.r_[text, np.zeros(1, text.dtype)]
    place = at + np.arange(-most, n + most)[:, None]  # of the band's symbols, row after row
    symbols = beyond[np.clip(place, 0, len(text))]
    along = np.arange(wide, dtype=np.int16)[:, None]
    row = np.full((wide + 1, len(items)), far, np.int16)  # a cell of padding behind
    row[most:wide] = along[:most + 1]
    for i in range(n):
        new = row[1:] + np.int16(1)
        first = max(0, most - i)  # the first cell that uses a symbol of the text
        new[first:] = np.minimum(new[first:], row[first:-1] + (symbols[i + first:i + wide] != items[:, i]))
        if first > 1:
            new[:first - 1] = far
        np.minimum.accumulate(new - along, axis=0, out=new)
        new += along
        np.minimum(new, far, out=row[:-1])
    return row[:-1].min(axis=0)


def blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks, each read to the driver by itself."""
    block = []
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def passes(benchmark: DataFrame, most: int | None = None) -> Iterator[list[Index]]:
    """The blocks' indexes, as many at a time as have ``PASS_BYTES`` together."""
    group, size = [], 0
    for block in blocks(benchmark):
        index = Index(block)
        if group and size + index.nbytes > (most or PASS_BYTES):
            yield group
            group, size = [], 0
        group.append(index)
        size += index.nbytes
    if group:
        yield group


class _Texts:
    """A batch's texts as numbers of their distinct words, to be read by any index."""

    def __init__(self, texts: list[str | None], short: bool):
        said = [words(t) for t in texts]
        self.sizes = np.fromiter(map(len, said), np.int64, len(said))
        coded = pa.array([w for ws in said for w in ws], pa.string()).dictionary_encode()
        self.distinct, self.coded = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.alone = np.concatenate([breaks(t) for t in texts]) if short and texts else None

    def of(self, index: Index) -> tuple[np.ndarray, ...]:
        """(symbols, own, alone, text of each word, begin of each text): the texts on
        end, kept apart by as many foreign symbols as an item may have edits."""
        pad = allowed(index.longest) + 1
        begin = np.cumsum(self.sizes + pad) - self.sizes - pad
        place = np.arange(len(self.coded)) + np.repeat(np.arange(len(self.sizes)) * pad, self.sizes)
        total = len(self.coded) + pad * len(self.sizes)
        symbols, own = np.full(total, _PAD, np.int32), np.zeros(total, bool)
        found = pc.index_in(self.distinct, value_set=index.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        symbols[place], own[place] = found[self.coded], True
        alone = ~own
        if self.alone is not None:
            alone[place] = self.alone
        return symbols, own, alone, np.repeat(np.arange(len(self.sizes)), self.sizes + pad), begin


def leaks_of(texts: list[str | None], group: list[Index]) -> list[tuple[int, int, int, int, int]]:
    """(row, item_id, edits, item_words, start_word) of every leak of some texts."""
    group = [ix for ix in group if ix.ids]
    said, rows = _Texts(texts, any((ix.lengths < MIN_WORDS).any() for ix in group)), []
    for ix in group:
        symbols, own, alone, of_text, begin = said.of(ix)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for start, k, d in ix.matches(symbols, own, alone, of_text):
            row = int(of_text[start])
            found = (d, start - int(begin[row]))
            best[row, k] = min(best.get((row, k), found), found)
        rows += [(r, ix.ids[k], d, len(ix.symbols[k]), s) for (r, k), (d, s) in sorted(best.items())]
    return rows


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, item_words, start_word) for every leak."""
    schema = "doc_id long, item_id long, edits int, item_words int, start_word int"
    names = [x.split()[0] for x in schema.split(", ")]
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for group in passes(benchmark):
        sent = spark.sparkContext.broadcast(group)

        def fn(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[r], *found) for r, *found in leaks_of(batch.column("text").to_pylist(), sent.value)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        out = out.unionByName(arrow_map(keyed(docs), fn, schema))
    return out


def op4_decontaminate(spark, sf_dir) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that leak an item of the benchmark."""
    for group in passes(table(spark, sf_dir, "benchmark")):
        sent = spark.sparkContext.broadcast(group)

        def clean(texts: list[str | None], sent=sent) -> np.ndarray:
            ok = np.ones(len(texts), bool)
            ok[[r for r, *_ in leaks_of(texts, sent.value)]] = False
            return ok

        docs = keep_rows(docs, clean)
    return docs
