"""Packing of tokenised documents into sequences by the linear grouping scheme.

A document's tokens, with an end token behind them, are cut into pieces only where
they are longer than a sequence.  Pieces of one length are alike, so the instance is
its histogram: at most ``CAPACITY`` counts, however many documents there are.  On it

1. the pieces above a share of a sequence, longest first, are dealt into groups of
   equal cardinality, and each is rounded up to the longest of its group;
2. the configurations (what few rounded sizes can share a sequence) are chosen by
   the linear programme over them, solved by column generation: a revised simplex
   whose entering column is the knapsack best by the current prices; its solution
   is rounded down to whole sequences;
3. the actual pieces, longest first, take the places of their group, which leaves
   the room that rounding up had taken;
4. pieces left over by rounding down and all small ones are put in by best fit,
   longest first, and into new sequences where none has room.

Steps 2 to 4 handle runs of sequences with the same content, so their work is bounded
by the number of lengths.  The plan that needs the fewest sequences among ``PLANS``
(groups, and the share above which a piece is large) is used.  It says for each length
which ranks go where; a piece's rank among those of its length comes from a window over
(length, salt) and the counts of the salts before, so a length that a third of all
pieces have is spread over as many tasks as others.

White space of ASCII ends a token in any case, and so does a mark behind a letter; the
words between are tokenised once and kept for the texts that follow (``CACHE_WORDS`` of
them at most, the oldest forgotten first).  A word of plain letters is its own only
pre-token, so the tokenizer's model takes it as it is; any other goes through the whole
tokenizer.  Strings of special tokens in a text become those tokens, as the library has
it by default.

Defined results: a null or empty text is one piece, its end token.  Rows with a null
id and repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, pieces, stored, table

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 400_000
#: (groups, smallest large piece as a share of a sequence) that are tried.
PLANS = [(16, 1 / 4), (48, 1 / 4), (64, 1 / 3), (32, 1 / 8)]
#: Pieces ranked in one task.
RANKED = 250_000
#: Bytes of a text tokenised at once.
_PART = 8 << 20
#: Lower-case letters that normalising leaves as they are: ASCII and Latin-1.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


# --- tokens -----------------------------------------------------------------

class _Words:
    """A tokenizer, and the tokens of the words met lately."""

    def __init__(self, json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(json)
        self.model = self.tokenizer.model
        # how the model's alphabet writes the letters' bytes
        written = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: written(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def tokens(self, words: list[str]) -> list[bytes]:
        """Each word's tokens as little-endian unsigned 32-bit numbers."""
        young, old, out = self.young, self.old, []
        missing = []
        for w in words:
            got = young.get(w)
            if got is None:
                got = old.get(w)
                if got is None:
                    missing.append(len(out))
                else:
                    young[w] = got
            out.append(got)
        odd = []
        for k in missing:
            w = words[k]
            if _PLAIN.fullmatch(w):
                said = w if w.isascii() else w.translate(self.letters)
                out[k] = young[w] = b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(said)])
            else:
                odd.append(k)
        if odd:
            for k, e in zip(odd, self.tokenizer.encode_batch_fast([words[k] for k in odd], add_special_tokens=False)):
                out[k] = young[words[k]] = np.array(e.ids, "<u4").tobytes()
        if len(young) > CACHE_WORDS // 2:
            self.old, self.young = young, {}
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the tokens of all texts on end, and where each text's begin."""
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # special tokens are read as written
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, "([a-z0-9])([.,;:!?])", r"\1 \2"))
        coded = split.flatten().dictionary_encode()
        each = self.tokens(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        flat = np.frombuffer(b"".join(each), "<u4")
        word = coded.indices.to_numpy(zero_copy_only=False)
        n = size[word]
        ends = np.cumsum(n)
        first = np.cumsum(size) - size
        ids = flat[np.repeat(first[word] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        offsets = split.offsets.to_numpy()
        return ids, np.r_[0, ends][offsets - offsets[0]]


@functools.lru_cache(1)
def _words(json: str) -> _Words:
    return _Words(json)


def _parts(text: str) -> list[str]:
    """A long text cut at white space."""
    out, at = [], 0
    while len(text) - at > _PART:
        to = max(text.rfind(" ", at, at + _PART), text.rfind("\n", at, at + _PART))
        if to <= at:  # a word longer than a part
            to = min((x for x in (text.find(" ", at + _PART), text.find("\n", at + _PART)) if x >= 0), default=len(text))
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def cut(n_tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    return [(at, min(capacity, n_tokens - at)) for at in range(0, n_tokens, capacity)]


def document_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document.  ``path`` is the
    tokenizer's file, read on the driver and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        json = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        words = _words(json.value)
        for batch in batches:
            for part in pieces(batch, "text", _PART):
                text = part.column("text").fill_null("")
                if part.num_rows == 1 and len(text[0].as_buffer()) > _PART:
                    said = [words.encode(pa.array([x]))[0] for x in _parts(text[0].as_py())]
                    ids = np.concatenate(said)
                    at = np.array([0, len(ids)])
                else:
                    ids, at = words.encode(text)
                data, rows = np.ascontiguousarray(ids, "<u4").tobytes(), []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    n = b - a + 1
                    for k, (start, length) in enumerate(cut(n, capacity)):
                        crc = zlib.crc32(data[4 * (a + start):4 * min(a + start + length, b)])
                        rows.append((doc, k, start, length, zlib.crc32(end, crc) if start + length == n else crc))
                names, types = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return keyed(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the plan, on a histogram -------------------------------------------------

def groups(counts: dict[int, int], n_groups: int) -> list[tuple[int, int]]:
    """(rounded size, pieces) of groups of equal cardinality, longest first."""
    total, out, done = sum(counts.values()), [], 0
    lengths = sorted(counts, reverse=True)
    edges = [total * (k + 1) // n_groups for k in range(n_groups)]
    k = 0
    for length in lengths:
        left = counts[length]
        while left:
            while edges[k] <= done:
                k += 1
            take = min(left, edges[k] - done)
            if out and out[-1][2] == k:
                out[-1][1] += take
            elif out and out[-1][0] == length:  # groups of one size are one
                out[-1][1] += take
                out[-1][2] = k
            else:
                out.append([length, take, k])
            done += take
            left -= take
    return [(size, n) for size, n, _ in out]


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: how many of each size, and its value."""
    best = np.zeros(capacity + 1)
    taken = []
    for _ in range(capacity // int(sizes.min())):
        new, which = best.copy(), np.full(capacity + 1, -1, np.int32)
        for k, (s, p) in enumerate(zip(sizes.tolist(), prices.tolist())):
            if p > 0:
                with_it = best[:-s] + p
                more = with_it > new[s:] + 1e-12
                new[s:][more] = with_it[more]
                which[s:][more] = k
        taken.append(which)
        best = new
    out, room = np.zeros(len(sizes)), capacity
    for which in reversed(taken):
        k = which[room]
        if k >= 0:
            out[k] += 1
            room -= int(sizes[k])
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(sequences, pieces of each size in one) of the linear programme's solution,
    rounded down: as few sequences as possible that hold the demand."""
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    inverse, x = np.diag(1.0 / np.diag(basis)), d / np.diag(basis)
    for _ in range(40 * len(s)):
        value, column = _knapsack(s, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = ratio[out]
        x = np.maximum(x - amount * step, 0)
        x[out] = amount
        basis[:, out] = column
        inverse[out] /= step[out]
        for i in range(len(s)):
            if i != out:
                inverse[i] -= step[i] * inverse[out]
    left, found = list(demand), []
    for j in np.argsort(-x, kind="stable").tolist():
        holds = basis[:, j].astype(int).tolist()
        times = min([int(x[j] + 1e-6)] + [left[k] // n for k, n in enumerate(holds) if n])
        if times:
            found.append((times, holds))
            left = [a - times * n for a, n in zip(left, holds)]
    return found


def _substituted(counts: Counter, rounded: list[tuple[int, int]], found, capacity: int) -> list[list]:
    """[room, sequences, content] of the configurations with actual pieces, longest
    first, in the places of their group; ``counts`` keeps what is left."""
    lengths = sorted(counts, reverse=True)
    ends = np.cumsum([counts[x] for x in lengths])
    at, top = [], 0  # the rank at which each group's next piece stands
    for _, n in rounded:
        at.append(top)
        top += n
    runs = []
    for times, holds in found:
        slots = []
        for k, n in enumerate(holds):
            for _ in range(n):
                slots.append(at[k])
                at[k] += times
        edges = {0, times}
        for a in slots:  # where the length in this place changes
            i, j = np.searchsorted(ends, [a, a + times], "right")
            edges |= {int(e) - a for e in ends[i:j] if a < e < a + times}
        edges = sorted(edges)
        for lo, hi in zip(edges, edges[1:]):
            content = Counter(lengths[int(np.searchsorted(ends, a + lo, "right"))] for a in slots)
            for length, n in content.items():
                counts[length] -= n * (hi - lo)
            runs.append([capacity - sum(k * n for k, n in content.items()), hi - lo, list(content.items())])
    return runs


def _best_fit(runs: list[list], counts: dict[int, int], capacity: int) -> list[list]:
    """The runs with the remaining pieces put in, longest first, each where it
    leaves the least room, or into a new sequence."""
    by_room: dict[int, list[list]] = {}
    for r in runs:
        by_room.setdefault(r[0], []).append(r)
    rooms = sorted(by_room)
    done = []

    def put(run):
        if run[0] not in by_room:
            insort(rooms, run[0])
            by_room[run[0]] = []
        by_room[run[0]].append(run)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                here = by_room[rooms[i]]
                room, times, content = here.pop()
                if not here:
                    del by_room[room], rooms[i]
            else:
                each = capacity // length
                room, times, content = capacity, -(-left // each), []
            each = room // length
            full = min(times, left // each)
            if full:
                put([room - each * length, full, [*content, (length, each)]])
                left -= full * each
                times -= full
            if left and times:  # fewer than fill one
                put([room - left * length, 1, [*content, (length, left)]])
                left, times = 0, times - 1
            if times:
                put([room, times, content])
    for room in rooms:
        done += by_room[room]
    return done


def plan(counts: dict[int, int], capacity: int = CAPACITY, plans=PLANS) -> list[list]:
    """[room, sequences, [(length, pieces in one)]]: all pieces in few sequences."""
    counts = {k: n for k, n in counts.items() if n}
    best, fewest = None, -(-sum(k * n for k, n in counts.items()) // capacity)
    for n_groups, share in plans:
        if best and best[0] == fewest:
            break
        left = Counter(counts)
        large = Counter({k: n for k, n in left.items() if share * capacity < k < capacity})
        runs = [[0, left.pop(capacity), [(capacity, 1)]]] if capacity in left else []
        if large:
            rounded = groups(large, n_groups)
            found = configurations([s for s, _ in rounded], [n for _, n in rounded], capacity)
            runs += _substituted(large, rounded, found, capacity)
            left.update({k: large[k] - left[k] for k in large})
        runs = _best_fit(runs, +left, capacity)
        n = sum(r[1] for r in runs)
        if best is None or n < best[0]:
            best = n, runs
    return best[1] if best else []


def places(runs: list[list]) -> np.ndarray:
    """Rows of (length, first rank, first sequence, pieces in one, offset), by length
    and rank: a piece stands in the row of its length with the last first rank that
    is not above its own."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for _, times, content in runs:
        at = 0
        for length, each in content:
            rows.append((length, rank[length], sequence, each, at))
            rank[length] += times * each
            at += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# --- every piece to its place -------------------------------------------------

def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    cuts = stored(document_pieces(docs, path, capacity), "packing-pieces")
    counts = {r[0]: r[1] for r in cuts.groupBy("length").count().collect()}  # at most ``capacity`` rows
    total = sum(counts.values())
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(total // RANKED + 1)).cast("int"))
    of_salt = salted.groupBy(F.col("length").alias("l"), F.col("salt").alias("s")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("l").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    of_salt = of_salt.select("l", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("rank", rank - 1).join(of_salt, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    where = docs.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))

    def run(batches):
        rows = where.value
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, (length << 48) + r, "right") - 1
            _, first, sequence, each, at = rows[k].T
            behind = r - first
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence + behind // each), pa.array(at + behind % each * length)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op11_packing(spark, sf_dir) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
