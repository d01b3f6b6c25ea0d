"""Repeated passages by prefix-free parsing of the corpus.

A byte is removed if a string of ``length`` bytes covers it that also starts
anywhere else.  Each text is parsed into phrases at triggers: places where a
rolling hash is the smallest of ``WINDOW`` neighbours.  A trigger depends on the
bytes around it alone, so equal strings hold the same trigger, and every string
of ``length`` bytes has one: the smallest of its first window.  A text position
is thus a suffix of a phrase (the bytes up to the trigger) followed by a suffix
of the parse (what begins at the trigger), and its place in corpus order follows
from the order of parse suffixes and, among equal ones, of phrase suffixes:

1. parse suffixes, cut off where every string that starts before the trigger has
   ended, are brought together by digest; one alone can't be in a repeat;
2. parse suffixes that are followed and preceded by the same bytes wherever they
   occur (as inside copies) need no further order: all their strings repeat;
3. for the others, one representative of each distinct surrounding gives its
   phrase suffixes with what follows, which are brought together in their turn.

So only where copies begin, end or differ are single positions looked at, and
order is resolved as far as equality over ``length`` bytes, by 128 bits of
digest, without a suffix array of the corpus in any one place.

Texts are known by their digest: copies of a text are parsed, counted, and then
followed once.  Defined results: null text is empty; texts shorter than
``length`` lose nothing; repeated rows are copies of each other like any two
documents; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, pieces, stored, table

LENGTH = 400
GRAM = 8
_BLOCK = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)


def _window(length: int) -> int:
    return length // 2


def triggers(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first, last): each trigger that is the first of a string of the
    text, and the first and last start of the strings it is the trigger of."""
    n, w = len(data), _window(length)
    starts = n - length + 1
    if starts < 1:
        none = np.empty(0, np.int64)
        return none, none, none
    raw = np.frombuffer(data, np.uint8)
    at = []
    for lo in range(0, starts, _BLOCK):
        hi = min(starts, lo + _BLOCK)
        grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw[lo:hi + w - 1 + GRAM - 1], GRAM)).view("<u8").ravel()
        h = grams * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h & ~_LOW) | np.arange(lo, lo + len(h), dtype=np.uint64)  # ties: the leftmost
        span = 1
        while span * 2 <= w:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if w > span:
            h = np.minimum(h[:len(h) - (w - span)], h[w - span:])
        at.append((h & _LOW).astype(np.int64))
    at = np.concatenate(at)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)] - 1


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def _tail(length: int) -> int:
    return length - _window(length)


def suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(suffix, around, text_key, at) for every trigger: digests of the parse
    suffix and of all bytes of the trigger's strings, and where it is."""
    h64, h128, tail = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest, _tail(length)

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                suffix, around, keys, places = [], [], [], []
                for data in part.column("text").cast(pa.binary()).to_pylist():
                    x, lo, hi = triggers(data or b"", length)
                    if len(x):
                        places.append(x)
                        keys += [h128(data)] * len(x)
                        for t, a, b in zip(x.tolist(), lo.tolist(), hi.tolist()):
                            suffix.append(h64(data[t:t + tail]))
                            around.append(h64(data[a:b + length], t - a))
                yield pa.RecordBatch.from_pydict({"suffix": pa.array(_signed(suffix)), "around": pa.array(_signed(around)), "text_key": pa.array(keys, pa.binary()),
                                                  "at": pa.array(np.concatenate(places) if places else np.empty(0, np.int64), pa.int64()).cast(pa.int32())})

    return keyed(docs).mapInArrow(run, "suffix long, around long, text_key binary, at int")


def texts(docs: DataFrame) -> DataFrame:
    """(text_key, packed): each text once per partition, compressed."""
    def run(batches):
        pack, seen = zstandard.ZstdCompressor(level=3).compress, set()
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for data in part.column("text").cast(pa.binary()).to_pylist():
                    key = xxhash.xxh3_128_digest(data or b"")
                    if key not in seen:
                        if len(seen) < 1_000_000:  # later texts may be sent twice
                            seen.add(key)
                        rows.append((key, pack(data or b"")))
                yield pa.RecordBatch.from_pydict({"text_key": pa.array([k for k, _ in rows], pa.binary()), "packed": pa.array([p for _, p in rows], pa.binary())})

    return keyed(docs).mapInArrow(run, "text_key binary, packed binary")


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(p) for p in batch.column("packed").to_pylist()]


def _strings(marked: DataFrame, length: int) -> DataFrame:
    """(suffix, string, around, ahead, copies) for every start of the strings of
    each representative in ``reps`` (at, suffix, around, copies)."""
    h64 = xxhash.xxh3_64_intdigest

    def run(batches):
        for batch in batches:
            for data, reps in zip(_unpacked(batch), batch.column("reps").to_pylist()):
                x, lo, hi = triggers(data, length)
                where = np.searchsorted(x, [r["at"] for r in reps])
                for at in range(0, len(reps), 2000):
                    suffix, string, around, ahead, copies = [], [], [], [], []
                    for r, k in zip(reps[at:at + 2000], where[at:at + 2000].tolist()):
                        a, b = int(lo[k]), int(hi[k])
                        string += [h64(data[i:i + length]) for i in range(a, b + 1)]
                        ahead += range(r["at"] - a, r["at"] - b - 1, -1)
                        n = b + 1 - a
                        suffix += [r["suffix"]] * n
                        around += [r["around"]] * n
                        copies += [min(r["copies"], 2)] * n
                    yield pa.RecordBatch.from_pydict({"suffix": pa.array(suffix, pa.int64()), "string": pa.array(_signed(string)), "around": pa.array(around, pa.int64()),
                                                      "ahead": pa.array(ahead, pa.int16()), "copies": pa.array(copies, pa.int8())})

    return marked.mapInArrow(run, "suffix long, string long, around long, ahead short, copies byte")


def covered(data: bytes, marks: list[dict], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marked strings cover.  A mark is a trigger
    and how far ahead of it its repeating strings start (none: all do)."""
    x, lo, hi = triggers(data, length)
    edge = np.zeros(len(data) + 1, np.int32)
    for m in marks:
        k = int(np.searchsorted(x, m["at"]))
        if m["ahead"] is None:
            edge[lo[k]] += 1
            edge[hi[k] + length] -= 1
        else:
            s = m["at"] - np.array(m["ahead"], np.int64)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + length, -1)
    on = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.r_[False, on, False]))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist()))


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    def run_ids(batches):
        for batch in batches:
            data = [d or b"" for d in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_key": pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary()),
                                              "n_bytes": pa.array([len(d) for d in data], pa.int64()), "whole": pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string())})

    rows = keyed(docs).mapInArrow(run_ids, "doc_id long, text_key binary, n_bytes long, whole string")
    found = suffixes(docs, length)
    shared = found.groupBy(F.col("suffix").alias("same")).agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("b")).where(F.col("n") > 1)
    # stored, so that the join has a shuffle of its own on either side: a suffix with very
    # many triggers is then split over tasks (adaptive skew join) instead of meeting in one
    shared = stored(shared.select("same", (F.col("a") != F.col("b")).alias("differs")), "repeats-shared")
    met = stored(found.join(shared, F.col("suffix") == F.col("same")).select("suffix", "around", "text_key", "at", "differs"), "repeats-met")
    reps = met.where("differs").groupBy("suffix", "around").agg(F.count("*").alias("copies"), F.min(F.struct("text_key", "at")).alias("r"))
    by_text = reps.select(F.col("r.text_key").alias("of"), F.struct(F.col("r.at").alias("at"), "suffix", "around", "copies").alias("rep"))
    by_text = by_text.groupBy("of").agg(F.collect_list("rep").alias("reps"))
    held = met.select(F.col("text_key").alias("of")).distinct().join(by_text, "of", "left")
    packed = texts(docs)
    held = stored(packed.join(held, packed["text_key"] == held["of"]).drop("of").dropDuplicates(["text_key"]), "repeats-texts")
    strings = _strings(held.where(F.col("reps").isNotNull()), length)  # made twice rather than written: there are more of them than text
    twice = strings.groupBy(F.col("suffix").alias("s"), F.col("string").alias("t")).agg(F.sum("copies").alias("n")).where(F.col("n") > 1).drop("n")
    # of a surrounding that occurs twice all strings repeat: only single ones need their list
    single = strings.where("copies = 1").join(twice, (F.col("suffix") == F.col("s")) & (F.col("string") == F.col("t")))
    lists = single.groupBy(F.col("suffix").alias("s2"), F.col("around").alias("a2")).agg(F.collect_set("ahead").alias("ahead"))
    once = reps.where("copies = 1").join(lists, (F.col("suffix") == F.col("s2")) & (F.col("around") == F.col("a2")))
    once = once.select(F.col("r.text_key").alias("of"), F.col("r.at").alias("at"), "ahead")
    # stored for the same reason: triggers of one very common surrounding are split over tasks
    many = stored(reps.where("copies > 1").select(F.col("suffix").alias("s3"), F.col("around").alias("a3")), "repeats-many")
    full = met.where("differs").join(many, (F.col("suffix") == F.col("s3")) & (F.col("around") == F.col("a3")), "left_semi")
    full = full.unionByName(met.where("not differs")).select(F.col("text_key").alias("of"), "at").distinct()
    marks = once.unionByName(full.withColumn("ahead", F.lit(None).cast("array<smallint>")))
    marks = marks.groupBy("of").agg(F.collect_list(F.struct("at", "ahead")).alias("marks"))
    cut = held.select("text_key", "packed").join(marks, F.col("text_key") == F.col("of")).select("text_key", "packed", "marks")

    def run_cut(batches):
        for batch in batches:
            out = []
            for key, data, m in zip(batch.column("text_key").to_pylist(), _unpacked(batch), batch.column("marks").to_pylist()):
                spans, sha, at = covered(data, m, length), hashlib.sha256(), 0
                for a, b in spans:
                    sha.update(data[at:a])
                    at = b
                sha.update(data[at:])
                out.append((key, sum(b - a for a, b in spans), len(spans), sha.hexdigest()))
            names, types = ["key", "n_removed", "n_spans", "kept"], [pa.binary(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    done = cut.mapInArrow(run_cut, "key binary, n_removed long, n_spans long, kept string")
    return rows.join(done, F.col("text_key") == F.col("key"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"))


def op8_repeats(spark, sf_dir) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))
