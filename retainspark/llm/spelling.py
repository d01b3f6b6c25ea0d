"""Spelling variants grouped by asymmetric q-chunks.

Words are counted over the whole corpus; two are near if one code point inserted,
deleted or replaced turns one into the other.  The shorter word (of equal ones the
smaller) contributes two disjoint chunks, its halves; the other contributes its
positional grams of the sizes such chunks can have.  One edit leaves one half whole,
and what stands at its end is shifted by the difference in length, one at most: so
grams that lie further from a chunk's place are not made.  The edit then lies in the
other half, which is chunked in the same way, so that a common half ("inter...")
doesn't bring all its words together: a join key is a preserved half and a preserved
part of the other, and leaves about a quarter of the word open.  Words that meet are
verified by edit distance, and a pair is kept for the first of its keys only.

A word's form is its near word with the most occurrences, if it has at least
``RATIO`` times as many as the word; roots follow forms to the end by doubling the
step, which takes as many joins as the logarithm of the longest chain, itself at most
the logarithm of the largest count.

Words are counted in Arrow batches (bounded tables, summed by a shuffle); all that
follows are DataFrame operations.  Both sides of every join grow with the words, so
all are merge joins by hint: Spark sizes a stored table by its compressed files and an
explode by its input, and would broadcast the chunks of hundreds of thousands of words.

Defined results: null and empty texts have no words; a null id counts as empty in the
digest that alters a run; repeated rows are counted each; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, pieces, stored, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT, RATIO, ALTERED = 5, 3, 2, 97
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 300_000
_LOWER = {c: c + 32 for c in range(65, 91)}


def altered(doc_id: int | None, run: str) -> str:
    """A lower-cased run as it counts: one code point less where the digest of the
    document and the run says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id)))
    return run if h % ALTERED else (run[:h % len(run)] + run[h % len(run) + 1:])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all documents and how often they occur."""
    def run(batches):
        held: Counter = Counter()

        def out():
            kept = [(w, n) for w, n in held.items() if len(w) >= LEAST_CHARS]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for part in pieces(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if text:
                        start = zlib.crc32(b"%s:" % (b"" if doc is None else b"%d" % doc))
                        for w, n in Counter(RUN.findall(text.translate(_LOWER) if not text.islower() else text)).items():
                            h = zlib.crc32(w.encode(), start)
                            if not h % ALTERED:
                                h %= len(w)
                                w = w[:h] + w[h + 1:]
                            held[w] += n
                        if len(held) > HELD_WORDS:
                            yield out()
        yield out()

    found = keyed(docs).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _part(word: Column, first: Column, size: Column) -> Column:
    """``size`` code points of a word from place ``first`` (from 0)."""
    return F.substring(word, first + 1, size)


def _chunks(length: Column, shift: Column | int) -> list[list[tuple[Column, Column]]]:
    """For a chunk word of ``length``, the places of each key's parts in a word that
    is ``shift`` longer: a half that is whole and one part of the other half.

    Key 0 and 1: the first half, and the first or second part of the second;
    key 2 and 3: the second half, and the first or second part of the first."""
    q = F.floor(length / 2).cast("int")
    a, b = F.floor(q / 2).cast("int"), F.floor((length - q) / 2).cast("int")
    zero = F.lit(0)
    return [[(zero, q), (q, b)],
            [(zero, q), (q + b + shift, length - q - b)],
            [(q + shift, length - q), (zero, a)],
            [(q + shift, length - q), (a + shift, q - a)]]


def _keys(word: Column, length: Column, shift: Column | int) -> Column:
    """The four keys, each with the chunk word's length, as an array."""
    return F.array(*[F.struct(F.lit(k).cast("byte").alias("which"), length.cast("int").alias("chunked"), F.concat(*[_part(word, *p) for p in parts]).alias("gram"))
                     for k, parts in enumerate(_chunks(length, shift))])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each near pair of ``words`` (word, n) once, the
    shorter word first, of equal lengths the smaller."""
    length = F.char_length("word")
    chunked = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(_keys(F.col("word"), length, 0)).alias("c"))
    chunked = chunked.select("a", "a_n", F.col("c.which").alias("which"), F.col("c.chunked").alias("size"), F.col("c.gram").alias("gram"))
    same, longer = _keys(F.col("word"), length, 0), _keys(F.col("word"), length - 1, 1)
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.concat(same, longer)).alias("g"))
    grams = grams.select("b", "b_n", F.col("g.which").alias("w"), F.col("g.chunked").alias("s"), F.col("g.gram").alias("g")).where(F.col("s") >= LEAST_CHARS)
    met = chunked.hint("merge").join(grams.hint("merge"), (F.col("gram") == F.col("g")) & (F.col("size") == F.col("s")) & (F.col("which") == F.col("w"))
                       & ((F.char_length("b") > F.col("size")) | (F.col("a") < F.col("b"))))
    met = met.where(F.levenshtein("a", "b", 1) == 1)
    # the first key that both words share; they may share several
    shift = F.char_length("b") - F.col("size")
    earlier = F.lit(False)
    for k, (mine, other) in enumerate(list(zip(_chunks(F.col("size"), 0), _chunks(F.col("size"), shift)))[:-1]):
        alike = F.lit(True)
        for p, o in zip(mine, other):
            alike = alike & (_part(F.col("a"), *p) == _part(F.col("b"), *o))
        earlier = earlier | (alike & (F.col("which") > k))
    return met.where(~earlier).select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))


def forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of every word."""
    pairs = near_pairs(words)
    both = pairs.unionAll(pairs.select("near", "near_n", "word", "n"))
    best = both.groupBy(F.col("word").alias("w")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    out = words.hint("merge").join(best.hint("merge"), F.col("word") == F.col("w"), "left")
    enough = -F.col("best.less") >= RATIO * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"),
                      F.when(enough, -F.col("best.less")).alias("form_n"))


def rooted(formed: DataFrame) -> DataFrame:
    """``formed`` with ``root``: the word that its forms lead to in the end."""
    step = stored(formed.where("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to")), "spelling-steps")
    while True:
        ahead = step.select(F.col("from").alias("at"), F.col("to").alias("then"))
        step = stored(step.hint("merge").join(ahead.hint("merge"), F.col("to") == F.col("at"), "left").select("from", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")), "spelling-steps")
        moved = step.agg(F.max("moved")).first()[0]
        step = step.drop("moved")
        if not moved:
            break
    return formed.hint("merge").join(step.hint("merge"), F.col("word") == F.col("from"), "left").select(
        "word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    words = stored(word_counts(docs), "spelling-words")
    return rooted(stored(forms(words), "spelling-forms"))


def op12_spelling(spark, sf_dir) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
