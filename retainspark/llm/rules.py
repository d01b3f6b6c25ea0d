"""Quality rules: divergence of a document from its language's distributions.

Counting rules on words, symbols and repetition come first (the base).  What
passes them is compared with language references: the histogram of its character
classes and of a language's common words, against the mean histograms of all
documents of that language, by Jensen-Shannon distance.  A document is held
against every reference and judged by the nearest, so a missing or wrong language
tag costs nothing.  Short documents have noisy histograms: the limit widens with
``1 / sqrt(words)`` and below ``MIN_WORDS`` no verdict is given by distance.

Every language of the corpus has a reference.  The common words of languages
without a fixed list are counted from their documents.

DataFrame functions only: words, windows and histograms are array expressions
inside the row, so windows are not shuffled, and words only as counts of the
languages without a list; the references are one small aggregate.  A row's common
words are counted once, whatever number of languages lists them, and all references
are one array that one expression goes through, so that columns and expressions don't
grow with the languages, and a language costs a row the look-up of its list.

Defined results: null text: no words, ``base_failed``.  A language without a
document to learn from has no reference, and its documents aren't judged by
distance; a null language is judged by the nearest, if there is any.  Repeated rows are judged each.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

# The most frequent words of each language, in order of use.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as be at by this are from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une est que dans qui par pour au sur pas plus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
SPACE = r"[\x20\x09-\x0D]+"
#: Character classes, each counted among what the classes before it left over.
CLASSES = ["[a-z]+", "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", r"[.,;:!?'\"()\-]+", r"\p{L}+"]
BASE_WORDS = 50
BASE_REPEAT_PERCENT = 50
MIN_WORDS = 50
#: Largest mean distance of a document of infinite length, and its widening.
MAX_DISTANCE = 0.1
WIDENING = 1.3


def common_words(docs: DataFrame) -> dict[str, tuple[str, list[str]]]:
    """Key -> (language, its common words) for every language of the corpus: the
    fixed ones, and the most frequent words of each other language, counted."""
    out = {g: (g, ws) for g, ws in COMMON_WORDS.items()}
    size = len(next(iter(COMMON_WORDS.values())))
    d = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("t")).where(F.col("lang").isNotNull() & ~F.col("lang").isin(list(out)))
    words = d.select("lang", F.explode(F.array_remove(F.split("t", SPACE), "")).alias("w")).groupBy("lang", F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    top = words.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("i") <= size)
    counted: dict[str, list[str]] = {}
    for lang, w, _ in sorted(top.select("lang", "w", "i").collect(), key=lambda x: (x[0], x[2])):
        counted.setdefault(lang, []).append(w)
    # a language of fewer words gets empty ones, which no text holds
    return out | {f"x{i}": (lang, ws + [""] * (size - len(ws))) for i, (lang, ws) in enumerate(counted.items())}


def measured(docs: DataFrame, lists: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row per document: counts of the base rules, ``p_classes`` (shares of the
    character classes, white space and the rest last), and ``common`` and ``times``
    (the words that any of ``lists`` has and how often they occur)."""
    common = {g: ws for g, (_, ws) in lists.items()} if lists else COMMON_WORDS
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.select("doc_id", "lang", "t", F.array_remove(F.split("t", SPACE), "").alias("w"), F.regexp_replace("t", SPACE, "").alias("r0"),
                 F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    for i, c in enumerate(CLASSES):
        d = d.withColumn(f"r{i + 1}", F.regexp_replace(f"r{i}", c, ""))
    n = len(CLASSES)
    left = [F.length(f"r{i}") for i in range(n + 1)]
    classes = [left[i] - left[i + 1] for i in range(n)] + [F.length("t") - left[0], left[n]]
    windows = F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.greatest(F.size("w") - 2, F.lit(0)))
    vocabulary = sorted({w for ws in common.values() for w in ws})
    d = d.select("doc_id", "lang", F.size("w").cast("long").alias("n_words"), left[0].cast("long").alias("word_chars"),
                 classes[3].cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.array(*[c.cast("int") for c in classes]).alias("classes"), windows.alias("h"),
                 F.filter("w", lambda x: F.lower(x).isin(vocabulary)).alias("c0"))
    d = d.withColumn("c", F.transform("c0", lambda x: F.lower(x)))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["x"] == y["x"], F.lit(False))
    d = d.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, i: same(x, F.get("s", i - 1)) | same(x, F.get("s", i + 1))), lambda x: x["i"])))
    steps = F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3))))
    repeat = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"), "classes", F.sort_array("c").alias("c"))
    d = d.withColumns({"chars": F.greatest(total("classes"), F.lit(1)), "common": F.array_distinct("c")})
    # equal words stand together: from the first of one to the first of the next
    first = lambda w: F.array_position("c", w)
    d = d.withColumn("times", F.transform("common", lambda w, i: (F.coalesce(first(F.get("common", i + 1)), F.size("c") + 1) - first(w)).cast("int")))
    d = d.withColumn("p_classes", F.transform("classes", lambda x: x / F.col("chars"))).drop("classes", "chars", "c")
    failed = (F.col("n_words") < BASE_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_REPEAT_PERCENT)
    return d.withColumn("base_failed", failed)


def _counts(words: Column) -> Column:
    """How often each of some words occurs in a measured row."""
    return F.transform(words, lambda w: F.coalesce(F.get("times", (F.array_position("common", w) - 1).cast("int")), F.lit(0)))


def _shares(counts: Column) -> Column:
    """The counts as shares of the row's words, all other words last."""
    n = F.greatest("n_words", F.lit(1))
    known = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.concat(F.transform(counts, lambda x: x.cast("long")), F.array(n - known)), lambda x: x / n)


def references(rows: DataFrame, lists: dict[str, tuple[str, list[str]]]) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms of each language's documents that pass the base rules:
    one row per language comes to the driver."""
    if not lists:
        return {}
    of = {lang: ws for lang, ws in lists.values()}
    own = F.element_at(F.map_from_arrays(F.lit(list(of)), F.array(*[F.lit(ws) for ws in of.values()])), F.col("lang"))
    picked = rows.where(~F.col("base_failed") & F.col("lang").isin(list(of))).select("*", own.alias("own"))
    flat = picked.withColumn("own", _counts(F.col("own"))).select("lang", "p_classes", _shares(F.col("own")).alias("p_own"))
    k, m = len(CLASSES) + 2, len(next(iter(of.values()))) + 1
    flat = flat.select("lang", *[F.get("p_classes", F.lit(j)).alias(f"a{j}") for j in range(k)], *[F.get("p_own", F.lit(j)).alias(f"b{j}") for j in range(m)])
    return {r[0]: (list(r[1:1 + k]), list(r[1 + k:]))
            for r in flat.groupBy("lang").agg(*[F.avg(f"a{j}") for j in range(k)], *[F.avg(f"b{j}") for j in range(m)]).collect()}


def divergence(p: Column, q: Column | list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""
    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0)) + F.when(y > 0, y * F.log2(y / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q if isinstance(q, Column) else F.lit([float(y) for y in q]), part)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def nearest(known: dict[str, tuple[list[float], list[float]]], lists: dict[str, tuple[str, list[str]]]) -> Column:
    """A measured row's distance to the nearest reference; null if there is none."""
    refs = [F.struct(F.lit(known[lang][0]).alias("classes"), F.lit(ws).alias("words"), F.lit(known[lang][1]).alias("shares")) for lang, ws in lists.values() if lang in known]
    if not refs:
        return F.lit(None).cast("double")
    counted = F.transform(F.array(*refs), lambda r: F.struct(r["classes"].alias("classes"), r["shares"].alias("shares"), _counts(r["words"]).alias("n")))
    return F.array_min(F.transform(counted, lambda r: (divergence(F.col("p_classes"), r["classes"]) + divergence(_shares(r["n"]), r["shares"])) / 2))


def judged(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` (to the nearest reference; null if
    there is none or the text is too short) and ``kept`` for each document."""
    lists = common_words(docs)
    rows = stored(measured(docs, lists), "rules-measured")
    known = references(rows, lists)
    limit = F.lit(MAX_DISTANCE) + F.lit(WIDENING) / F.sqrt(F.greatest("n_words", F.lit(1)))
    asked = (F.col("n_words") >= MIN_WORDS) & (F.col("lang").isNull() | F.col("lang").isin(list(known)))
    d = rows.withColumn("distance", F.when(asked, nearest(known, lists)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= limit)))


def op10_quality_rules(spark, sf_dir) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: DuckDB twin; its word lists and limits are literals of its own.
OP10_SQL = r"""
WITH lists(lang, words) AS (VALUES
  ('en', ['the','of','and','to','a','in','is','that','it','for','was','on','with','as','be','at','by','this','are','from']),
  ('de', ['der','die','und','in','den','von','zu','das','mit','sich','des','auf','für','ist','im','dem','nicht','ein','eine','als']),
  ('fr', ['de','la','le','et','les','des','en','un','du','une','est','que','dans','qui','par','pour','au','sur','pas','plus']),
  ('es', ['de','la','que','el','en','y','a','los','se','del','las','un','por','con','no','una','su','para','es','al'])
), d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS r0,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), c1 AS (SELECT *, regexp_replace(r0, '[a-z]+', '', 'g') AS r1 FROM w),
c2 AS (SELECT *, regexp_replace(r1, '[A-Z]+', '', 'g') AS r2 FROM c1),
c3 AS (SELECT *, regexp_replace(r2, '[0-9]+', '', 'g') AS r3 FROM c2),
c4 AS (SELECT *, regexp_replace(r3, '[#*$%&|<>]+', '', 'g') AS r4 FROM c3),
c5 AS (SELECT *, regexp_replace(r4, '[.,;:!?''"()\-]+', '', 'g') AS r5 FROM c4),
c6 AS (SELECT *, regexp_replace(r5, '\p{L}+', '', 'g') AS r6 FROM c5),
win AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r
), base AS (
  SELECT c6.r, doc_id, lang, ws, CAST(len(ws) AS BIGINT) AS n_words, length(r0) AS word_chars, length(r3) - length(r4) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    [length(r0) - length(r1), length(r1) - length(r2), length(r2) - length(r3), length(r3) - length(r4), length(r4) - length(r5), length(r5) - length(r6),
     length(t) - length(r0), length(r6)] AS classes
  FROM c6 LEFT JOIN rep USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), low AS (
  SELECT r, lower(u) AS u, count(*) AS n FROM (SELECT r, unnest(ws) AS u FROM base) GROUP BY ALL
), common AS (
  SELECT j.r, l.lang AS ref, g.i, coalesce(low.n, 0) / greatest(j.n_words, 1) AS p
  FROM judged j, lists l, (SELECT unnest(range(1, 21)) AS i) g LEFT JOIN low ON low.r = j.r AND low.u = l.words[g.i]
), shares AS (
  SELECT r, ref, i, p FROM common
  UNION ALL
  SELECT j.r, l.lang, 21, (greatest(j.n_words, 1) - coalesce(k.n, 0)) / greatest(j.n_words, 1)
  FROM judged j, lists l LEFT JOIN (SELECT low.r, l2.lang AS ref, sum(low.n) AS n FROM low JOIN lists l2 ON list_contains(l2.words, low.u) GROUP BY ALL) k
    ON k.r = j.r AND k.ref = l.lang
  UNION ALL
  SELECT j.r, l.lang, 100 + i, j.classes[i] / greatest(list_sum(j.classes), 1) FROM judged j, lists l, (SELECT unnest(range(1, 9)) AS i) g
), refs AS (
  SELECT s.ref, s.i, avg(s.p) AS q FROM shares s JOIN judged j ON j.r = s.r AND j.lang = s.ref WHERE NOT j.base_failed GROUP BY ALL
), parts AS (
  SELECT s.r, s.ref, s.i >= 100 AS of_classes,
    sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js
  FROM shares s JOIN refs USING (ref, i) GROUP BY ALL
), near AS (
  SELECT r, min(dist) AS distance FROM (SELECT r, ref, sum(sqrt(greatest(js, 0))) / 2 AS dist FROM parts GROUP BY ALL) GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(distance <= 0.1 + 1.3 / sqrt(greatest(n_words, 1)), true) AS kept
FROM judged LEFT JOIN near USING (r)
"""
