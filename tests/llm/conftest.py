import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use inside; a table may carry them too.
CLASHES = ["fp", "component_id", "score", "label", "key", "of", "spans", "text_key", "suffix", "at", "x", "t", "w", "h", "root", "kept", "n", "g", "held_out"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text[, lang]) rows, with clashing extra columns."""
    def make(rows, clashes=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if clashes:
            from pyspark.sql import functions as F
            for c in CLASHES:
                df = df.withColumn(c, F.lit("clash"))
        return df
    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic prose: prose(seed, words)."""
    def make(seed, n):
        rng = random.Random(seed)
        syllables = "the of and er on re in ti th ou ha es st en at or nd".split()
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def hard(prose):
    """Rows that every operator must take: null and empty texts, a null id,
    repeated rows, odd characters, a long text."""
    return [(1, None), (2, ""), (3, "   \n\t "), (None, prose(1, 60)), (4, prose(2, 80)), (4, prose(2, 80)), (5, "🙂▁ Ⅷ \x00 é" * 3),
            (6, prose(3, 9000)), (7, prose(2, 80)), (8, "a"), (9, None)]
