"""Corpus pipeline: a document table through the operators, stage by stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes to the shared folder and reads again
as the next stage's ``docs``.  Every stage but the last returns the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retainspark.llm.common import stored, table
from retainspark.llm.decontaminate import decontaminate_stage
from retainspark.llm.langid import langid_stage
from retainspark.llm.secret_scan import secret_stage
from retainspark.llm.sentencepiece import sentencepiece_stage
from retainspark.llm.simhash import simhash_stage

STAGES = [
    ("language ID", langid_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scans", secret_stage),
    ("SentencePiece encoding", sentencepiece_stage),
]

#: SQL has no recurrent network, XXH64, CGK embedding, random field or Viterbi:
#: no twin; tests/llm holds run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
