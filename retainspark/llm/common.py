"""Helpers shared by the operators: reading, storing, Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table

__all__ = ["arrow_map", "components", "crc_mod", "keep_rows", "keyed", "pieces", "stored", "table"]

#: Edges that a round of ``components`` writes to one file.
EDGES_PER_FILE = 250_000

#: Bytes of text handled at once in a Python worker.
PIECE_BYTES = 4 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read
    back, so that its lineage ends in files that outlive any executor."""
    return materialize(df, f"llm-{name}")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator needs; whatever else a table carries, under
    whatever name, can't clash with the operator's own columns."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text modulo ``n``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def keep_rows(docs: DataFrame, fn: Callable[[list[str | None]], np.ndarray], limit: int = PIECE_BYTES) -> DataFrame:
    """The rows of ``docs`` whose texts ``fn`` says yes to, with all their columns.
    Each row is judged by its own text, whatever ids and columns there are; no row
    is moved."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, at, limit):
                yield part.filter(pa.array(fn(part.column(at).to_pylist()), pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def pieces(batch: pa.RecordBatch, column: str | int = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float)))
    at = 0
    while at < n:
        base = sizes[at - 1] if at else 0.0
        to = max(at + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` with bounded slices: ``fn`` gets a slice and returns the
    output columns as a dict of arrays."""
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text):
                out = fn(piece)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
    return df.mapInArrow(run, schema)


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root) for every node
    of ``edges`` (columns u, v); root is the smallest node reachable.

    Alternating large-star and small-star steps.  A node's neighbours are
    reduced with a partial minimum before the shuffle and are never gathered,
    so a node with very many neighbours costs one row per map task.  Each round
    is written to the shared folder.  Raises if ``rounds`` steps don't settle it
    (the number of rounds needed grows with the logarithm of the longest chain).
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        low = low.select(F.col("u").alias("w"), "m")
        if large:
            out = both.join(low, both["u"] == low["w"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = both.join(low, both["u"] == low["w"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
            out = out.unionAll(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    def down(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = stored(down(edges), f"{name}-edges")
    was = mark(now)
    for _ in range(rounds):
        if not was[0]:
            break
        # a star step doesn't add edges: few of them don't need a file for each shuffle partition
        files = was[0] // EDGES_PER_FILE + 1
        now = stored(down(star(down(star(now, True)), False)).coalesce(files), f"{name}-edges")
        new = mark(now)
        if new == was:
            break
        was = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
