"""Column helpers and the component search that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.session import materialize

#: A word is a run of characters other than ASCII blanks (fixed by the operators' contracts).
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text, BIGINT; NULL counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that what a task makes of whole texts at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Most bytes of an Arrow batch of whole texts, but for one row.
TEXT_BATCH = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends Python workers batches of ``TEXT_BATCH`` bytes, not of 64 MB.

    A task holds a batch several times over: as buffers that double as they grow beside the JVM's heap, and in Python
    with the batch before it. Results don't depend on it; the session's own setting is put back.
    """
    before = spark.conf.get(_BATCH_BYTES)
    spark.conf.set(_BATCH_BYTES, str(TEXT_BATCH))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_BYTES, before)


def unused(columns: list[str], name: str) -> str:
    """A column name that no input column has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``: root is the smallest node of its component.

    Alternating large and small stars over BIGINT nodes. Every step is a partially aggregated minimum and an
    equi-join, so that a node with very many links is no group in one task; each round is written to the shared
    folder. No edges give no rows; loops and repeated edges change nothing.
    """
    hi, lo = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = materialize(edges.where("u <> v").select(hi, lo).distinct(), f"{name}-edges")
    before = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sign == before or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct())
        before = sign
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(low.select("u", "m")).distinct(), f"{name}-stars")
