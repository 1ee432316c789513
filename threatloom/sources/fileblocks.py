"""Files of any size as byte ranges: entropy from merged histograms, hashes as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.operators import threats as th
from threatloom.sources.jsonarray import locate

#: Bytes of a block, the unit of work of a histogram.
BLOCK = 64 << 20
#: Bytes that a task holds at once.
CHUNK = 4 << 20
#: Tasks over the list of blocks or files; more of them share a task.
MAX_TASKS = 20_000


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of all files under ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Short rows that stand for much work each, over as many tasks as there are rows."""
    return rows.repartition(max(1, min(rows.count(), MAX_TASKS)), *keys)


def file_blocks(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, start, size of the byte ranges of every file; an empty file has none."""
    starts = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block).cast("bigint")))
    blocks = files.select("path", "length", F.explode(starts).alias("start"))
    return blocks.select("path", "start", F.least(F.lit(block), F.col("length") - F.col("start")).alias("size"))


def _chunks(path: str, start: int, size: int) -> Iterator[bytes]:
    files, inner = locate(path)
    with files.open_input_file(inner) as stream:
        stream.seek(start)
        while size > 0:
            data = stream.read(min(size, CHUNK))
            if not data:
                raise OSError(f"{path} is shorter than listed")
            size -= len(data)
            yield data


def byte_counts(blocks: DataFrame) -> DataFrame:
    """path, byte, n: how often each byte value stands in each file.

    Blocks are counted where they are read; at most 256 sums a file and task shuffle.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.zeros(256, np.int64)
                for data in _chunks(row["path"], row["start"], row["size"]):
                    counts += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                seen = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())],
                    names=["path", "byte", "n"])

    found = _dealt(blocks, "path", "start").mapInArrow(counted, "path string, byte int, n bigint")
    return found.groupBy("path", "byte").agg(F.sum("n").alias("n"))


def entropy(counts: DataFrame, *keys: str) -> DataFrame:
    """``keys``, bytes, byte_entropy (base 2) from summed counts of byte values, at most 256 rows a key."""
    total = counts.groupBy(*keys, "byte").agg(F.sum("n").alias("n")).groupBy(*keys)
    n = F.col("n").cast("double")
    # -sum(n/N log2 n/N) = log2 N - sum(n log2 n) / N, in one pass
    sums = total.agg(F.sum("n").alias("bytes"), F.sum(n * F.log2(n)).alias("__s"))
    return sums.withColumns({"byte_entropy": F.greatest(F.lit(0.0), F.log2("bytes") - F.col("__s") / F.col("bytes"))}).drop("__s")


def file_hashes(files: DataFrame) -> DataFrame:
    """path, file_hash (SHA-256).  A hash can't be split, so a file is one task's work, in chunks."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                digest = hashlib.sha256()
                for data in _chunks(row["path"], 0, row["length"]):
                    digest.update(data)
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "file_hash": [digest.hexdigest()]})

    return _dealt(files, "path").mapInArrow(hashed, "path string, file_hash string")


def scan_files(spark: SparkSession, path: str, known_hashes: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, length and the columns of ``threats.with_file_verdict`` of all files under ``path``, whatever their size.

    No row holds a file: beyond 2 GB a BINARY value could not. Empty files have entropy 0. The tasks open the files by
    themselves, in any file system that Arrow knows.
    """
    files = list_files(spark, path)
    measured = entropy(byte_counts(file_blocks(files, block)), "path").drop("bytes")
    scored = files.join(file_hashes(files), "path").join(measured, "path", "left")
    return th.with_file_verdict(scored.withColumns({"byte_entropy": F.coalesce("byte_entropy", F.lit(0.0))}), known_hashes)
