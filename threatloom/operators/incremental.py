"""Ingest in batches: a new feed is merged into the aggregate of all earlier ones without reading or moving its texts.

The aggregate is two append-only tables: ``records`` and ``seen``, the 16-byte keys of all texts that were claimed. A
batch turns its own keys into a blocked Bloom filter (a table of bitmaps), which meets the scan of ``seen`` as a small
broadcast join; only earlier keys that pass are shuffled, and an exact anti join on them decides.
"""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.operators import dataset as ds
from threatloom.session import materialize

#: Bits of one bitmap, fixed by the bitmap functions (4 KB).
BLOCK_BITS = 32_768
#: Bitmaps of a filter at most: 32 MB, the most that is broadcast.
MAX_BLOCKS = 8_192
#: Bits a key gets, and the fewest with which a filter is worth its scan; below, the keys are joined without one.
BITS_A_KEY, LEAST_BITS_A_KEY = 16, 4
#: Bits set by a key within its bitmap.
PROBES = 4

_SEEN = "key binary, batch int"


class Ingested(NamedTuple):
    """What a batch held: rows with a text, texts that no earlier batch had, and its records by class."""

    rows: int
    fresh: int
    phishing: int
    legitimate: int

    @property
    def duplicates_removed(self) -> int:
        return self.rows - self.fresh


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _probe(key: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)).cast("int")


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block, bits``: a blocked Bloom filter of the keys, at most ``blocks`` rows of 4 KB.

    Bits are combined in the map tasks, so the shuffle carries at most one bitmap a block and task.
    """
    bits = keys.where(F.col(key).isNotNull()).select(
        _block(F.col(key), blocks).alias("block"), F.explode(F.array(*[_probe(F.col(key), i) for i in range(PROBES)])).alias("bit"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bits"))


def possibly_in(rows: DataFrame, key: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be among the filter's; none whose key is among them is lost."""
    def is_set(i: int) -> Column:
        at = _probe(F.col(key), i)
        byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, at % 8) == 1

    small = F.broadcast(bloom.select(F.col("block").alias("__block"), F.col("bits").alias("__bits")))
    return rows.join(small, _block(F.col(key), blocks) == F.col("__block")).where(
        tx.any_of([~is_set(i) for i in range(PROBES)]) == F.lit(False)).drop("__block", "__bits")


def known_keys(keys: DataFrame, n: int, seen: DataFrame, key: str = "key", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Keys of ``seen`` that can be among the ``n`` of ``keys``: all that are, and few others."""
    earlier = seen.select(key)
    if n * LEAST_BITS_A_KEY > max_blocks * BLOCK_BITS:
        return earlier
    blocks = min(max_blocks, max(1, ceil(n * BITS_A_KEY / BLOCK_BITS)))
    return possibly_in(earlier, key, materialize(bloom_filter(keys, key, blocks), "bloom"), blocks)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def seen_before(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """Keys claimed by the batches before this one (whole partitions); raises if a later one is there already."""
    every = _read(spark, f"{path}/seen", _SEEN)
    if not every.where(F.col("batch") > batch).select("batch").isEmpty():
        raise ValueError(f"a batch after {batch} is already in {path}")
    return every.where(F.col("batch") < batch)


def ingest_batch(spark: SparkSession, path: str, feeds: DataFrame, batch: int, strict: bool = False,
                 max_blocks: int = MAX_BLOCKS) -> Ingested:
    """Merge ``text, label, source, content_type, order`` rows into the aggregate under ``path`` as batch ``batch``.

    After batches 0, 1, ... the records are those of ``aggregate_feeds`` over all feeds, earlier batches first: a text
    belongs to the first row with it, and a row with an unknown label still claims its text unless ``strict``. ``order``
    is unique within a batch. A batch is written as its own partition in overwrite mode and looks at earlier ones only,
    so a failed batch is simply repeated, before the next. The counts are those of the written tables.

    NULL and blank texts are left out, NULL labels are unknown, an empty feed makes an empty batch.
    """
    rows = ds.nonblank(feeds, "text")
    if strict:
        rows = ds.known_labels(rows, "label")
    key = F.unhex(tx.norm_hash(F.col("text")))
    firsts = rows.select(key.alias("key"), "order").groupBy("key").agg(F.min("order").alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts, "firsts")
    counted = firsts.agg(F.count("*").alias("texts"), F.sum("n").alias("rows")).first()
    known = known_keys(firsts, counted["texts"], seen_before(spark, path, batch), max_blocks=max_blocks)
    firsts.join(known, "key", "left_anti").select("key", "first").write.mode("overwrite").parquet(f"{path}/seen/batch={batch}")
    fresh = spark.read.schema("first bigint").parquet(f"{path}/seen/batch={batch}")
    records = ds.known_labels(rows.join(fresh, F.col("order") == F.col("first"), "left_semi"), "label")
    classes = [F.count(F.when(F.col("label") == x, 1)).alias(x) for x in (rules.POSITIVE, rules.NEGATIVE)]
    records.write.mode("overwrite").parquet(f"{path}/records/batch={batch}")
    kept = spark.read.schema("label string").parquet(f"{path}/records/batch={batch}").agg(*classes).first()
    return Ingested(counted["rows"] or 0, fresh.count(), kept[rules.POSITIVE], kept[rules.NEGATIVE])


def aggregate(spark: SparkSession, path: str) -> DataFrame:
    """All records so far, with the batch that brought them."""
    return spark.read.parquet(f"{path}/records")
