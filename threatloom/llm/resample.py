"""Importance resampling towards a target distribution, over hashed word n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import unused
from threatloom.session import materialize

BUCKETS = 10_000
MIN_N, MAX_N = 1, 1
#: Documents with fewer words are never drawn.
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of text that a worker cuts up at a time; a longer text is cut up alone.
CHUNK = 1 << 22
#: Bytes to characters of words: A-Z to a-z, separators to blanks. Words are digits, letters and all bytes beyond ASCII.
_NORMAL = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_TABLE = _byte_table()


def _shift_tables(bits: int) -> list[np.ndarray]:
    """Multiplication by ``x ** (8 * 2 ** k)`` modulo the polynomial for each k, as four tables, one a byte of the CRC."""
    def apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]

    each = [np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)]
    now = np.stack([_TABLE[e & 255] ^ (e >> 8) for e in each])  # one byte of zeros
    out = [now]
    for _ in range(bits - 1):
        now = np.stack([apply(now, apply(now, e)) for e in each])
        out.append(now)
    return out


#: Lengths of features in bytes go up to 2 ** 31, the longest value of a column.
_SHIFTS = _shift_tables(31)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs' parts in a string that goes on for ``length`` bytes: multiplication by ``x ** (8 * length)`` in GF(2)."""
    out = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> k) & 1)
        c, t = out[at], _SHIFTS[k]
        out[at] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
    return out


def ngram_crcs(texts: list[bytes], min_n: int = MIN_N, max_n: int = MAX_N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, features, crcs)``: each text's words and n-grams, and the CRC-32 of all n-grams in the texts' order.

    A text is scanned once, as its words with one blank before each: the running CRC at the end of every word is kept.
    The CRC of the bytes between two places a < b is ``crc(b) ^ shift(crc(a), b - a)``, whatever its length, so the
    n-grams of all sizes come from these prefixes without reading a byte again.
    """
    ends, sizes, words = [], [], []
    for text in texts:
        tokens = text.translate(_NORMAL).split()
        words.append(len(tokens))
        sizes.extend(map(len, tokens))
        running = accumulate(tokens, lambda crc, token: zlib.crc32(b" " + token, crc), initial=0)
        ends.extend(islice(running, 1, None))
    words = np.array(words, dtype=np.int64)
    ends, sizes = np.array(ends, dtype=np.uint32), np.array(sizes, dtype=np.int64)
    first = np.cumsum(words) - words
    # prefixes before a word: the end of the word before it and a blank; the first word of a text stands after a blank alone
    before = np.zeros(len(ends), dtype=np.uint32)
    before[1:] = ends[:-1]
    before[first[words > 0]] = 0
    inverse = ~before
    starts = ~(_TABLE[(inverse ^ 0x20) & 255] ^ (inverse >> 8))
    at = np.cumsum(sizes + 1)
    left = np.arange(len(ends)) - np.repeat(first, words)
    left = np.repeat(words, words) - left  # words from here to the end of the text
    rows, crcs = [], []
    owner = np.repeat(np.arange(len(words)), words)
    for n in range(min_n, max_n + 1):
        i = np.flatnonzero(left >= n)
        j = i + n - 1
        length = at[j] - at[i] + sizes[i]
        crcs.append(ends[j] ^ shifted(starts[i], length))
        rows.append(owner[i])
    rows, crcs = np.concatenate(rows), np.concatenate(crcs)
    order = np.argsort(rows, kind="stable")
    return words, np.bincount(rows, minlength=len(words)).astype(np.int64), crcs[order]


def bucket_rows(docs: DataFrame, key: str | None, text: str, min_n: int = MIN_N, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """``key, n_words, n_features, buckets`` of every row's whole text; ``buckets`` repeats what the text repeats."""
    kind = "bigint" if key is None else docs.schema[key].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
            cuts = np.flatnonzero(np.diff(size // CHUNK)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(texts)]):
                words, features, crcs = ngram_crcs([x.as_py() or b"" for x in texts.slice(a, b - a)], min_n, max_n)
                offsets = np.concatenate([[0], np.cumsum(features)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array((crcs % buckets).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(words), pa.array(features), lists],
                    names=["key", "n_words", "n_features", "buckets"])

    rows = docs.select((F.lit(None).cast("bigint") if key is None else F.col(key)).alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(compute, f"key {kind}, n_words bigint, n_features bigint, buckets array<int>")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Features in each bucket over all rows; a task adds its own rows up, the driver gets one row a bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    parts = rows.select("buckets").mapInArrow(count, "bucket bigint, n bigint")
    return {r[0]: r[1] for r in parts.groupBy("bucket").agg(F.sum("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Smoothed log-ratio of target to source for each bucket, in thousandths, rounded down."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return np.array([
        math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(s_all + buckets) / (float(source.get(b, 0) + 1) * float(t_all + buckets))))
        for b in range(buckets)], dtype=np.int64)


def importance_weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
                       min_n: int = MIN_N, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``key, row, n_words, n_features, weight, score`` of every row of ``docs``, as a written table.

    ``weight`` is the sum of the gains of a text's features; ``score`` adds Gumbel noise that is a function of the seed
    and the key, so that the highest scores are a draw without replacement in proportion to ``exp(weight / 1000)``.
    ``row`` tells rows apart. Texts are read once, their buckets are written; gains are one number a bucket.
    """
    spark = docs.sparkSession
    rows = bucket_rows(docs, key, text, min_n, max_n, buckets).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "ngram-buckets")
    gain = gains(bucket_counts(rows, buckets), bucket_counts(bucket_rows(target, None, target_text, min_n, max_n, buckets), buckets), buckets)
    shared = spark.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, lists = batch.column(3).to_numpy(), batch.column(4)
            sums = np.concatenate([[0], np.cumsum(shared.value[lists.flatten().to_numpy()])])
            ends = np.cumsum(features)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sums[ends] - sums[ends - features])],
                names=["key", "row", "n_words", "n_features", "weight"])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.select("key", "row", "n_words", "n_features", "buckets").mapInArrow(
        weigh, f"key {kind}, row bigint, n_words bigint, n_features bigint, weight bigint")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return materialize(out.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))).cast("bigint")), "importance-weights")


def importance_resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
                        percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """``key, row, n_words, n_features, weight, score, rank`` of every row: what a draw of ``percent`` takes has a rank.

    Drawn are the rows of at least ``min_words`` words with the highest scores, ties to the smaller key, NULL keys last;
    repeated rows count each. Ranks come from a range sort of slim rows: a row's place in its partition plus the rows of
    the partitions before it, so no partition grows with a score or key that many rows share. NULL and empty texts have
    no features, weight 0 and no rank; an empty ``target`` smooths to equal shares; an empty table gives no rows;
    other columns don't matter.
    """
    scored = importance_weights(docs, target, key, text, target_text, **options)
    fits = F.col("n_words") >= min_words
    draw = scored.where(fits).count() * percent // 100
    order = [(~fits).asc(), F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("row").asc()]
    place = F.monotonically_increasing_id()
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place)
    ranged = materialize(ranged, "importance-order")
    part = F.shiftright("place", 33)
    sizes = ranged.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a partition
    ahead = [0, *accumulate(r["count"] for r in sizes)]
    spark = docs.sparkSession
    before = spark.createDataFrame([(r["part"], n) for r, n in zip(sizes, ahead)], "part bigint, ahead bigint")
    rank = F.col("ahead") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(F.broadcast(before), part == F.col("part")).select(
        "key", "row", "n_words", "n_features", "weight", "score", F.when(fits & (rank <= draw), rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the draw takes, with their own columns; rows of a drawn key that repeats all stay."""
    k = unused(docs.columns, "drawn_key")
    drawn = importance_resample(docs, target, key, **options).where("rank is not null").select(F.col("key").alias(k)).distinct()
    return docs.join(drawn, docs[key].eqNullSafe(drawn[k]), "left_semi")
