"""Structured Streaming jobs over arriving messages.

Each job is ordinary DataFrame code on a streaming source; the caller chooses
the sink, the trigger and the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatloom.functions import text as tx
from threatloom.operators import lookups as lk
from threatloom.operators import phishing as ph


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def score_stream(messages: DataFrame, suffixes, text: str = "text") -> DataFrame:
    """Continuous scoring: the stateless batch select, so the plan has no state or shuffle."""
    return ph.with_phishing_result(messages, text, suffixes=suffixes)


#: Micro-batch copies of a text go to so many first-level states.
COPY_SALTS = 64


def first_seen(messages: DataFrame, text: str, ts: str, delay: str, salts: int = COPY_SALTS) -> DataFrame:
    """text_hash, ``ts``: one row per normalised text within the watermark delay.

    State per hash only; it is forgotten once the watermark passes, unlike the
    batch deduplication over all history.  Two levels: a first one per hash and
    salt (of the time stamp), so that the copies of a hot text meet in many
    tasks and only one per salt goes on to the state of the hash alone.
    """
    slim = messages.select(tx.norm_hash(F.col(text)).alias("text_hash"), ts).withColumns(
        {"__salt": F.pmod(F.xxhash64(ts), F.lit(salts)).cast("int")}
    )
    first = slim.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["text_hash", "__salt"])
    return first.drop("__salt").dropDuplicatesWithinWatermark(["text_hash"])


def level_counts(scored: DataFrame, ts: str, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tumbling counts per threat level; rows older than the watermark are dropped.

    In update mode every window is delivered, open ones too (``run_upserts``).
    """
    return (
        scored.withWatermark(ts, delay)
        .groupBy(F.window(ts, width), "threat_level")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "threat_level", "n")
    )


def block_list(messages: DataFrame, url: str, blocked: DataFrame, column: str = "url") -> DataFrame:
    """Stream-static join: flag URLs found in the block list (re-read every micro-batch)."""
    return lk.flag_listed(messages, F.col(url), blocked, column, "is_listed")


def run_upserts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update mode into one parquet folder per micro-batch; ``latest`` reads the newest row per key.

    A repeated micro-batch overwrites its own folder, so the write is idempotent.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row per key of an upsert folder (partially aggregated)."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__v"))
    return newest.select(*keys, "__v.*")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available now into parquet and stop."""
    return (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
