"""Sinks.  Everything is written as part files by the executors; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.operators import dataset as ds
from threatloom.sources.readers import AGGREGATED_FIELDS

# Column sets of the written files
PHISH_COLUMNS = ("url", "phish_id", "target", "submission_time", "verified_time", "source", "label")
FEED_COLUMNS = ("url", "domain", "source", "label", "download_time")
RANKED_COLUMNS = ("rank", "domain", "url", "source", "label")
SMS_COLUMNS = ("text", "label", "original_label", "source", "type")


def write_csv(df: DataFrame, path: str, columns) -> None:
    df.select(*columns).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def simple(df: DataFrame, text: str = "url") -> DataFrame:
    """The two-column projection text,label."""
    return df.select(F.col(text).alias("text"), "label")


def write_aggregated(records: DataFrame, path: str) -> None:
    write_csv(records, path, AGGREGATED_FIELDS)


def write_ingest_stats(records: DataFrame, feeds: DataFrame, path: str) -> None:
    """Per-source counts and the one-row summary as JSON."""
    ds.source_counts(records).write.json(f"{path}/sources")
    ds.ingest_summary(feeds).write.json(f"{path}/summary")


def write_splits(splits: DataFrame, path: str, fmt: str = "parquet", columns: tuple[str, ...] = AGGREGATED_FIELDS) -> None:
    """Partitioned by split, so reading one split prunes the others."""
    writer = splits.select(*columns, "split").write.partitionBy("split")
    (writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.parquet(path))


def write_split_stats(splits: DataFrame, path: str) -> None:
    ds.split_counts(splits).write.json(f"{path}/splits")
    ds.content_type_counts(splits).write.json(f"{path}/content_types")


def write_phish(records: DataFrame, path: str) -> None:
    write_csv(records, f"{path}/full", PHISH_COLUMNS)
    write_csv(simple(records), f"{path}/simple", ("text", "label"))


def write_feed(records: DataFrame, path: str) -> None:
    write_csv(records, f"{path}/full", FEED_COLUMNS)
    write_csv(simple(records), f"{path}/simple", ("text", "label"))


def write_ranked(records: DataFrame, path: str) -> None:
    """Full, simple, and the domain allow-list as plain text."""
    write_csv(records, f"{path}/full", RANKED_COLUMNS)
    write_csv(simple(records), f"{path}/simple", ("text", "label"))
    records.select("domain").write.text(f"{path}/domains")


def write_sms(records: DataFrame, path: str) -> None:
    """All, spam only, ham only (two columns each for the latter)."""
    write_csv(records, f"{path}/full", SMS_COLUMNS)
    for name, label in (("spam_only", "smishing"), ("ham_only", "legitimate")):
        write_csv(records.filter(F.col("label") == label), f"{path}/{name}", ("text", "label"))
