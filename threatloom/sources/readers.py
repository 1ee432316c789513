"""Readers and record parsers.

``parse_*`` turn a DataFrame of raw lines or records into typed rows, so they
work on files, tables and streams alike; ``read_*`` put a file scan in front.
Schemas are explicit: nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.functions import url as ux
from threatloom.operators import dataset as ds
from threatloom.sources.jsonarray import read_json_arrays
from threatloom.sources.multiline import read_multiline_csv

PHISH_FIELDS = (
    "url", "phish_id", "phish_detail_url", "submission_time", "verified", "verification_time", "online", "target",
)
PHISH_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in PHISH_FIELDS])
AGGREGATED_FIELDS = ("text", "label", "source", "content_type")
AGGREGATED_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in AGGREGATED_FIELDS])
BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False, at: str | None = None) -> DataFrame:
    """Header CSV, every field a string; ``at`` names a column with the place of each row (``file_position``).

    One record per line unless ``multi_line``: quoted line breaks are found by quote parity (``multiline``), a file is
    still read by as many tasks as it has blocks.
    """
    if multi_line:
        return read_multiline_csv(spark, path, schema, at)
    reader = spark.read.option("header", True).option("escape", '"').option("quote", '"')
    rows = (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(path)
    return rows if at is None else rows.select("*", file_position().alias(at))


# ------------------------------------------------------------------ labelled text
def parse_tsv(lines: DataFrame, value: str = "value") -> DataFrame:
    """label<TAB>message lines; ``spam`` is 1, any other label 0.

    A line whose only tab is at an end has no message field; it is dropped.
    """
    parts = F.split(tx.strip(F.col(value)), "\t", 2)
    return (
        lines.filter(F.col(value).contains("\t")).withColumns({"__p": parts}).filter(F.size("__p") == 2)
        .withColumns({
            "message": F.col("__p")[1],
            "label": F.when(F.col("__p")[0] == "spam", 1).otherwise(0),
        }).drop("__p", value)
    )


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_tsv(spark.read.text(path))


def parse_training(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Strip, drop blanks, map known labels to 1 / 0 and drop the rest."""
    return ds.nonblank(df, text).withColumns({label: ds.binary_label(F.col(label))}).filter(F.col(label).isNotNull())


def read_training(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return parse_training(read_csv(spark, path, multi_line=multi_line))


def resolve_columns(df: DataFrame, text_col: str = "text", label_col: str = "label", at: Column | None = None) -> DataFrame:
    """text, label by case-insensitive header lookup; text falls back to ``text`` then ``url``.

    The fallback depends on which columns exist, not on nulls.  ``at`` is kept
    as a column of that name.
    """
    by_lower = {c.lower(): c for c in df.columns}

    def pick(wanted: str, *fallbacks: str) -> Column:
        actual = by_lower.get(wanted.lower())
        exact = set(df.columns)
        chosen = actual or next((f for f in fallbacks if f in exact), None)
        return F.col(f"`{chosen}`") if chosen else F.lit("")

    more = [] if at is None else [at.alias("at")]
    return df.select(pick(text_col, "text", "url").alias("text"), pick(label_col, "label").alias("label"), *more)


def read_feed(spark: SparkSession, path: str, source: str, content_type: str, priority: int,
              text_col: str = "text", label_col: str = "label", multi_line: bool = False) -> DataFrame:
    """One labelled CSV feed tagged with source, content type and ingest order.

    ``order`` is (priority, file, block, row): files by path, whatever way the
    scan packs them into tasks.
    """
    raw = read_csv(spark, path, multi_line=multi_line, at="__at")
    rows = resolve_columns(raw, text_col, label_col, F.col("__at"))
    return rows.select(
        "text", "label", F.lit(source).alias("source"), F.lit(content_type).alias("content_type"),
        F.struct(F.lit(priority).alias("priority"), "at.*").alias("order"),
    )


def file_position() -> Column:
    """Where a scanned row stands: path and block of its file, and its place among that block's rows."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_feeds(spark: SparkSession, manifest: Iterable[tuple[str, str, str, int]], multi_line: bool = False) -> DataFrame:
    """Union of feeds (path, source, content type, priority)."""
    return ds.union_all(read_feed(spark, p, s, t, k, multi_line=multi_line) for p, s, t, k in manifest)


def aggregated_rows(df: DataFrame) -> DataFrame:
    """Records whose label is phishing / legitimate when lower-cased (no strip)."""
    return df.withColumns({"label": F.lower("label")}).filter(F.col("label").isin(rules.POSITIVE, rules.NEGATIVE))


def read_aggregated(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return aggregated_rows(read_csv(spark, path, AGGREGATED_SCHEMA, multi_line))


# ------------------------------------------------------------------ URL feeds
def phish_records(raw: DataFrame) -> DataFrame:
    """Standard phish record with defaults, verified rows with a URL only."""
    def get(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    return raw.withColumns({
        **{n: get(n) for n in ("url", "phish_id", "phish_detail_url", "submission_time", "target")},
        "verified": get("verified", "no"), "online": get("online", "no"),
        "verified_time": get("verification_time"),
        "source": F.lit("phishtank"), "label": F.lit(rules.POSITIVE),
    }).drop("verification_time").filter((F.col("verified") == "yes") & (F.col("url") != ""))


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """First ``n`` rows by an explicit order (files have none in Spark)."""
    return df.orderBy(order).limit(n)


def read_phish_feed(spark: SparkSession, path: str, max_urls: int | None = None, lines: bool = False) -> DataFrame:
    """(Gzipped) JSON array of phish rows; the head is taken before the verified filter.

    A task streams an array object by object (``jsonarray``); ``lines`` reads one object per line instead.
    """
    if lines:
        raw = spark.read.schema(PHISH_SCHEMA).json(path).select("*", file_position().alias("__seq"))
    else:
        raw = read_json_arrays(spark, path, PHISH_FIELDS, ("__path", "__row"))
        raw = raw.select(*PHISH_FIELDS, F.struct("__path", "__row").alias("__seq"))
    if max_urls is not None:
        raw = head(raw, "__seq", max_urls)
    return phish_records(raw.drop("__seq"))


def parse_url_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Trimmed lines that start with ``http`` (case-sensitive) as column ``url``."""
    return lines.withColumns({"url": tx.strip(F.col(value))}).filter(F.col("url").startswith("http")).drop(value)


def feed_records(urls: DataFrame) -> DataFrame:
    """URL feed record: domain (network location), source, label."""
    return urls.withColumns({
        "domain": ux.parts(F.col("url"))["netloc"], "source": F.lit("openphish"), "label": F.lit(rules.POSITIVE),
    })


def read_url_feed(spark: SparkSession, path: str) -> DataFrame:
    """URL per line, unique, as feed records stamped with the load time."""
    urls = parse_url_lines(spark.read.text(path)).select("url").distinct()
    return feed_records(urls).withColumns({"download_time": F.current_timestamp()})


def parse_ranked(lines: DataFrame, limit: int | None, order: str, value: str = "value") -> DataFrame:
    """``rank,domain`` lines; with a ``limit`` those with rank <= limit, and the first ``limit`` of them by ``order``."""
    parts = F.split(tx.strip(F.col(value)), ",")
    rank = F.col("__p")[0]
    usable = lines.withColumns({"__p": parts}).filter(F.size("__p") >= 2).withColumns({
        "rank": F.when(tx.strip(rank).rlike(r"^[+-]?\d+$"), tx.strip(rank).try_cast("int")),
        "domain": tx.strip(F.col("__p")[1]),
    }).filter(F.col("rank").isNotNull() & (F.col("domain") != "")).drop("__p", value)
    if limit is not None:
        usable = head(usable.filter(F.col("rank") <= limit), order, limit)
    return usable.withColumns({
        "url": F.concat(F.lit("https://"), F.col("domain")),
        "source": F.lit("tranco"), "label": F.lit(rules.NEGATIVE),
    })


def read_ranked(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    lines = spark.read.text(path).select("*", file_position().alias("__seq"))
    return parse_ranked(lines, limit, "__seq").drop("__seq")


# ------------------------------------------------------------------ messages
def parse_sms(lines: DataFrame, value: str = "value") -> DataFrame:
    """label<TAB>message lines: spam -> smishing, ham -> legitimate, others dropped."""
    parts = F.split(tx.strip(F.col(value)), "\t", 2)
    return (
        lines.withColumns({"__p": parts}).filter(F.size("__p") == 2)
        .withColumns({
            "text": tx.strip(F.col("__p")[1]),
            "original_label": tx.strip(F.lower(F.col("__p")[0])),
            "source": F.lit("uci_sms"), "type": F.lit("sms"),
        })
        .withColumns({"label": F.when(F.col("original_label") == "spam", "smishing")
                      .when(F.col("original_label") == "ham", rules.NEGATIVE)})
        .filter((F.col("text") != "") & F.col("label").isNotNull())
        .drop("__p", value)
    )


def read_sms(spark: SparkSession, path: str) -> DataFrame:
    return parse_sms(spark.read.text(path))


def message_splits(splits: dict[str, DataFrame], which: str = "train") -> DataFrame:
    """train, test or all: text -> message, label = (spam), split dropped."""
    chosen = ds.union_all(splits.values()) if which == "all" else splits[which]
    return chosen.withColumnRenamed("text", "message").withColumns(
        {"label": F.when(F.col("label") == "spam", 1).otherwise(0)}
    ).drop("split")


def dialogues(df: DataFrame) -> DataFrame:
    return df.select(F.col("dialogue").alias("message"), "label")


def combined_corpus(messages: DataFrame, dialogue: DataFrame) -> DataFrame:
    """Both corpora tagged with their source."""
    return ds.union_all([
        messages.withColumns({"source": F.lit("sms_spam")}), dialogue.withColumns({"source": F.lit("scam_dialogue")}),
    ])


def read_binary_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """One row per file.  ``max_bytes`` moves the size test into the scan (use
    ``oversized_files`` to list what it leaves out)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files if max_bytes is None else files.filter(F.col("length") <= max_bytes)


def oversized_files(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").filter(F.col("length") > max_bytes)


# ------------------------------------------------------------------ requests
def validate(df: DataFrame, column: str, kind: str, scan_type: str | None = None) -> DataFrame:
    """Append ``reject_reason`` (null when valid) by the length and enumeration bounds of ``kind``."""
    low, high = rules.REQUEST_LIMITS[kind]
    n = F.length(column)
    reason = F.when(F.col(column).isNull(), "missing").when(n < low, "too short").when(n > high, "too long")
    if scan_type is not None:
        reason = reason.when(~F.col(scan_type).isin(*rules.SCAN_TYPES), "unknown scan type")
    return df.withColumns({"reject_reason": reason})
