"""Queries over sources, filters, lookups, counts, deduplication, splits, balancing and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.functions import url as ux
from threatloom.operators import dataset as ds
from threatloom.operators import incremental as inc
from threatloom.operators import lookups as lk
from threatloom.operators import metrics as mt
from threatloom.operators import spam as sp
from threatloom.operators import threats as th
from threatloom.plans import fixtures as fx
from threatloom.plans.fixtures import with_views
from threatloom.plans.registry import registry
from threatloom.session import materialize, scratch_path, table
from threatloom.sources import readers as rd
from threatloom.sources import sinks as sk

QUERIES, ORACLES, query = registry()


def one_line(c):
    """Line formats hold one record per line: fold line breaks and tabs to blanks."""
    return F.regexp_replace(c, r"[\r\n\t]", " ")


# ------------------------------------------------------------------ sources
@query(with_views(r"""SELECT doc_id, CASE WHEN label = 'spam' THEN 1 ELSE 0 END AS label,
  regexp_replace(regexp_replace(text, '[\r\n\t]', ' ', 'g'), '\s+$', '') AS message FROM feed
  WHERE label <> 'promo'""", "feed"))
def src_tsv_labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled tab-separated lines; lines without a tab are skipped."""
    line = F.concat("label", F.when(F.col("label") == "promo", " ").otherwise("\t"), one_line("text"))
    lines = fx.feed(spark, folder).select("doc_id", line.alias("value"))
    return rd.parse_tsv(lines)


def _csv_feed(spark, folder, fmt_columns) -> str:
    path = scratch_path(spark, "csv")
    fx.feed(spark, folder).select(*fmt_columns).write.option("header", True).option("escape", '"').csv(path)
    return path


@query(with_views(r"""SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text,
  CASE WHEN lower(trim(label)) IN ('phishing', 'spam', 'smishing') THEN 1 ELSE 0 END AS label
  FROM feed WHERE label <> 'promo' AND trim(text) <> ''""", "feed"))
def src_csv_binary_labels(spark: SparkSession, folder: str) -> DataFrame:
    path = _csv_feed(spark, folder, ["doc_id", "text", "label"])
    return rd.read_training(spark, path, multi_line=True).withColumns({"doc_id": F.col("doc_id").cast("long")})


@query("SELECT url AS text, 'spam' AS label FROM pages")
def src_csv_column_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """No text column: the header lookup is case-insensitive and falls back to url."""
    path = scratch_path(spark, "csv")
    table(spark, folder, "pages").select("url", F.lit("spam").alias("LABEL")).write.option("header", True).csv(path)
    return rd.resolve_columns(rd.read_csv(spark, path), "message", "label")


def _feed_files(spark, feed: DataFrame) -> list[tuple[str, str, str, int]]:
    """A feed written once as CSV, one folder per source, and its manifest."""
    base = scratch_path(spark, "feeds")
    feed.write.partitionBy("source").option("header", True).option("escape", '"').csv(base)
    return [(f"{base}/source={s}", s, kind, k) for s, kind, k in rules.FEED_SOURCES]


@query(with_views("SELECT source, content_type, text, trim(label) AS label FROM feed", "feed"))
def src_multi_source_union(spark: SparkSession, folder: str) -> DataFrame:
    """Four CSV feeds with their content types, unioned in priority order."""
    manifest = _feed_files(spark, fx.feed(spark, folder).select("text", "label", "source"))
    return rd.read_feeds(spark, manifest, multi_line=True).select("source", "content_type", "text", "label")


@query(r"""WITH rows AS (SELECT doc_id * 3 + k AS n, doc_id, k, regexp_replace(text, '[\r\n\t]', ' ', 'g') AS text FROM documents, range(0, 3) t(k)),
placed AS (SELECT n, text, n % 4 AS source, CASE WHEN doc_id % 7 = 0 THEN 'spam' ELSE 'ham' END AS label,
  n % 4 AS priority, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS file FROM rows),
stripped AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS clean FROM placed),
firsts AS (SELECT *, row_number() OVER (PARTITION BY lower(clean) ORDER BY priority, file, n) AS r FROM stripped WHERE clean <> '')
SELECT clean AS text, CASE label WHEN 'spam' THEN 'phishing' ELSE 'legitimate' END AS label,
  ['phishtank', 'openphish', 'tranco', 'uci_sms'][source + 1] AS source FROM firsts WHERE r = 1""".replace("\\\\", "\\"))
def src_ordered_feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds of two unequal files each, every text in three feeds: the first row by source, file and line wins."""
    base, n = scratch_path(spark, "feeds"), F.col("n")
    # documents are dealt by ranges before a text becomes three rows: a file of any size is parts in line order, a task
    # each; the names of files and parts sort like their numbers
    docs = fx.documents(spark, folder).select("doc_id", one_line("text").alias("text")).repartitionByRange("doc_id")
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    rows = rows.select("doc_id", "text", (F.col("doc_id") * 3 + F.col("k")).alias("n")).select(
        "text", F.when(F.col("doc_id") % 7 == 0, "spam").otherwise("ham").alias("label"), n, (n % 4).alias("feed"),
        F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("file"))
    rows.sortWithinPartitions("feed", "file", "n").drop("n").write.partitionBy("feed", "file").option("header", True).option(
        "escape", '"').option("compression", "lz4").csv(base)
    feeds = rd.read_feeds(spark, [(f"{base}/feed={k}", s, kind, k) for s, kind, k in rules.FEED_SOURCES])
    return ds.aggregate_feeds(feeds).select("text", "label", "source")


@query(with_views("SELECT text, label, source, content_type FROM records", "records"))
def src_aggregated_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "aggregated")
    sk.write_aggregated(fx.records(spark, folder), path)
    return rd.read_aggregated(spark, path, multi_line=True)


@query(with_views("""SELECT url, phish_id, phish_detail_url, submission_time, verified,
  coalesce(verification_time, '') AS verified_time, coalesce(online, 'no') AS online,
  coalesce(target, '') AS target, 'phishtank' AS source, 'phishing' AS label
  FROM phish_feed WHERE verified = 'yes' AND url <> ''""", "phish_feed"))
def src_json_phish_feed(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "json")
    fx.phish_feed(spark, folder).drop("seq").write.option("compression", "gzip").json(path)
    raw = spark.read.schema(rd.PHISH_SCHEMA).json(path)
    return rd.phish_records(raw)


@query(with_views("SELECT url_id, url FROM urls WHERE url LIKE 'http%'", "urls"))
def src_text_url_feed(spark: SparkSession, folder: str) -> DataFrame:
    lines = fx.urls(spark, folder).select("url_id", F.concat(F.lit("  "), "url", F.lit(" ")).alias("value"))
    return rd.parse_url_lines(lines)


@query(r"""SELECT page_id, page_id::INTEGER AS rank, regexp_extract(url, '://([^/]+)', 1) AS domain,
  'https://' || regexp_extract(url, '://([^/]+)', 1) AS url, 'tranco' AS source, 'legitimate' AS label
  FROM pages""")
def src_ranked_domains(spark: SparkSession, folder: str) -> DataFrame:
    """rank,domain lines next to unparsable, one-field and blank lines."""
    return rd.parse_ranked(_ranked_lines(spark, folder), None, "page_id")


@query(r"""SELECT page_id, page_id::INTEGER AS rank, regexp_extract(url, '://([^/]+)', 1) AS domain,
  'https://' || regexp_extract(url, '://([^/]+)', 1) AS url, 'tranco' AS source, 'legitimate' AS label
  FROM pages WHERE page_id <= 100 ORDER BY page_id LIMIT 100""")
def top_ranked_domains(spark: SparkSession, folder: str) -> DataFrame:
    """The head of the ranking: the first 100 usable lines of rank 100 or better (the limit is the feature)."""
    return rd.parse_ranked(_ranked_lines(spark, folder), 100, "page_id")


def _ranked_lines(spark: SparkSession, folder: str) -> DataFrame:
    i, host = F.col("page_id").cast("string"), ux.host(F.col("url"))
    return table(spark, folder, "pages").select("page_id", F.explode(F.array(
        F.concat_ws(",", i, host), F.concat_ws(",", F.lit("n/a"), host), i, F.lit("  ")
    )).alias("value"))


@query(with_views(r"""SELECT doc_id, trim(regexp_replace(text, '[\r\n\t]', ' ', 'g')) AS text, label AS original_label,
  'uci_sms' AS source, 'sms' AS type, CASE WHEN label = 'spam' THEN 'smishing' ELSE 'legitimate' END AS label
  FROM feed WHERE label IN ('spam', 'ham')""", "feed"))
def src_sms_collection(spark: SparkSession, folder: str) -> DataFrame:
    lines = fx.feed(spark, folder).select("doc_id", F.concat("label", F.lit("\t"), one_line("text")).alias("value"))
    return rd.parse_sms(lines)


@query(with_views("""SELECT msg_id, text AS message, label FROM messages""", "messages"))
def src_message_splits(spark: SparkSession, folder: str) -> DataFrame:
    """train and test partitions of a message data set, read back as one."""
    path = scratch_path(spark, "splits")
    m = fx.messages(spark, folder).select(
        "msg_id", "text", F.when(F.col("label") == 1, "spam").otherwise("not_spam").alias("label"),
        F.when(F.col("source") == "url", "test").otherwise("train").alias("split"),
    )
    m.write.partitionBy("split").parquet(path)
    whole = spark.read.parquet(path)
    parts = {s: whole.filter(F.col("split") == s) for s in ("train", "test")}
    return rd.message_splits(parts, "all")


@query(with_views("SELECT dialogue AS message, label FROM dialogues", "dialogues"))
def src_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    return rd.dialogues(fx.dialogue_rows(spark, folder))


@query(with_views("""SELECT text AS message, label, 'sms_spam' AS source FROM messages
  UNION ALL SELECT dialogue, label, 'scam_dialogue' FROM dialogues""", "messages", "dialogues"))
def src_combined_corpus(spark: SparkSession, folder: str) -> DataFrame:
    sms = fx.messages(spark, folder).select(F.col("text").alias("message"), "label")
    return rd.combined_corpus(sms, rd.dialogues(fx.dialogue_rows(spark, folder)))


BINARY_FILE_LINES = 2_000


@query("""SELECT sum(strlen(text) + 1)::BIGINT AS bytes, sum(strlen(text) - strlen(replace(text, chr(10), '')) + 1)::BIGINT AS lines,
  true AS entropies_fit FROM documents""")
def src_binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole files as bytes (the part files of a table written for the purpose): totals of size, lines and entropy bounds."""
    path = scratch_path(spark, "files")
    # a file is one row: files of so many lines stay small however large the table is
    fx.documents(spark, folder).select("text").write.option("maxRecordsPerFile", BINARY_FILE_LINES).text(path)
    files = rd.read_binary_files(spark, path)
    lines = F.length("content") - F.octet_length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")))
    return th.with_byte_entropy(files, "content").agg(
        F.sum("length").alias("bytes"), F.sum(lines).cast("bigint").alias("lines"),
        F.bool_and(F.col("byte_entropy").between(0, 8)).alias("entropies_fit"),
    )


# ------------------------------------------------------------------ sinks
@query(with_views("""ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || key)) - 1 AS r,
    count(*) OVER (PARTITION BY label) AS n FROM records)
SELECT CASE WHEN r < trunc(n * 0.7::DOUBLE) THEN 'train' WHEN r < trunc(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val'
  ELSE 'test' END AS split, label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM ranked GROUP BY ALL""", "records"))
def snk_roundtrip_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Write the splits partitioned, read them back, aggregate."""
    path = scratch_path(spark, "splits")
    records = materialize(fx.records(spark, folder), "records")
    sk.write_splits(ds.stratified_split(records, "key"), path)
    return spark.read.parquet(path).groupBy("split", "label").agg(
        F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars")
    )


@query(with_views("SELECT url AS text, 'phishing' AS label FROM phish_feed WHERE verified = 'yes' AND url <> ''", "phish_feed"))
def snk_simple_projection(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "phish")
    sk.write_phish(rd.phish_records(fx.phish_feed(spark, folder)), path)
    return rd.read_csv(spark, f"{path}/simple")


@query(with_views(r"""SELECT label, regexp_replace(message, '\s+$', '') AS message FROM (SELECT CASE WHEN label = 'spam' THEN 1 ELSE 0 END AS label,
  regexp_replace(text, '[\r\n\t]', ' ', 'g') AS message FROM feed)""", "feed"))
def src_tsv_files(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated lines from text files."""
    path = scratch_path(spark, "tsv")
    fx.feed(spark, folder).select(F.concat("label", F.lit("\t"), one_line("text")).alias("value")).write.text(path)
    return rd.read_tsv(spark, path).select("label", "message")


@query(with_views(r"""SELECT trim(regexp_replace(text, '[\r\n\t]', ' ', 'g')) AS text, CASE WHEN label = 'spam' THEN 'smishing' ELSE 'legitimate' END AS label,
  label AS original_label FROM feed WHERE label IN ('spam', 'ham')""", "feed"))
def snk_sms_files(spark: SparkSession, folder: str) -> DataFrame:
    """SMS lines from text files, written by the sink and read back."""
    raw, path = scratch_path(spark, "sms"), scratch_path(spark, "sms-out")
    fx.feed(spark, folder).select(F.concat("label", F.lit("\t"), one_line("text")).alias("value")).write.text(raw)
    sk.write_sms(rd.read_sms(spark, raw), path)
    return rd.read_csv(spark, f"{path}/full").select("text", "label", "original_label")


@query(with_views("""SELECT DISTINCT url, regexp_extract(url, '^[^:/]+://([^/?#]*)', 1) AS domain, 'phishing' AS label
  FROM urls WHERE url LIKE 'http%'""", "urls"))
def snk_url_feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """URLs from text files, unique, written by the feed sink and read back."""
    raw, path = scratch_path(spark, "urls"), scratch_path(spark, "urls-out")
    fx.urls(spark, folder).select(F.concat(F.lit(" "), "url").alias("value")).write.text(raw)
    sk.write_feed(rd.read_url_feed(spark, raw), path)
    return rd.read_csv(spark, f"{path}/full").select("url", "domain", "label")


@query(r"""SELECT page_id AS rank, regexp_extract(url, '://([^/]+)', 1) AS domain, 'legitimate' AS label FROM pages""")
def snk_ranked_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked sites from text files, written by the sink and read back."""
    raw, path = scratch_path(spark, "ranked"), scratch_path(spark, "ranked-out")
    _ranked_lines(spark, folder).select("value").write.text(raw)
    sk.write_ranked(rd.read_ranked(spark, raw), path)
    return rd.read_csv(spark, f"{path}/full").select(F.col("rank").cast("bigint").alias("rank"), "domain", "label")


@query(with_views("""SELECT url, phish_id, coalesce(target, '') AS target, 'phishing' AS label
  FROM phish_feed WHERE verified = 'yes' AND url <> ''""", "phish_feed"))
def src_json_array(spark: SparkSession, folder: str) -> DataFrame:
    """Gzipped JSON arrays, one per partition of the feed."""
    path = scratch_path(spark, "array")
    rows = fx.phish_feed(spark, folder).drop("seq").select(F.to_json(F.struct("*")).alias("j"), F.spark_partition_id().alias("p"))
    rows.groupBy("p").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).select(
        "value", "p").write.partitionBy("p").option("compression", "gzip").text(path)  # one array per file
    return rd.read_phish_feed(spark, path).select("url", "phish_id", "target", "label")


@query(with_views("""SELECT (SELECT count(*) FROM records) AS total, (SELECT count(*) FROM seen WHERE stripped <> '') - (SELECT count(*) FROM firsts) AS duplicates_removed,
  (SELECT count(DISTINCT source) + 1 FROM records) AS source_rows""", "records"))
def snk_ingest_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregation statistics as JSON files, read back."""
    path = scratch_path(spark, "stats")
    sk.write_ingest_stats(fx.records(spark, folder), fx.feed(spark, folder), path)
    sources = spark.read.schema("source string").json(f"{path}/sources").agg(F.count("*").alias("source_rows"))
    return spark.read.schema("total bigint, duplicates_removed bigint").json(f"{path}/summary").crossJoin(sources)  # one row each


@query(with_views("""ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || key)) - 1 AS r,
    count(*) OVER (PARTITION BY label) AS n FROM records)
SELECT CASE WHEN r < trunc(n * 0.7::DOUBLE) THEN 'train' WHEN r < trunc(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val'
  ELSE 'test' END AS split, count(*) AS total FROM ranked GROUP BY ALL""", "records"))
def snk_split_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Split statistics as JSON files, read back."""
    path = scratch_path(spark, "stats")
    sk.write_split_stats(ds.stratified_split(fx.records(spark, folder), "key"), path)
    return spark.read.schema("split string, total bigint").json(f"{path}/splits")


# ------------------------------------------------------------------ projections, filters
@query(with_views("""SELECT seq, url, phish_id, phish_detail_url, submission_time, verified,
  coalesce(verification_time, '') AS verified_time, coalesce(online, 'no') AS online,
  coalesce(target, '') AS target, 'phishtank' AS source, 'phishing' AS label
  FROM phish_feed WHERE verified = 'yes' AND url <> ''""", "phish_feed"))
def prj_phish_record(spark: SparkSession, folder: str) -> DataFrame:
    return rd.phish_records(fx.phish_feed(spark, folder))


@query(with_views("""SELECT url_id, url, regexp_extract(url, '^[^:/]+://([^/?#]*)', 1) AS domain,
  'openphish' AS source, 'phishing' AS label FROM urls""", "urls"))
def prj_feed_record(spark: SparkSession, folder: str) -> DataFrame:
    return rd.feed_records(fx.urls(spark, folder))


@query(with_views("""SELECT msg_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS input FROM inbox""", "inbox"))
def prj_truncate_echo(spark: SparkSession, folder: str) -> DataFrame:
    return fx.inbox(spark, folder).select("msg_id", tx.echo(F.col("text")).alias("input"))


@query(r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents WHERE regexp_matches(text, '\S')")
def fil_nonblank(spark: SparkSession, folder: str) -> DataFrame:
    """Every document three times: padded, blank, null; only the padded one survives."""
    padded = fx.documents(spark, folder).select("doc_id", F.explode(F.array(
        F.concat(F.lit("\n "), "text", F.lit("\t ")), F.lit(" \n\t "), F.lit(None)
    )).alias("text"))
    return ds.nonblank(padded, "text")


@query(with_views("""SELECT doc_id, CASE WHEN lower(trim(label)) IN ('spam', 'phishing', 'smishing') THEN 'phishing'
  ELSE 'legitimate' END AS label FROM feed WHERE label <> 'promo'""", "feed"))
def fil_known_labels(spark: SparkSession, folder: str) -> DataFrame:
    return ds.known_labels(fx.feed(spark, folder).select("doc_id", "label"), "label")


@query(with_views("SELECT seq, url FROM phish_feed WHERE verified = 'yes' AND url <> ''", "phish_feed"))
def fil_verified_urls(spark: SparkSession, folder: str) -> DataFrame:
    return rd.phish_records(fx.phish_feed(spark, folder)).select("seq", "url")


@query(with_views(r"""SELECT msg_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 3 AS is_short FROM inbox""", "inbox"))
def fil_short_text_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Short rows stay in the result, marked for the constant safe answer."""
    return fx.inbox(spark, folder).select("msg_id", tx.short(F.col("text")).alias("is_short"))


@query(with_views("""SELECT msg_id, CASE WHEN length(text) < 1 THEN 'too short' WHEN length(text) > 10000 THEN 'too long' END AS message_reject,
  CASE WHEN length(text) < 1 THEN 'too short' WHEN length(text) > 50000 THEN 'too long'
    WHEN msg_id % 4 = 3 THEN 'unknown scan type' END AS text_reject,
  CASE WHEN length(text) < 5 THEN 'too short' WHEN length(text) > 2000 THEN 'too long' END AS url_reject FROM inbox""", "inbox"))
def fil_validate_requests(spark: SparkSession, folder: str) -> DataFrame:
    df = fx.inbox(spark, folder).withColumns({
        "scan": F.when(F.col("msg_id") % 4 == 3, "voice").otherwise("auto")
    })
    out = rd.validate(df, "text", "message").withColumnRenamed("reject_reason", "message_reject")
    out = rd.validate(out, "text", "text", "scan").withColumnRenamed("reject_reason", "text_reject")
    out = rd.validate(out, "text", "url").withColumnRenamed("reject_reason", "url_reject")
    return out.select("msg_id", "message_reject", "text_reject", "url_reject")


@query(with_views("""SELECT msg_id, CASE WHEN msg_id % 7 = 2 THEN 'error' WHEN score >= 0.75 THEN 'spam' ELSE 'ham' END AS prediction,
  CASE WHEN msg_id % 7 = 2 THEN 'probability is null' END AS error FROM scores""", "scores"))
def fil_error_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that cannot be scored become error rows, the batch goes on."""
    scored = fx.with_scores(fx.messages(spark, folder).select("msg_id", "label", "text"))
    scored = scored.withColumns({"p": F.when(F.col("msg_id") % 7 != 2, F.col("score"))})
    return sp.with_spam_result(scored, "text", "p").select("msg_id", "prediction", "error")


# ------------------------------------------------------------------ lookups
@query("""SELECT doc_id, sha256(text) AS sha256, text IN (SELECT text FROM benchmark) OR source = 'src7'
  OR text IN (SELECT text FROM documents WHERE source = 'src7') AS is_known FROM documents""")
def join_known_hash(spark: SparkSession, folder: str) -> DataFrame:
    d = fx.documents(spark, folder).select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return lk.flag_listed(d, F.col("sha256"), fx.known_hashes(spark, folder), "sha256", "is_known")


@query(with_views("""SELECT doc_id, label, CASE WHEN lower(trim(label)) IN ('spam', 'phishing', 'smishing') THEN 'phishing'
  WHEN label = 'promo' THEN 'unknown' ELSE 'legitimate' END AS canonical_label FROM feed""", "feed"))
def join_label_map(spark: SparkSession, folder: str) -> DataFrame:
    mapping = spark.createDataFrame(list(rules.LABEL_MAP.items()), "name string, canonical string")
    return lk.map_labels(fx.feed(spark, folder).select("doc_id", "label"), "label", mapping)


_HOSTS_SQL = r"""hosts AS (SELECT url_id, lower(regexp_replace(regexp_replace(
    regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), ':.*$', '')) AS host FROM urls)"""
_SUFFIX_SQL = _HOSTS_SQL + rf""",
listed AS (SELECT unnest({fx._q(fx.SUFFIXES)}) AS suffix),
best AS (SELECT url_id, host, CASE WHEN regexp_full_match(host, '[0-9.]+') THEN ''
    ELSE coalesce((SELECT max_by(suffix, length(suffix)) FROM listed
                   WHERE host = suffix OR ends_with(host, '.' || suffix)), '') END AS suffix FROM hosts),
rest AS (SELECT url_id, host, suffix, CASE WHEN regexp_full_match(host, '[0-9.]+') THEN NULL
    WHEN suffix = '' THEN host ELSE substring(host, 1, length(host) - length(suffix) - 1) END AS front FROM best),
split AS (SELECT url_id, suffix, coalesce(regexp_extract(front, '([^.]*)$', 1), host) AS domain,
    CASE WHEN contains(coalesce(front, ''), '.') THEN regexp_replace(front, '\.[^.]*$', '') ELSE '' END AS subdomain FROM rest)"""


_RULES_SQL = _HOSTS_SQL + rf""",
listed AS (SELECT unnest({fx._q(fx.RULE_SUFFIXES)}) AS rule),
tails AS (SELECT url_id, host, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS tail
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM hosts)),
hit AS (SELECT url_id, max(length(tail)) FILTER (rule = tail OR rule = '*.' || regexp_replace(tail, '^[^.]*\.', '') AND contains(tail, '.')) AS n,
    max(length(regexp_replace(tail, '^[^.]*\.', ''))) FILTER (rule = '!' || tail) AS x FROM tails, listed GROUP BY url_id),
best AS (SELECT url_id, host, CASE WHEN regexp_full_match(host, '[0-9.]+') THEN '' ELSE coalesce(right(host, coalesce(x, n)), '') END AS suffix
  FROM hosts JOIN hit USING (url_id)),""".replace("\\\\", "\\") + _SUFFIX_SQL[_SUFFIX_SQL.index("\nrest AS"):]


@query(with_views(_RULES_SQL + " SELECT url_id, subdomain, domain, suffix FROM split", "urls"))
def join_public_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """Host to subdomain, domain and suffix, with plain, wildcard and exception rules as a joined table."""
    suffixes = spark.createDataFrame([(s,) for s in fx.RULE_SUFFIXES], "suffix string")
    u = fx.urls(spark, folder).withColumns({"host": F.lower(ux.host(F.col("url")))})
    return lk.split_hosts(u, "host", suffixes).select("url_id", "subdomain", "domain", "suffix")


@query(with_views(_SUFFIX_SQL + """ SELECT url_id, suffix IN ('tk', 'xyz', 'top') AS extractor_hit,
  suffix IN ('tk', 'xyz', 'top') AS detector_hit FROM split""", "urls"))
def join_suspicious_tld(spark: SparkSession, folder: str) -> DataFrame:
    suffix = F.lower(ux.longest_suffix(F.col("host"), fx.SUFFIXES))
    u = fx.urls(spark, folder).select("url_id", ux.host(F.col("url")).alias("host")).withColumns({"suffix": suffix})
    return u.select(
        "url_id",
        F.col("suffix").isin(*rules.EXTRACTOR_SUSPICIOUS_TLDS).alias("extractor_hit"),
        F.col("suffix").isin(*rules.DETECTOR_SUSPICIOUS_TLDS).alias("detector_hit"),
    )


@query(with_views("""SELECT url_id, regexp_matches(lower(url), 'bit\\.ly|t\\.co|j\\.mp|is\\.gd|rb\\.gy|goo\\.gl|ow\\.ly') AS detector_hit,
  regexp_matches(lower(url), 'bit\\.ly|t\\.co|j\\.mp|is\\.gd|rb\\.gy|goo\\.gl|ow\\.ly|cli\\.gs|clck\\.ru') AS extractor_hit FROM urls""".replace("\\\\", "\\"), "urls"))
def join_shortener_contains(spark: SparkSession, folder: str) -> DataFrame:
    low = tx.fold(F.col("url"))
    return fx.urls(spark, folder).select(
        "url_id", tx.contains_any(low, rules.DETECTOR_SHORTENERS).alias("detector_hit"),
        tx.contains_any(low, rules.EXTRACTOR_SHORTENERS).alias("extractor_hit"),
    )


@query(with_views("SELECT url_id, url IN (SELECT url FROM phish_feed WHERE verified = 'yes' AND url <> '') AS is_listed FROM urls", "phish_feed"))
def join_phish_blocklist(spark: SparkSession, folder: str) -> DataFrame:
    listed = rd.phish_records(fx.phish_feed(spark, folder))
    return lk.flag_listed(fx.urls(spark, folder), F.col("url"), listed, "url", "is_listed").select("url_id", "is_listed")


@query(with_views(_SUFFIX_SQL + """,
allowed AS (SELECT DISTINCT regexp_extract(url, '([^./]+\\.[^./]+)(/.*)?$', 1) AS d FROM (
  SELECT regexp_extract(url, '^[a-z]+://[^/]*', 0) AS url FROM pages WHERE url LIKE '%.example.com%'))
SELECT url_id FROM split WHERE domain || '.' || suffix NOT IN (SELECT d FROM allowed)""", "urls"))
def join_allowlist_anti(spark: SparkSession, folder: str) -> DataFrame:
    """URLs whose registered domain is not on the allow-list."""
    allowed = table(spark, folder, "pages").filter(F.col("url").contains(".example.com")).select(
        lk.registered_domain(F.col("url"), fx.SUFFIXES).alias("domain")
    )
    u = fx.urls(spark, folder).withColumns({"registered": lk.registered_domain(F.col("url"), fx.SUFFIXES)})
    return lk.drop_listed(u, F.col("registered"), allowed, "domain").select("url_id")


@query("""SELECT d.doc_id, l.toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)""")
def join_doc_labels(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "labels").select("doc_id", "toxic", F.lit(True).alias("labelled"))
    return table(spark, folder, "documents").select("doc_id").join(l, "doc_id", "left").withColumns(
        {"labelled": F.coalesce("labelled", F.lit(False))}
    )


# ------------------------------------------------------------------ counts
@query(with_views("SELECT count(*) AS total, sum(label)::BIGINT AS spam, (count(*) - sum(label))::BIGINT AS ham FROM messages", "messages"))
def agg_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return mt.label_counts(fx.messages(spark, folder))


@query(with_views("""SELECT source, grouping(source)::INTEGER AS is_total, count(*) AS total,
  count(*) FILTER (label = 'phishing') AS phishing, count(*) FILTER (label = 'legitimate') AS legitimate
  FROM records GROUP BY ROLLUP (source)""", "records"))
def agg_source_label_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return ds.source_counts(fx.records(spark, folder))


@query(with_views("""SELECT count(*) AS rows_seen, count(DISTINCT lower(stripped)) AS distinct_texts,
  count(*) - count(DISTINCT lower(stripped)) AS duplicates_removed
  FROM (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS stripped FROM feed) WHERE stripped <> ''""", "feed"))
def agg_duplicates_removed(spark: SparkSession, folder: str) -> DataFrame:
    return ds.duplicates_removed(fx.feed(spark, folder))


@query(with_views("""SELECT (SELECT count(*) FROM records) AS total,
  (SELECT count(*) FROM records WHERE label = 'phishing') AS phishing,
  (SELECT count(*) FROM records WHERE label = 'legitimate') AS legitimate,
  (SELECT count(*) FROM seen WHERE stripped <> '') - (SELECT count(*) FROM firsts) AS duplicates_removed""", "records"))
def agg_ingest_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ds.ingest_summary(fx.feed(spark, folder))


# ------------------------------------------------------------------ dedup, splits
@query(with_views("SELECT key, text, label, source, content_type FROM records", "records"))
def win_first_wins_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return fx.records(spark, folder)


def _in_batches(spark: SparkSession, folder: str) -> tuple[str, list[inc.Ingested]]:
    """The feed ingested in three batches, by source priority: 0, then 1 and 2, then 3."""
    path, rows = scratch_path(spark, "aggregate"), fx.feed(spark, folder)
    priority = F.shiftright("order", 56)
    parts = (priority == 0, priority.isin(1, 2), priority == 3)
    return path, [inc.ingest_batch(spark, path, rows.where(p), i) for i, p in enumerate(parts)]


@query(with_views("SELECT key, text, label, source, content_type FROM records", "records"))
def win_incremental_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches merged into an aggregate, each against the earlier ones: the records of the one-step union."""
    path, _ = _in_batches(spark, folder)
    return inc.aggregate(spark, path).select(F.col("order").alias("key"), "text", "label", "source", "content_type")


@query(with_views(f"""SELECT CASE priority WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS batch, sum(n)::BIGINT AS rows_seen,
  sum(first)::BIGINT AS fresh, sum(CASE WHEN first = 1 AND label = 'phishing' THEN 1 ELSE 0 END)::BIGINT AS phishing,
  sum(CASE WHEN first = 1 AND label = 'legitimate' THEN 1 ELSE 0 END)::BIGINT AS legitimate
  FROM (SELECT s.ord // 72057594037927936 AS priority, 1 AS n, CASE WHEN f.ord IS NULL THEN 0 ELSE 1 END AS first, r.label
    FROM seen s LEFT JOIN firsts f ON s.ord = f.ord LEFT JOIN records r ON s.ord = r.key WHERE s.stripped <> '')
  GROUP BY 1""", "records"))
def agg_incremental_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What each batch of the incremental ingest brought, as counted in what it wrote."""
    _, done = _in_batches(spark, folder)
    return spark.createDataFrame([(i, *d) for i, d in enumerate(done)],
                                 "batch int, rows_seen bigint, fresh bigint, phishing bigint, legitimate bigint")


@query("""SELECT min(page_id * 2 + k) AS seq, url FROM pages, range(0, 2) t(k) GROUP BY url""")
def win_url_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact-URL dedup keeping the first (every page stands twice in the feed)."""
    p = table(spark, folder, "pages").select("page_id", "url", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return ds.first_wins(p.select((F.col("page_id") * 2 + F.col("k")).alias("seq"), "url"), F.col("url"), "seq")


_SPLIT_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || key)) - 1 AS r,
    count(*) OVER (PARTITION BY label) AS n FROM {0}),
splits AS (SELECT key, label, content_type, CASE WHEN r < trunc(n * 0.7::DOUBLE) THEN 'train'
    WHEN r < trunc(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


@query(with_views(_SPLIT_SQL.format("labelled") + " SELECT key, label, split FROM splits", "labelled"))
def win_stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return ds.stratified_split(fx.labelled(spark, folder), "key").select("key", "label", "split")


@query(with_views("""outer_split AS (SELECT key, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || key))
    <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM labelled),
inner_split AS (SELECT key, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || key))
    <= ceil(count(*) OVER (PARTITION BY label) * 0.15::DOUBLE) THEN 'validation' ELSE 'train' END AS split
  FROM outer_split WHERE split = 'train')
SELECT key, label, coalesce(i.split, o.split) AS split FROM outer_split o LEFT JOIN inner_split i USING (key)""", "labelled"))
def win_holdout_split(spark: SparkSession, folder: str) -> DataFrame:
    """80/20 holdout, then 15 % of the training part for validation."""
    rows = fx.labelled(spark, folder).select("key", "label")
    outer = materialize(ds.holdout_split(rows, "key"), "holdout")
    train = outer.filter(F.col("split") == "train").drop("split")
    inner = ds.holdout_split(train, "key", fraction=0.15, name="validation")
    return inner.unionByName(outer.filter(F.col("split") == "test")).select("key", "label", "split")


@query(with_views(_SPLIT_SQL.format("records") + """ SELECT split, count(*) AS total,
  count(*) FILTER (label = 'phishing') AS phishing, count(*) FILTER (label = 'legitimate') AS legitimate,
  round(count(*) FILTER (label = 'phishing') / count(*) * 100, 1) AS phishing_pct,
  round(count(*) FILTER (label = 'legitimate') / count(*) * 100, 1) AS legitimate_pct FROM splits GROUP BY split""", "records"))
def agg_split_stats(spark: SparkSession, folder: str) -> DataFrame:
    records = materialize(fx.records(spark, folder), "records")
    return ds.split_counts(ds.stratified_split(records, "key"))


@query(with_views(_SPLIT_SQL.format("records") + """ SELECT split, coalesce(content_type, 'unknown') AS content_type,
  count(*) AS n FROM splits GROUP BY ALL""", "records"))
def agg_split_content_type(spark: SparkSession, folder: str) -> DataFrame:
    records = materialize(fx.records(spark, folder), "records")
    return ds.content_type_counts(ds.stratified_split(records, "key"))


# ------------------------------------------------------------------ heads, unions
@query(with_views("""SELECT seq, url FROM (SELECT * FROM phish_feed ORDER BY seq LIMIT 100)
  WHERE verified = 'yes' AND url <> ''""", "phish_feed"))
def top_head_then_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The head is taken before the verified filter."""
    return rd.phish_records(rd.head(fx.phish_feed(spark, folder), "seq", 100)).select("seq", "url")


@query(with_views("""SELECT 'm' || msg_id AS id, text, label, NULL AS dialogue FROM messages
  UNION ALL SELECT talk_id, NULL, label, dialogue FROM dialogues""", "messages", "dialogues"))
def set_union_all(spark: SparkSession, folder: str) -> DataFrame:
    m = fx.messages(spark, folder).select(F.concat(F.lit("m"), F.col("msg_id").cast("string")).alias("id"), "text", "label")
    d = fx.dialogue_rows(spark, folder).select(F.col("talk_id").alias("id"), "label", "dialogue")
    return ds.union_all([m, d])


# ------------------------------------------------------------------ balancing
_UNDER_SQL = """sized AS (SELECT *, count(*) FILTER (label = 'phishing') OVER () AS p,
    count(*) FILTER (label = 'legitimate') OVER () AS l,
    row_number() OVER (PARTITION BY label ORDER BY md5('42|' || key)) AS r FROM {0}),
under AS (SELECT key, label, source, content_type FROM sized WHERE CASE
    WHEN p > l * {1}::DOUBLE THEN label = 'legitimate' OR r <= trunc(l * {1}::DOUBLE)
    ELSE label = 'phishing' OR r <= trunc(p / {1}::DOUBLE) END)"""


@query(with_views(_UNDER_SQL.format("labelled", "0.5") + " SELECT key, label FROM under", "labelled"))
def smp_undersample(spark: SparkSession, folder: str) -> DataFrame:
    return ds.balance(fx.labelled(spark, folder), "key", ratio=0.5).select("key", "label")


@query(with_views("""sizes AS (SELECT count(*) FILTER (label = 'phishing') AS p, count(*) FILTER (label = 'legitimate') AS l FROM labelled),
minority AS (SELECT key, label, row_number() OVER (ORDER BY md5('42|' || key)) - 1 AS r FROM labelled WHERE label = 'phishing'),
draws AS (SELECT ('0x' || substr(md5('42#' || i), 1, 15))::BIGINT % p AS r FROM sizes, range(1, 1000000) t(i)
  WHERE i <= l - p)
SELECT key, label, count(*) AS copies FROM (
  SELECT key, label FROM labelled UNION ALL SELECT key, label FROM minority JOIN draws USING (r)) GROUP BY ALL""", "labelled"))
def smp_oversample(spark: SparkSession, folder: str) -> DataFrame:
    """Copies per row after oversampling the rare class to equal size."""
    rows = materialize(fx.labelled(spark, folder).select("key", "label"), "labelled")
    return ds.balance(rows, "key", strategy="oversample").groupBy("key", "label").agg(F.count("*").alias("copies"))


@query(with_views("SELECT key, label FROM labelled WHERE label = 'legitimate'", "labelled"))
def smp_empty_class(spark: SparkSession, folder: str) -> DataFrame:
    """With one class empty (and an unknown strategy) nothing changes."""
    rows = fx.labelled(spark, folder).filter(F.col("label") == rules.NEGATIVE)
    return ds.balance(rows, "key", strategy="other").select("key", "label")


@query(with_views(_UNDER_SQL.format("records", "1.0") + ",\n" + _SPLIT_SQL.format("under") + """
SELECT count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'val') AS val_count,
  count(*) FILTER (split = 'test') AS test_count, count(*) AS total FROM splits""", "records"))
def smp_pipeline_summary(spark: SparkSession, folder: str) -> DataFrame:
    """aggregate -> balance -> split -> write -> summary."""
    records = materialize(fx.records(spark, folder), "records")
    balanced = materialize(ds.balance(records, "key"), "balanced")
    path = scratch_path(spark, "splits")
    sk.write_splits(ds.stratified_split(balanced, "key"), path)
    written = spark.read.parquet(path).select("split")

    def n(name):
        return F.count(F.when(F.col("split") == name, 1))

    return written.agg(
        n("train").alias("train_count"), n("val").alias("val_count"), n("test").alias("test_count"),
        F.count("*").alias("total"),
    )


@query(with_views("""sizes AS (SELECT count(*) FILTER (label = 'phishing') AS p, count(*) FILTER (label = 'legitimate') AS l FROM labelled),
minority AS (SELECT key, label, content_type, row_number() OVER (ORDER BY md5('42|' || key)) - 1 AS r FROM labelled WHERE label = 'phishing'),
draws AS (SELECT ('0x' || substr(md5('42#' || i), 1, 15))::BIGINT % p AS r FROM sizes, range(1, 1000000) t(i) WHERE i <= l - p),
copies AS (SELECT key AS k, label, content_type, 0 AS copy FROM labelled UNION ALL
  SELECT key, label, content_type, row_number() OVER (PARTITION BY key) FROM minority JOIN draws USING (r)),
balanced AS (SELECT k || '#' || copy AS key, label, content_type FROM copies),
""" + _SPLIT_SQL.format("balanced") + " SELECT key, label, split FROM splits", "labelled"))
def smp_pipeline_oversample(spark: SparkSession, folder: str) -> DataFrame:
    """Oversample the rare class, split and write: exact sizes on repeated rows."""
    rows = materialize(fx.labelled(spark, folder).select("key", "label", "content_type"), "labelled")
    balanced = ds.balance(rows, "key", strategy="oversample").withColumns({"key": ds.copy_key("key")}).drop("copy")
    path = scratch_path(spark, "splits")
    sk.write_splits(ds.stratified_split(balanced, "key"), path, columns=("key", "label", "content_type"))
    return spark.read.parquet(path).select("key", "label", "split")


# ------------------------------------------------------------------ metrics
@query(with_views("""SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM scores""", "scores"))
def agg_confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return mt.confusion(fx.scores(spark, folder))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(with_views("""SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
  round(sum(label * prediction) / sum(prediction), 9) AS precision, round(sum(label * prediction) / sum(label), 9) AS recall,
  round(2 * sum(label * prediction) / (sum(label) + sum(prediction)), 9) AS f1 FROM scores""", "scores"))
def agg_binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(mt.binary_metrics(fx.scores(spark, folder)), "accuracy", "precision", "recall", "f1")


@query(with_views("""per AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS hit, count(*) FILTER (prediction = c) AS said,
    count(*) FILTER (label = c) AS support FROM scores, (VALUES (0), (1)) t(c) GROUP BY c),
r AS (SELECT c, hit / said AS p, hit / support AS r, 2 * hit / (said + support) AS f, support FROM per),
lines AS (
  SELECT CASE c WHEN 0 THEN 'Legitimate' ELSE 'Phishing' END AS name, p, r, f, support FROM r
  UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS a, count(*) AS n FROM scores)
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM r
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f * support) / sum(support), sum(support) FROM r)
SELECT name, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, support::BIGINT AS support FROM lines""", "scores"))
def agg_classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(mt.classification_report(fx.scores(spark, folder)), "precision", "recall", "f1")


@query(with_views("""ranks AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM scores)
SELECT round((sum(r) FILTER (label = 1) - n1 * (n1 + 1) / 2) / (n1 * n0), 9) AS roc_auc
FROM ranks, (SELECT sum(label)::DOUBLE AS n1, (count(*) - sum(label))::DOUBLE AS n0 FROM scores) GROUP BY n1, n0""", "scores"))
def agg_roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(mt.roc_auc(fx.scores(spark, folder)), "roc_auc")


@query(with_views("""SELECT msg_id, score >= 0.75 AS is_spam, CASE WHEN score >= 0.75 THEN 'spam' ELSE 'ham' END AS prediction,
  round(CASE WHEN score >= 0.75 THEN score ELSE 1 - score END, 9) AS confidence,
  CASE WHEN score > 0.5 THEN 'spam' ELSE 'ham' END AS raw_prediction, length(text) AS original_text_length
  FROM scores JOIN messages USING (msg_id)""", "scores"))
def det_spam_threshold(spark: SparkSession, folder: str) -> DataFrame:
    m = fx.with_scores(fx.messages(spark, folder).select("msg_id", "label", "text"))
    return sp.with_spam_result(m, "text", "score").select(
        "msg_id", "is_spam", "prediction", F.round("confidence", 9).alias("confidence"),
        F.col("details.raw_prediction").alias("raw_prediction"),
        F.col("details.original_text_length").cast("long").alias("original_text_length"),
    )


@query(with_views("""p AS (SELECT talk_id, dialogue, (('0x' || substr(md5(talk_id), 1, 8))::BIGINT % 1000)::DOUBLE / 1000 AS prob FROM dialogues)
SELECT talk_id, dialogue AS transcribed_text, prob >= 0.75 AS is_spam, round(CASE WHEN prob >= 0.75 THEN prob ELSE 1 - prob END, 9) AS confidence FROM p""", "dialogues"))
def det_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Spam decision over transcripts, keeping the transcribed text."""
    prob = fx.hash_int(F.col("talk_id")) % 1000 / 1000.0
    d = fx.dialogue_rows(spark, folder).withColumns({"prob": prob})
    return sp.with_spam_result(d, "dialogue", "prob").select(
        "talk_id", F.col("dialogue").alias("transcribed_text"), "is_spam", F.round("confidence", 9).alias("confidence")
    )
