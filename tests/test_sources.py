"""Files written by the sinks and read by the readers."""

import gzip
import json
from pathlib import Path

from pyspark.sql import functions as F

from threatloom.operators import dataset as ds
from threatloom.plans import ingest
from threatloom.session import scratch_path
from threatloom.sources import readers as rd
from threatloom.sources import sinks as sk


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def write_lines(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_line_files(spark, tmp_path):
    sms = write_lines(tmp_path / "sms.txt", "spam\tWin now\nham\thi\nodd\tx\n\n")
    assert rows(rd.read_sms(spark, sms), "label", "text") == [("legitimate", "hi"), ("smishing", "Win now")]
    assert rows(rd.read_tsv(spark, sms), "label", "message") == [(0, "hi"), (0, "x"), (1, "Win now")]
    feed = write_lines(tmp_path / "feed.txt", "http://a.com/x\n http://a.com/x \nftp://b\nhttps://u@c.org:1/\n")
    out = rd.read_url_feed(spark, feed)
    assert rows(out, "url", "domain") == [("http://a.com/x", "a.com"), ("https://u@c.org:1/", "u@c.org:1")]
    assert "download_time" in out.columns
    ranked = write_lines(tmp_path / "ranked.csv", "1,a.com\nbad,b.com\n2,c.com\n3,d.com\n")
    assert rows(rd.read_ranked(spark, ranked, 2), "rank", "domain") == [(1, "a.com"), (2, "c.com")]


def test_phish_feed_head_is_taken_before_the_filter(spark, tmp_path):
    data = [{"url": f"http://x{i}", "phish_id": str(i), "verified": "yes" if i % 2 else "no"} for i in range(6)] + [{"verified": "yes"}]
    path = tmp_path / "feed.json.gz"
    path.write_bytes(gzip.compress(json.dumps(data).encode()))
    assert rows(rd.read_phish_feed(spark, str(path)), "phish_id", "online") == [("1", "no"), ("3", "no"), ("5", "no")]
    assert rows(rd.read_phish_feed(spark, str(path), 3), "phish_id") == [("1",)]


def test_csv_sinks_round_trip(spark):
    base = scratch_path(spark, "sinks")
    text = 'quote " comma, and\nline break'
    records = spark.createDataFrame(
        [(text, "phishing", "s1", "sms"), ("b", "legitimate", "s2", None)], "text string, label string, source string, content_type string")
    sk.write_aggregated(records, f"{base}/aggregated")
    assert rows(rd.read_aggregated(spark, f"{base}/aggregated", multi_line=True), "text", "label") == [("b", "legitimate"), (text, "phishing")]
    split = records.withColumns({"split": F.when(F.col("text") == "b", "test").otherwise("train")})
    sk.write_splits(split, f"{base}/splits", "csv")
    assert rows(rd.read_csv(spark, f"{base}/splits/split=train", multi_line=True), "text", "label") == [(text, "phishing")]
    sk.write_split_stats(split, f"{base}/stats")
    stats = {r["split"]: r for r in spark.read.json(f"{base}/stats/splits").collect()}
    assert stats["train"]["phishing_pct"] == 100.0
    kinds = spark.read.json(f"{base}/stats/content_types")
    assert rows(kinds, "split", "content_type") == [("test", "unknown"), ("train", "sms")]
    feeds = records.withColumns({"order": F.monotonically_increasing_id(), "source": F.lit("s")})
    sk.write_ingest_stats(records, feeds, f"{base}/ingest")
    assert spark.read.json(f"{base}/ingest/summary").first()["total"] == 2


def test_url_and_sms_sinks(spark):
    base = scratch_path(spark, "sinks")
    urls = spark.createDataFrame([("http://a.com/x",)], "url string")
    sk.write_feed(rd.feed_records(urls).withColumns({"download_time": F.lit("t")}), f"{base}/feed")
    assert rows(rd.read_csv(spark, f"{base}/feed/simple"), "text", "label") == [("http://a.com/x", "phishing")]
    ranked = rd.parse_ranked(spark.createDataFrame([(0, "1,a.com")], "n int, value string"), 5, "n")
    sk.write_ranked(ranked, f"{base}/ranked")
    assert rows(spark.read.text(f"{base}/ranked/domains"), "value") == [("a.com",)]
    sms = rd.parse_sms(spark.createDataFrame([("spam\tx",), ("ham\ty",)], "value string"))
    sk.write_sms(sms, f"{base}/sms")
    assert rows(rd.read_csv(spark, f"{base}/sms/spam_only"), "text", "label") == [("x", "smishing")]
    assert rows(rd.read_csv(spark, f"{base}/sms/ham_only"), "text", "label") == [("y", "legitimate")]


def test_feeds_keep_source_priority(spark):
    base = scratch_path(spark, "feeds")
    for name, label in (("second", "ham"), ("first", "spam")):
        spark.createDataFrame([("Same text", label)], "text string, label string").write.option("header", True).csv(f"{base}/{name}")
    feeds = rd.read_feeds(spark, [(f"{base}/second", "b", "sms", 1), (f"{base}/first", "a", "url", 0)])
    assert rows(ds.aggregate_feeds(feeds), "label", "source", "content_type") == [("phishing", "a", "url")]


def test_first_row_wins_over_files_of_any_size(spark):
    base = scratch_path(spark, "feeds")
    import pathlib

    folder = pathlib.Path(base)
    folder.mkdir(parents=True)
    filler = "".join(f"filler {i},ham\n" for i in range(40_000))
    for name, body in (("part-0.csv", "same text,spam\n"), ("part-1.csv", filler + "same text,ham\n"), ("part-2.csv", "same text,ham\nother,spam\n")):
        (folder / name).write_text("text,label\n" + body)
    feeds = rd.read_feed(spark, base, "a", "url", 0)
    assert rows(ds.aggregate_feeds(feeds).filter("text = 'same text'"), "label") == [("phishing",)]
    assert ds.ingest_summary(feeds).first()["duplicates_removed"] == 2


def test_binary_files_and_oversized(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 10)
    (tmp_path / "b.bin").write_bytes(b"y" * 100)
    assert rd.read_binary_files(spark, str(tmp_path), 50).count() == 1
    assert rows(rd.oversized_files(spark, str(tmp_path), 50), "length") == [(100,)]


def test_large_feed_files_are_written_by_many_tasks(spark, monkeypatch, tmp_path):
    spark.range(400).selectExpr("id AS doc_id", "concat('text ', id % 40) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    seen, read = [], ingest.rd.read_feeds
    monkeypatch.setattr(ingest.rd, "read_feeds", lambda spark, manifest: seen.extend(p for p, *_ in manifest) or read(spark, manifest))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        got = ingest.src_ordered_feed_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(setting)
    assert max(len(list(Path(p.removeprefix("file:")).glob("file=*/part-*"))) for p in seen) > 2
    rows = sorted((n % 4, d % 5 != 0, n, f"text {d % 40}", "phishing" if d % 7 == 0 else "legitimate")
                  for d in range(400) for n in range(3 * d, 3 * d + 3))
    first = {}
    for feed, _, _, text, label in rows:
        first.setdefault(text, (text, label, ("phishtank", "openphish", "tranco", "uci_sms")[feed]))
    assert sorted(map(tuple, got)) == sorted(first.values())
