"""Invariants and brute-force comparisons for data-set operators, metrics, sources and streams."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from threatloom.operators import dataset as ds
from threatloom.operators import lookups as lk
from threatloom.operators import metrics as mt
from threatloom.session import materialize, scratch_path
from threatloom.sources import readers as rd
from threatloom.streaming import jobs


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def labelled(spark, sizes, parts=8):
    rows = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "key string, label string").repartition(parts)


@pytest.mark.parametrize("n", [1, 7, 90, 170, 330])
def test_split_sizes_truncate_like_floats(spark, n):
    out = ds.stratified_split(labelled(spark, {"phishing": n, "legitimate": 10}), "key")
    got = {r["split"]: r["count"] for r in out.filter("label = 'phishing'").groupBy("split").count().collect()}
    a, b = int(n * 0.7), int(n * (0.7 + 0.15))
    assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == (a, b - a, n - b)


def test_split_equals_the_full_ranking_and_ignores_partitioning(spark):
    sizes = {"phishing": 500, "legitimate": 3000}     # one stratum holds most rows
    outs = [
        {(r["key"], r["split"]) for r in ds.stratified_split(labelled(spark, sizes, p), "key").collect()} for p in (1, 8)
    ]
    want = set()
    for c, n in sizes.items():
        order = sorted((f"{c}{i}" for i in range(n)), key=lambda k: md5(f"42|{k}"))
        for i, k in enumerate(order):
            want.add((k, "train" if i < int(n * 0.7) else "val" if i < int(n * (0.7 + 0.15)) else "test"))
    assert outs[0] == outs[1] == want


def test_split_moves_no_wide_rows(spark):
    wide = labelled(spark, {"phishing": 50, "legitimate": 50}).withColumns({"body": F.repeat(F.lit("x"), 10)})
    plan = ds.stratified_split(materialize(wide, "wide"), "key")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert "Exchange hashpartitioning" not in plan and sum("body" in s for s in scans) == 1
    assert "BroadcastHashJoin" in plan


def test_first_wins_with_a_hot_key(spark):
    rows = [(i, "Same " if i % 3 else "same", "promo" if i == 0 else "spam") for i in range(300)]
    rows += [(300 + i, f"t{i}", "ham") for i in range(50)]
    feeds = spark.createDataFrame(rows, "order long, text string, label string").withColumns(
        {"source": F.lit("s"), "content_type": F.lit("sms")}
    )
    out = ds.aggregate_feeds(feeds)
    assert out.count() == 50                       # the unknown label claimed the hot text
    assert ds.aggregate_feeds(feeds, strict=True).count() == 51
    dup = ds.duplicates_removed(feeds).first()
    assert tuple(dup) == (350, 51, 299)
    assert ds.first_wins(out, F.col("text"), "order").count() == out.count()      # idempotent


def test_conflicting_labels_keep_the_earliest(spark):
    feeds = spark.createDataFrame(
        [(5, "hi", "ham"), (2, " HI ", "spam")], "order long, text string, label string"
    ).withColumns({"source": F.lit("s"), "content_type": F.lit("sms")})
    assert [r["label"] for r in ds.aggregate_feeds(feeds).collect()] == ["phishing"]


@pytest.mark.parametrize("strategy, ratio, want", [
    ("undersample", 1.0, (40, 40)), ("undersample", 0.5, (40, 80)), ("undersample", 2.0, (40, 20)),
    ("oversample", 1.0, (100, 100)), ("oversample", 0.3, (40, 133)), ("other", 1.0, (40, 40)),
])
def test_balance_sizes(spark, strategy, ratio, want):
    out = ds.balance(labelled(spark, {"phishing": 40, "legitimate": 100}), "key", ratio, strategy)
    got = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert (got["phishing"], got["legitimate"]) == want
    originals = out.filter("copy = 0").groupBy("key").count().filter("count > 1")
    assert originals.count() == 0


def test_oversampling_draws_match_brute_force(spark):
    out = ds.balance(labelled(spark, {"phishing": 7, "legitimate": 60}), "key", strategy="oversample")
    order = sorted((f"phishing{i}" for i in range(7)), key=lambda k: md5(f"42|{k}"))
    want = {k: 1 for k in order}
    for i in range(1, 54):
        want[order[int(md5(f"42#{i}")[:15], 16) % 7]] += 1
    got = {r["key"]: r["count"] for r in out.filter("label = 'phishing'").groupBy("key").count().collect()}
    assert got == want


def test_hash_ranks_are_gap_free(spark):
    ranks = ds.hash_ranks(labelled(spark, {"a": 1000}), "key").select("rank").collect()
    assert sorted(r[0] for r in ranks) == list(range(1000))


def test_auc_against_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.2, 0.9, rng.random()])) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, score double")
    assert mt.roc_auc(df).first()[0] == pytest.approx(want)
    assert mt.roc_auc(df.filter("label = 1")).first()[0] is None
    tied = spark.createDataFrame([(i % 2, 0.5) for i in range(100)], "label int, score double")
    assert mt.roc_auc(tied).first()[0] == 0.5


def test_metrics_guard_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    assert tuple(mt.binary_metrics(df).first()) == (0.5, 0.0, 0.0, 0.0)


def test_suffix_table_equals_row_local_split(spark):
    from threatloom.functions import url as ux

    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.example.com",), ("10.0.0.1",), ("nosuffix",), ("com",), ("www.ck",), ("a.www.ck",), ("b.c.ck",), ("c.ck",), ("ck",), ("y.x.example.com",)], "host string")
    suffixes = spark.createDataFrame([("com",), ("co.uk",), ("uk",), ("*.ck",), ("!www.ck",), ("*.example.com",)], "suffix string")
    joined = {r["host"]: (r["subdomain"], r["domain"], r["suffix"]) for r in lk.split_hosts(hosts, "host", suffixes).collect()}
    known = lk.load_suffixes(suffixes)
    local = {r[0]: tuple(r[1]) for r in hosts.select("host", ux.domain_parts(F.col("host"), ux.longest_suffix(F.col("host"), known))).collect()}
    assert joined == local
    assert joined["a.www.ck"] == ("a", "www", "ck") and joined["b.c.ck"] == ("", "b", "c.ck")
    assert joined["y.x.example.com"] == ("", "y", "x.example.com") and joined["a.b.co.uk"] == ("a", "b", "co.uk")


def test_line_parsers(spark):
    lines = spark.createDataFrame([("spam\thi\tthere",), ("no tab",), ("ham\t",), (" Ham \t x ",), ("odd\ty",)], "value string")
    assert sorted(map(tuple, rd.parse_sms(lines).select("label", "text").collect())) == [("legitimate", "x"), ("smishing", "hi\tthere")]
    assert sorted(map(tuple, rd.parse_tsv(lines).select("label", "message").collect())) == [(0, " x"), (0, "y"), (1, "hi\tthere")]
    ranked = spark.createDataFrame([(i, v) for i, v in enumerate(["1,a.com", "", "x,b.com", "3", "9,c.com", "2, d.com ,z", "99999999999,e"])], "n int, value string")
    assert [(r["rank"], r["url"]) for r in rd.parse_ranked(ranked, 5, "n").collect()] == [(1, "https://a.com"), (2, "https://d.com")]
    urls = spark.createDataFrame([(" http://a ",), ("HTTP://b",), ("",)], "value string")
    assert [r["url"] for r in rd.parse_url_lines(urls).collect()] == ["http://a"]


def test_column_fallback_is_by_presence(spark):
    df = spark.createDataFrame([(None, "u", "L")], "Body string, url string, LABEL string")
    assert tuple(rd.resolve_columns(df, "body", "label").first()) == (None, "L")
    assert tuple(rd.resolve_columns(df, "text", "label").first()) == ("u", "L")


def test_validation(spark):
    df = spark.createDataFrame([("x", "auto"), ("", "auto"), (None, "auto"), ("y" * 50001, "auto"), ("x", "fax")], "t string, s string")
    assert [r[0] for r in rd.validate(df, "t", "text", "s").select("reject_reason").collect()] == [
        None, "too short", "missing", "too long", "unknown scan type"]


def test_late_rows_are_dropped_and_open_windows_held_back(spark):
    path = scratch_path(spark, "stream")
    schema = "ts timestamp, threat_level string"

    def land(rows):
        df = spark.createDataFrame(rows, "ts string, threat_level string")
        df.select(F.col("ts").cast("timestamp"), "threat_level").coalesce(1).write.mode("append").parquet(path)

    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "check")
    for rows in (
        [("2024-01-01 10:00", "LOW"), ("2024-01-01 09:00", "LOW")],       # out of order
        [("2024-01-03 12:00", "HIGH")],                                    # closes 01-01
        [("2024-01-01 11:00", "LOW"), ("2024-01-04 12:00", "NONE")],       # the first is late
    ):
        land(rows)
        counts = jobs.level_counts(jobs.stream_files(spark, path, schema), "ts", "1 hour")
        jobs.run_to_table(counts, out, checkpoint).awaitTermination()
    got = {(r["window_start"].day, r["threat_level"]): r["n"] for r in spark.read.parquet(out).collect()}
    assert got == {(1, "LOW"): 2, (3, "HIGH"): 1}


def test_open_windows_are_upserted(spark):
    path, out, checkpoint = (scratch_path(spark, n) for n in ("stream", "levels", "check"))
    for rows in ([("2024-01-01 10:00", "LOW")], [("2024-01-01 12:00", "LOW"), ("2024-01-02 12:00", "HIGH")]):
        df = spark.createDataFrame(rows, "ts string, threat_level string")
        df.select(F.col("ts").cast("timestamp"), "threat_level").coalesce(1).write.mode("append").parquet(path)
        counts = jobs.level_counts(jobs.stream_files(spark, path, "ts timestamp, threat_level string"), "ts", "1 day")
        jobs.run_upserts(counts, out, checkpoint).awaitTermination()
    got = {(r["window_start"].day, r["threat_level"]): r["n"] for r in jobs.latest(spark, out, ["window_start", "threat_level"]).collect()}
    assert got == {(1, "LOW"): 2, (2, "HIGH"): 1}


def test_hot_text_is_seen_once(spark):
    path, out, checkpoint = (scratch_path(spark, n) for n in ("stream", "seen", "check"))
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "Hot ").otherwise(F.col("id").cast("string")).alias("text"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    df.write.parquet(path)
    seen = jobs.first_seen(jobs.stream_files(spark, path, df.schema, files_per_batch=2), "text", "ts", "30 days")
    jobs.run_to_table(seen.select("text_hash"), out, checkpoint).awaitTermination()
    hashes = [r[0] for r in spark.read.parquet(out).collect()]
    assert len(hashes) == len(set(hashes)) == 2001


def test_rows_without_a_stratum_are_split_too(spark):
    df = spark.createDataFrame([(f"k{i}", "a" if i % 4 else None) for i in range(100)], "key string, label string")
    got = {(r["label"], r["split"]): r["count"] for r in ds.stratified_split(df, "key").groupBy("label", "split").count().collect()}
    assert got == {("a", "train"): 52, ("a", "val"): 11, ("a", "test"): 12, (None, "train"): 17, (None, "val"): 4, (None, "test"): 4}


def test_oversample_then_split_is_exact(spark):
    rows = ds.balance(labelled(spark, {"phishing": 37, "legitimate": 400}), "key", strategy="oversample")
    split = ds.stratified_split(rows.withColumns({"key": ds.copy_key("key")}), "key")
    got = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert got == {(c, s): n for c in ("phishing", "legitimate") for s, n in (("train", 280), ("val", 60), ("test", 60))}


def test_ingest_order_bounds(spark):
    df = spark.createDataFrame([(128, 0)], "p int, s bigint").select(ds.ingest_order(F.col("p"), F.col("s")))
    with pytest.raises(Exception, match="out of range"):
        df.collect()
