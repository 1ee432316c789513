"""Ingest in batches against the one-step aggregate, and the filter in between."""

import pytest
from pyspark.sql import functions as F

from threatloom.operators import dataset as ds
from threatloom.operators import incremental as inc

FEED = "text string, label string, source string, content_type string, `order` bigint"


def feed(spark, rows):
    return spark.createDataFrame([(t, label, "s", "sms", o) for t, label, o in rows], FEED)


def many(n, start=0, step=1):
    return [(f"text number {i * step}", "spam" if i % 3 else "ham", start + i) for i in range(n)]


BATCHES = [
    [("Win now", "spam", 0), ("hello", "other", 1), (" win NOW ", "ham", 2), (None, "ham", 3), ("  ", "spam", 4), *many(300, 100)],
    [("WIN NOW", "ham", 1000), ("Hello", "spam", 1001), ("new", None, 1002), ("new one", "ham", 1003), *many(300, 1100, 2)],
    [],
    [("new", "spam", 2000), ("NEW ONE", "spam", 2001), ("last", "spam", 2002), ("last", "ham", 2003), *many(300, 2100, 3)],
]


def contents(df):
    return sorted(tuple(r) for r in df.select("text", "label", "source", "content_type", "order").collect())


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("max_blocks", [inc.MAX_BLOCKS, 0])
def test_batches_equal_one_step(spark, tmp_path, strict, max_blocks):
    path = str(tmp_path / "aggregate")
    done = [inc.ingest_batch(spark, path, feed(spark, b), i, strict, max_blocks) for i, b in enumerate(BATCHES)]
    whole = feed(spark, [r for b in BATCHES for r in b])
    assert contents(inc.aggregate(spark, path)) == contents(ds.aggregate_feeds(whole, strict))
    if not strict:
        want = ds.ingest_summary(whole).first()
        assert (sum(d.phishing for d in done), sum(d.legitimate for d in done), sum(d.duplicates_removed for d in done)) == (
            want["phishing"], want["legitimate"], want["duplicates_removed"])
    assert done[2] == (0, 0, 0, 0)


def test_a_repeated_batch_changes_nothing_and_an_early_one_is_refused(spark, tmp_path):
    path = str(tmp_path / "aggregate")
    first = [inc.ingest_batch(spark, path, feed(spark, BATCHES[i]), i) for i in (0, 1)]
    before = contents(inc.aggregate(spark, path))
    assert inc.ingest_batch(spark, path, feed(spark, BATCHES[1]), 1) == first[1]
    assert contents(inc.aggregate(spark, path)) == before
    with pytest.raises(ValueError, match="already"):
        inc.ingest_batch(spark, path, feed(spark, BATCHES[0]), 0)


def test_filter_loses_no_key_and_few_others_pass(spark):
    keys = spark.range(20_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"))
    others = spark.range(20_000, 220_000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"))
    blocks = 10                                            # 16 bits a key
    bloom = inc.bloom_filter(keys, "key", blocks)
    assert bloom.count() == blocks
    assert inc.possibly_in(keys, "key", bloom, blocks).count() == 20_000
    assert inc.possibly_in(others, "key", bloom, blocks).count() < 0.01 * 200_000
    assert inc.known_keys(keys.limit(0), 0, others).count() == 0


def test_earlier_keys_meet_the_filter_before_any_shuffle_and_texts_are_not_read(spark, tmp_path):
    path = str(tmp_path / "aggregate")
    inc.ingest_batch(spark, path, feed(spark, BATCHES[0]), 0)
    keys = feed(spark, BATCHES[1]).select(F.unhex(F.md5("text")).alias("key")).distinct()
    known = inc.known_keys(keys, 300, inc.seen_before(spark, path, 1))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "text" not in plan
