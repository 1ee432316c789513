"""First-wins over a stream: the batch result whatever the order of arrival, over restarts, with hot texts and expiry."""

import random

import pytest
from pyspark.sql import functions as F

from threatloom.operators import dataset as ds
from threatloom.streaming import firstwins, jobs

SCHEMA = "text string, label string, source string, content_type string, order bigint"


def feeds(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["Hot  text", "hot  TEXT "]) if rng.random() < 0.4 else f"text {rng.randrange(n)}",
             rng.choice(["spam", "ham", "nonsense", None]), rng.choice(["s", None]), "k", i) for i in range(n)]
    rng.shuffle(rows)
    return rows


def land(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def results(spark, path, stream):
    delivered = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)
    return delivered, sorted(map(str, firstwins.aggregated(delivered).collect()))


def test_arrival_order_and_restarts_change_nothing(spark, tmp_path):
    rows = feeds(300, 1)
    landing, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    expected = lambda part: sorted(map(str, ds.aggregate_feeds(spark.createDataFrame(part, SCHEMA)).collect()))
    seen = 0
    for at in range(0, 300, 100):  # each round is a new query on the old checkpoint
        land(spark, rows[at:at + 50], landing)
        land(spark, rows[at + 50:at + 100], landing)
        stream = firstwins.aggregate_stream(jobs.stream_files(spark, landing, SCHEMA, files_per_batch=1), salts=3)
        firstwins.run(spark, stream, out, checkpoint)
        delivered, got = results(spark, out, stream)
        assert got == expected(rows[:at + 100])
        assert delivered.count() > seen
        seen = delivered.count()
    # only rows that took a text over were delivered
    assert seen < len(rows)
    hot = delivered.where(F.lower("text").startswith("hot")).count()
    assert hot <= 6


def test_ties_nulls_and_an_empty_stream(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    land(spark, [("a", "spam", "s", "k", None), (None, "spam", "s", "k", 3), ("  ", "spam", "s", "k", 4), ("b", "ham", "s", "k", 5)], landing)
    stream = firstwins.aggregate_stream(jobs.stream_files(spark, landing, SCHEMA))
    firstwins.run(spark, stream, out, checkpoint)
    assert results(spark, out, stream)[1] == ["Row(text='b', label='legitimate', source='s', content_type='k', order=5)"]
    firstwins.run(spark, stream, out, checkpoint)  # nothing new
    assert len(results(spark, out, stream)[1]) == 1


def test_orders_must_be_numbers(spark, tmp_path):
    with pytest.raises(Exception):
        firstwins.first_wins_stream(spark.createDataFrame([("a", 1)], "text string, o bigint"), F.col("text"), "missing")
