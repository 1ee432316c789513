"""Readers that cut large files: CSV with quoted line breaks over many blocks, JSON arrays object by object."""

import csv
import gzip
import io
import json
import random
import tracemalloc

import pytest

from threatloom.sources import jsonarray, multiline
from threatloom.sources import readers as rd


def field(rng):
    parts = ["a", "é", "\n", "\n\n", '"', '""', ",", " ", "x,y", "\r\n", "\U0001f600", "long " * 30]
    return "".join(rng.choices(parts, k=rng.randrange(0, 9)))


def write_csv(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL).writerows(rows)


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("block", ["37b", "200b", "128m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_blocks_are_those_of_the_csv_module(spark, tmp_path, small_blocks, block, end):
    rng = random.Random(len(block))
    want = []
    for k in range(3):
        rows = [[f"{k}-{i}", field(rng), rng.choice(["spam", "ham"])] for i in range(40)]
        rows[7][1] = "quoted\nlines " * 60  # over many blocks
        write_csv(tmp_path / f"part{k}.csv", [["id", "Text", "label"], *rows], end)
        want += rows
    small_blocks(block)
    got = multiline.read_multiline_csv(spark, str(tmp_path), at="at").collect()
    # as in Spark's own reader, an empty field is NULL
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(str(tuple(x or None for x in r)) for r in want)
    # places follow the files
    assert [r["id"] for r in sorted(got, key=lambda r: r["at"])] == [r[0] for r in want]


def test_short_records_empty_lines_and_no_last_newline(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('text,label\n\n"one\n1",spam\n\ntwo\n,ham\n"",spam\n"last ""q""\n",ham', newline="")
    small_blocks("5b")
    got = multiline.read_multiline_csv(spark, str(tmp_path), at="at").orderBy("at").select("text", "label").collect()
    assert [tuple(r) for r in got] == [("one\n1", "spam"), ("two", None), (None, "ham"), (None, "spam"), ('last "q"\n', "ham")]
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path)).collect()
    assert sorted(map(str, plain)) == sorted(map(str, got))


def test_empty_and_header_only_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label\n")
    (tmp_path / "b.csv").write_text("")
    assert multiline.read_multiline_csv(spark, str(tmp_path)).collect() == []


def test_one_file_is_read_by_many_tasks_without_a_shuffle_of_lines(spark, tmp_path, small_blocks):
    write_csv(tmp_path / "a.csv", [["text", "label"], *[[f"{i}\nx", "spam"] for i in range(500)]])
    small_blocks("400b")
    lines = multiline.quoted_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 10
    whole = multiline.records(spark, str(tmp_path))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    upper = plan.split("Union", 1)[1]
    branch = upper.split("MapInArrow")[1]
    assert "BroadcastHashJoin" in branch and "SortMergeJoin" not in plan
    assert whole.count() == 501


def test_feeds_with_line_breaks_keep_their_order(spark, tmp_path, small_blocks):
    write_csv(tmp_path / "a.csv", [["message", "label"], ["same\ntext", "spam"], ["other", "ham"], ["Same\nText", "ham"]])
    small_blocks("9b")
    feed = rd.read_feed(spark, str(tmp_path), "s", "k", 1, text_col="message", multi_line=True)
    from threatloom.operators import dataset as ds
    got = ds.aggregate_feeds(feed).collect()
    assert sorted((r["text"], r["label"]) for r in got) == [("other", "legitimate"), ("same\ntext", "phishing")]


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 20])
def test_objects_of_an_array_by_any_chunk(chunk):
    value = [{"a": "x]},[", "b": None, "c": [1, {"d": "\\\"é"}]}, {}, 12.50, "s", True, None, -3, [], {"e": "\U0001f600" * 20}]
    for text in (json.dumps(value), json.dumps(value, indent=2, ensure_ascii=False), " [ ] ", "[]", "", "  \n", "﻿[1]"):
        got = list(jsonarray.objects(io.BytesIO(text.encode()), chunk))
        want = json.loads(text.lstrip("﻿")) if text.strip() else []
        assert got == want
    assert list(jsonarray.objects(io.BytesIO(b'{"a": 1}'), chunk)) == [{"a": 1}]
    for bad in ("[1", "[1,", "[1 2]", "[1] 2", '[{"a": }]', "[1,]"):
        with pytest.raises(ValueError):
            list(jsonarray.objects(io.BytesIO(bad.encode()), chunk))


class Repeated(io.RawIOBase):
    """An array of very many objects that is never held as a whole."""

    def __init__(self, one: bytes, n: int) -> None:
        self.one, self.left, self.rest = one, n, b"["

    def read(self, n=-1):
        while len(self.rest) < n and self.left:
            k = min(self.left, 1_000)
            self.left -= k
            self.rest += (self.one + b",") * (k - 1) + self.one + (b"," if self.left else b"]")
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def test_memory_follows_the_object_and_not_the_array():
    one = json.dumps({"url": "http://example.com/" + "x" * 500, "phish_id": 7}).encode()
    n = 120_000
    assert n * len(one) > 60e6
    tracemalloc.start()
    found = sum(1 for _ in jsonarray.objects(Repeated(one, n)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == n and peak < 16e6


def test_arrays_as_a_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    rows = [{"url": f"http://a/{i}", "verified": "yes" if i % 3 else "no", "phish_id": i, "target": 1.5 if i == 42 else None, "more": {"x": [1.50, True]}} for i in range(5_000)]
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        json.dump(rows, f)
    (tmp_path / "a b.json").write_text(json.dumps([{"url": "http://first", "verified": "yes"}, 5, {"url": ""}]))
    (tmp_path / "sub" / "c.json").write_text("[]")
    raw = jsonarray.read_json_arrays(spark, str(tmp_path), ["url", "phish_id", "target", "more"])
    got = raw.orderBy("path", "row").collect()
    assert [r["row"] for r in got] == [0, 1, 2, *range(5_000)] and raw.rdd.getNumPartitions() == 3
    assert got[1]["url"] is None and got[3 + 42].asDict() == {
        "url": "http://a/42", "phish_id": "42", "target": "1.5", "more": '{"x":[1.5,true]}', "path": got[-1]["path"], "row": 42}
    head = rd.read_phish_feed(spark, str(tmp_path), max_urls=6).select("url").collect()
    assert sorted(r["url"] for r in head) == ["http://a/1", "http://a/2", "http://first"]


def test_a_broken_array_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"url": "http://a"}, {"url": ')
    with pytest.raises(Exception, match="a.json|JSON|Expecting|Unterminated|delimiter"):
        rd.read_phish_feed(spark, str(tmp_path)).collect()
