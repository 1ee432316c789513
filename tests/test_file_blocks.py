"""Files read by byte ranges against the same files read whole."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threatloom.operators import threats as th
from threatloom.plans import ingest
from threatloom.sources import fileblocks as fb
from threatloom.sources import readers as rd


@pytest.fixture
def folder(tmp_path):
    rnd = random.Random(3)
    (tmp_path / "sub dir").mkdir()
    big = rnd.randbytes(3_000_001)
    for name, data in {"big.exe": big, "copy.txt": big, "sub dir/text é.txt": b"abc " * 300_000, "empty.bin": b"", "one.bat": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_scan_equals_whole_file_scan(spark, folder):
    known = spark.createDataFrame([("2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881",)], "sha256 string")  # of b"x"
    columns = ["path", "file_hash", F.round("byte_entropy", 9), "risk_score", "is_malware", "scan_result"]
    whole = th.with_file_scan(rd.read_binary_files(spark, folder), known).select(*columns)
    blocks = fb.scan_files(spark, folder, known, block=1 << 20).select(*columns)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect()))
    assert {r["scan_result"] for r in blocks.collect()} == {"CLEAN", "SUSPICIOUS", "MALICIOUS"}


def test_blocks_cover_every_byte_once(spark, folder):
    files = fb.list_files(spark, folder)
    for block in (1 << 16, 1_000_000, 3_000_001, 1 << 30):
        found = {}
        for r in fb.file_blocks(files, block).collect():
            assert 0 < r["size"] <= block and r["start"] % block == 0
            found[r["path"]] = found.get(r["path"], 0) + r["size"]
        assert found == {r["path"]: r["length"] for r in files.collect() if r["length"]}


def test_one_file_is_many_tasks(spark, folder):
    blocks = fb.file_blocks(fb.list_files(spark, folder).where("path like '%big.exe'"), 100_000)
    assert blocks.count() == 31
    assert fb._dealt(blocks, "path", "start").rdd.getNumPartitions() == 31
    assert fb.byte_counts(blocks).agg(F.sum("n")).first()[0] == 3_000_001


def test_no_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"")
    files = fb.list_files(spark, str(tmp_path))
    assert fb.entropy(fb.byte_counts(fb.file_blocks(files)), "path").count() == 0
    assert fb.file_hashes(files.where("length > 0")).count() == 0


def test_shorter_than_listed(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    with pytest.raises(Exception, match="shorter than listed"):
        fb.file_hashes(fb.list_files(spark, str(tmp_path)).withColumns({"length": F.lit(9).cast("bigint")})).collect()


def test_entropy_takes_little_memory():
    data = pa.py_buffer(np.arange(32 << 20, dtype=np.uint32).astype(np.uint8))
    tracemalloc.start()
    assert th.byte_entropy(data) == 8.0 and th.byte_entropy(pa.py_buffer(b"")) == 0.0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # counted in one go, the bytes take eight times their size


def test_binary_files_are_many_small_ones(spark, monkeypatch, tmp_path):
    spark.range(50).selectExpr("id AS doc_id", "repeat('ab\\n', 9) AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    read = rd.read_binary_files
    monkeypatch.setattr(ingest.rd, "read_binary_files", lambda spark, path: seen.append(read(spark, path)) or seen[0])
    monkeypatch.setattr(ingest, "BINARY_FILE_LINES", 3)
    assert tuple(ingest.src_binary_files(spark, str(tmp_path)).first()) == (50 * 28, 50 * 10, True)
    assert seen[0].agg(F.max("length")).first()[0] <= 3 * 28
