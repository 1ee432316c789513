"""A data source for files that are one JSON array each, plain or gzipped, streamed object by object.

Spark's own reader holds a whole array in one task's memory. Here a task reads a file in chunks and hands on batches of
rows, so that its memory follows the largest object and not the file.
"""

from __future__ import annotations

import codecs
import gzip
import json
import re
from collections.abc import Iterator, Sequence
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that are read at once.
CHUNK = 1 << 20
#: Rows of a batch that goes to Spark.
BATCH = 2_000
_BLANK = re.compile(r"[ \t\r\n]*")
_AFTER = frozenset(",]} \t\r\n")


class _Decimal(float):
    """A number with a point or exponent, and how it was written."""

    def __new__(cls, text: str):
        made = super().__new__(cls, text)
        made.text = text
        return made


_DECODER = json.JSONDecoder(parse_float=_Decimal)


def objects(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[object]:
    """The elements of a JSON array (or one value that is no array), one after the other.

    Only text that has not been handed on is held. Where an element is not complete, the text grows by its own length at
    least, so that the work stays linear in the element. Anything but white space behind the array, and an array
    without an end, raise ValueError.
    """
    decode = codecs.getincrementaldecoder("utf-8-sig")().decode
    text, at, ended = "", 0, False

    def more(n: int = 1) -> bool:
        nonlocal text, at, ended
        got = []
        while n > 0 and not ended:
            data = stream.read(chunk)
            ended = not data
            got.append(decode(data, ended))
            n -= len(got[-1])
        text, at = text[at:] + "".join(got), 0
        return bool(text)

    def skip() -> str:
        """The next character that isn't blank, not taken; nothing at the end."""
        nonlocal at
        while True:
            at = _BLANK.match(text, at).end()
            if at < len(text):
                return text[at]
            if ended:
                return ""
            more()

    def value() -> object:
        nonlocal at
        while True:
            try:
                found, end = _DECODER.raw_decode(text, at)
            except ValueError:
                if ended:
                    raise
            else:
                # a number may go on behind the text that is there: 12 could be the head of 12.5
                if ended or text[end:end + 1] in _AFTER:
                    at = end
                    return found
            more(max(1, len(text) - at))

    if skip() == "":
        return
    if text[at] != "[":
        yield value()
    else:
        at += 1
        if skip() == "]":
            at += 1
        else:
            while True:
                yield value()
                mark = skip()
                if mark not in (",", "]"):
                    raise ValueError(f"JSON array: , or ] expected, found {mark or 'the end'}")
                at += 1
                if mark == "]":
                    break
                skip()
    if skip():
        raise ValueError("JSON array: text behind its end")


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, _Decimal):
        return value.text
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path as Spark lists it, and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(quote(path, safe=":/?=&@"))


def _open(path: str) -> BinaryIO:
    files, inner = locate(path)
    raw = files.open_input_stream(inner, compression=None)
    return gzip.GzipFile(fileobj=raw) if inner.endswith(".gz") else raw


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, paths: Sequence[str]) -> None:
        self.names, self.paths = schema.names, list(paths)

    def partitions(self) -> Sequence[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, fields = partition.value, self.names[:-2]
        schema = pa.schema([*[(n, pa.string()) for n in fields], (self.names[-2], pa.string()), (self.names[-1], pa.int64())])

        def batch(rows: list[list], last: int) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.string()) for c in columns], pa.array([path] * len(rows)), pa.array(range(last - len(rows), last))], schema=schema)

        rows, number = [], 0
        with _open(path) as stream:
            for found in objects(stream):
                record = found if isinstance(found, dict) else {}
                rows.append([_text(record.get(n)) for n in fields])
                number += 1
                if len(rows) == BATCH:
                    yield batch(rows, number)
                    rows = []
        if rows:
            yield batch(rows, number)


class JsonArraySource(DataSource):
    """``format("json_array")``: string fields by name, and where a row stands: its file's path and its number there."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, json.loads(self.options["paths"]))


def read_json_arrays(spark: SparkSession, path: str, fields: Sequence[str], at: tuple[str, str] = ("path", "row")) -> DataFrame:
    """The objects of all arrays under ``path`` as string ``fields``, and the columns ``at``; one task a file.

    Missing fields are NULL, other types come as their JSON text, elements that are no objects as rows of NULLs. Spark
    lists the files; the tasks open them by themselves, so they must lie in a file system that Arrow knows (local or
    mounted, HDFS, S3, GCS). A file that is no JSON array raises: what stands before the fault would be half a feed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").where("length > 0")
    names = sorted(r["path"] for r in files.collect())  # one name a file, as any scan plans them on the driver
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*fields, at[0])] + [T.StructField(at[1], T.LongType())])
    spark.dataSource.register(JsonArraySource)
    return spark.read.format("json_array").schema(schema).option("paths", json.dumps(names)).load()
