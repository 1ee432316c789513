"""CSV with line breaks in quoted fields, read in as many tasks as the file has blocks.

A line of a file begins a record if the quotes before it in the file are even in number. Whether they are is known from
one bit a block: the parity of its quotes. The bits are summed up in block order, which gives every block the state that
it starts in, and then all blocks cut their lines into records at the same time. A record that goes over the end of a
block leaves a fragment in each block that it touches; there are at most two in a block, and these are joined at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks (one row of three numbers each) that are broadcast; more meet the lines in a shuffle.
BROADCAST_BLOCKS = 1_000_000
#: Kinds of pieces: a record that stands in one block; the end, an inner part and the start of one that does not.
WHOLE, END, INNER, START = range(4)
_PIECES = "path string, block bigint, row bigint, kind int, record string"


def quoted_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block, row, value, odd: physical lines where they stand, and whether their quotes are odd in number."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value", (quotes % 2).cast("int").alias("odd"))


def block_states(lines: DataFrame) -> DataFrame:
    """path, block, inside: whether a block starts within a quoted field. One row a block."""
    blocks = lines.groupBy("path", "block").agg(F.bit_xor("odd").alias("odd"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("path", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole blocks in file order to pieces; a record's lines are held until it ends."""
    path, block, held, state, row, open_ = None, None, [], 0, 0, False

    def piece(kind: int, number: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"path": [path], "block": [block], "row": [number], "kind": [kind], "record": ["\n".join(held)]}, schema=schema)

    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])

    def left() -> Iterator[pa.RecordBatch]:
        # what a block's end leaves: the start of a record, or an inner part if no record ended in the block
        if held or open_:
            yield piece(INNER if open_ else START, row)

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_numpy()
        files = batch.column("path").dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            here = part.column("path")[0].as_py(), part.column("block")[0].as_py()
            if here != (path, block):
                yield from left()
                (path, block), held, row = here, [], 0
                state = part.column("inside")[0].as_py()
                open_ = state == 1  # the first record began in a block before
            inside = (state + np.cumsum(part.column("odd").to_numpy())) & 1
            ends = np.flatnonzero(inside == 0)
            values = part.column("value")
            if not len(ends):
                held.extend(values.to_pylist())
                state = int(inside[-1])
                continue
            first = 0
            if held or open_:
                held.extend(values.slice(0, int(ends[0]) + 1).to_pylist())
                yield piece(END if open_ else WHOLE, row)
                row, held, open_, first = row + 1, [], False, int(ends[0]) + 1
                ends = ends[1:]
            if len(ends):
                stops = ends + 1 - first
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), values.slice(first, int(stops[-1])))
                n = len(stops)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(path, n), pa.repeat(block, n), pa.array(np.arange(row, row + n)), pa.repeat(pa.scalar(WHOLE, pa.int32()), n),
                     pc.binary_join(lists, "\n")], schema=schema)
                row, first = row + n, first + int(stops[-1])
            held = values.slice(first).to_pylist()
            state = int(inside[-1])
    yield from left()


def records(spark: SparkSession, path: str) -> DataFrame:
    """path, block, row, record: every record of the files as text, where it begins; empty lines are none.

    Quotes must be doubled within fields (RFC 4180), fields with quotes must be quoted. Compressed files are one block
    each. The files are scanned three times (states, whole records, fragments), no line shuffles unless there are more
    than ``BROADCAST_BLOCKS`` blocks.
    """
    lines = quoted_lines(spark, path)
    states = block_states(lines)
    keyed = states.select(F.col("path").alias("p"), F.col("block").alias("b"), "inside")
    same = (F.col("path") == F.col("p")) & (F.col("block") == F.col("b"))
    if states.count() <= BROADCAST_BLOCKS:
        joined = lines.join(F.broadcast(keyed), same)
    else:
        joined = lines.join(keyed, same).repartition("path", "block").sortWithinPartitions("path", "block", "row")
    pieces = joined.select("path", "block", "row", "value", "odd", "inside").mapInArrow(_cut, _PIECES)
    # a record's fragments: its start, inner blocks, its end; starts number them within a file
    parts = pieces.where(F.col("kind") != WHOLE)
    upto = Window.partitionBy("path").orderBy("block", F.col("kind") == START).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumns({"chain": F.sum((F.col("kind") == START).cast("int")).over(upto)})
    stitched = parts.groupBy("path", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "row", "record"))).alias("x"))
    first = F.col("x")[0]
    stitched = stitched.select("path", first["block"].alias("block"), first["row"].alias("row"), F.array_join("x.record", "\n").alias("record"))
    both = pieces.where(F.col("kind") == WHOLE).select("path", "block", "row", "record").union(stitched)
    return both.withColumns({"record": F.regexp_replace("record", "\r$", "")}).where("record <> ''")


def read_multiline_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, at: str | None = None) -> DataFrame:
    """Header CSV with line breaks in quoted fields; every field a string unless there is a schema.

    ``at`` names a column with the place of each record: path and block of its file, and its place in the block.
    Records with too few fields are filled with NULLs, as by Spark's own reader.
    """
    if schema is None:
        names = spark.read.option("header", True).option("escape", '"').csv(path).columns  # reads the first line only
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = records(spark, path).where(~((F.col("block") == 0) & (F.col("row") == 0)))  # headers
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    parsed = rows.select(F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("__r"),
                         F.struct("path", "block", "row").alias("__at"))
    more = [] if at is None else [F.col("__at").alias(at)]
    return parsed.select("__r.*", *more)
