"""Near-duplicate search over embeddings with an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.common import connected_components
from threatloom.session import materialize, scratch_path
from threatloom.sources.jsonarray import locate

COSINE = 0.95
#: Leading principal dimensions that order and bound the vectors.
DIMENSIONS = 8
#: Vectors that the principal dimensions are fitted on, at most. They decide the order alone, never a result.
FIT_ROWS = 4_000
#: Vectors of a sequence interval that is one file of the block table.
BLOCK = 8_192
#: Classes of a range partition get numbers from its number times this on; a block is named by its first.
PART = 1 << 40
#: Links of a pair of blocks that are held at once.
HELD = 1 << 20
#: Tasks that the pairs of blocks are dealt to.
MAX_TASKS = 2_000
#: Vectors of an interval below which the recursion multiplies matrices.
LEAF = 128
#: Rounding slack of distances in the projected space.
SLACK = 1e-6


def _principal(units: DataFrame, dims: int, max_rows: int) -> np.ndarray:
    """Orthonormal leading directions (d x dims) of a bounded sample of unit vectors."""
    sample = units.select("u").orderBy(F.xxhash64("u")).limit(max_rows).toPandas()["u"]
    lengths = sample.map(len)
    if not len(sample):
        return np.zeros((0, 0))
    x = np.array(sample[lengths == lengths.mode()[0]].tolist(), dtype=float)
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return v[:dims].T.copy()


_BLOCK_ROW = "block bigint, h1 array<bigint>, h2 array<bigint>, mults binary, sizes binary, e binary, lo array<double>, hi array<double>"
_BLOCK_ARROW = pa.schema([
    ("block", pa.int64()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())), ("mults", pa.binary()),
    ("sizes", pa.binary()), ("e", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])


def _name(e: str) -> list[Column]:
    """``h1, h2``: two 64-bit hashes that tell vectors apart (-0.0 and 0.0 are one number)."""
    plain = F.transform(e, lambda v: v + F.lit(0.0))
    return [F.xxhash64(plain).alias("h1"), F.xxhash64(F.size(e), plain).alias("h2")]


def _padded(e: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as the rows of a matrix, zeros behind shorter ones, and their lengths."""
    sizes = e.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = e.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=flat.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision, divided by their largest component first."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.sqrt(np.cumsum(x * x, axis=1)[:, -1:])


def _projected(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    if not len(axes):
        return np.zeros((len(u), 1))
    return np.pad(u, ((0, 0), (0, max(0, len(axes) - u.shape[1]))))[:, :len(axes)] @ axes


def _join_blocks(a: tuple, b: tuple, same: bool, eps: float, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Recursive join of two sequence intervals ``(units, projections)``: index pairs of links, in bounded parts.

    Intervals whose boxes in the projected space are over eps apart are skipped: projections never lengthen distances.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    stack = [(0, len(a[0]), 0, len(b[0]))]
    while stack:
        i, j, k, m = stack.pop()
        if same and k < i:
            continue
        pa, pb = a[1][i:j], b[1][k:m]
        gap = np.maximum(0.0, np.maximum(pa.min(axis=0) - pb.max(axis=0), pb.min(axis=0) - pa.max(axis=0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            x, y = np.nonzero(a[0][i:j] @ b[0][k:m].T >= cosine)
            x, y = x + i, y + k
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                found.append((x, y))
                held += len(x)
            if held >= HELD:
                yield tuple(np.concatenate(v) for v in zip(*found))
                found, held = [], 0
            continue
        halves_a = [(i, j)] if j - i <= LEAF else [(i, (i + j) // 2), ((i + j) // 2, j)]
        halves_b = [(k, m)] if m - k <= LEAF else [(k, (k + m) // 2), ((k + m) // 2, m)]
        stack.extend((*p, *q) for p in halves_a for q in halves_b)
    if found:
        yield tuple(np.concatenate(v) for v in zip(*found))


def _reduced(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of ``n`` indices."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
                    dims: int = DIMENSIONS, block: int = BLOCK, max_rows: int = FIT_ROWS) -> DataFrame:
    """``key, n_links, component, kept``: links by cosine >= ``cosine`` in double precision, over all rows.

    Equal vectors are one class with a multiplicity, so copies cost nothing in the search. Class representatives are
    projected to the leading principal dimensions, put in epsilon grid order (lexicographic by grid cells of edge eps,
    the distance of unit vectors at the threshold) by a range sort and cut into blocks of a sequence interval, a file
    each. Pairs of blocks meet only where their cells in the first dimension are at most one apart and their boxes at
    most eps; such a pair is joined recursively by a task that reads the two files: a vector is shuffled twice and
    written twice, however many pairs its block is in. A task holds two blocks, never a cell or a cluster; it gives link
    counts and a spanning forest, never pairs. Classes are named by two 64-bit hashes of their vector once they are made.

    NULL, empty and zero vectors and those with NULL or non-finite components link with nothing (``n_links`` 0, their
    own component, kept). Vectors of different lengths never link. A vector's own row doesn't count, equal rows do. A
    NULL key is never the smallest unless alone. An empty table gives no rows; other columns don't matter.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    given = vectors.schema[embedding].dataType
    # doubles but for floats, which are as exact and half as long
    whole = F.col(embedding) if isinstance(getattr(given, "elementType", None), T.FloatType) else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(key).alias("key"), whole.alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))
    # divided by the largest component first: squares neither overflow nor vanish
    top = F.array_max(F.transform("e", lambda v: F.abs(v))).cast("double")
    fine = F.coalesce(~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (top > 0), F.lit(False))
    rows = rows.withColumn("ok", fine)
    classes = rows.where("ok").groupBy("e").agg(F.min("key").alias("low"), F.count("*").alias("mult"))
    classes = materialize(classes.select("e", "low", "mult", *_name("e")), "vector-classes")
    scaled = classes.withColumn("e", F.transform("e", lambda v: v / top))
    axes = _principal(scaled.select(F.transform("e", lambda v: v / norm).alias("u")), dims, max_rows)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def cells(e: pa.Array) -> pa.Array:
        found = np.floor(_projected(_units(_padded(e)[0]), axes) / eps).astype(np.int64)
        return pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.int64()))

    # the order: grid cells, then the class
    placed = classes.select("h1", "h2", "mult", "e", cells("e").alias("cells"))
    order = ("cells", "h1", "h2")
    ordered = placed.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order).drop("cells")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() * PART
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == block:
                    yield pack_block(at, held)
                    at, held, n = at + n, [], 0
        if n:
            yield pack_block(at, held)

    def pack_block(at: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        g = pa.Table.from_batches(held).combine_chunks()
        e, sizes = _padded(g["e"].combine_chunks())
        p = _projected(_units(e), axes)
        return pa.RecordBatch.from_pydict({
            "block": [at], "h1": [g["h1"].to_numpy()], "h2": [g["h2"].to_numpy()], "mults": [g["mult"].to_numpy().tobytes()],
            "sizes": [sizes.tobytes()], "e": [e.tobytes()], "lo": [p.min(axis=0)], "hi": [p.max(axis=0)]}, schema=_BLOCK_ARROW)

    path = scratch_path(vectors.sparkSession, "grid-blocks")
    ordered.mapInArrow(packed, _BLOCK_ROW).write.option("maxRecordsPerFile", 1).parquet(path)
    blocks = vectors.sparkSession.read.schema(_BLOCK_ROW).parquet(path)

    cell = F.explode(F.sequence(F.floor(F.col("lo")[0] / eps), F.floor(F.col("hi")[0] / eps)))
    boxes = blocks.select("block", F.col("_metadata.file_name").alias("file"), "lo", "hi")
    left = boxes.select("block", "file", "lo", "hi", cell.alias("c")).withColumn("c", F.explode(F.array(F.col("c") - 1, "c", F.col("c") + 1)))
    right = boxes.select(*[F.col(c).alias(c + "2") for c in ("block", "file", "lo", "hi")], cell.alias("c"))
    apart = F.aggregate(
        F.zip_with(F.arrays_zip("lo", "hi"), F.arrays_zip("lo2", "hi2"), lambda a, b: F.greatest(F.lit(0.0), a["lo"] - b["hi2"], b["lo2"] - a["hi"])),
        F.lit(0.0), lambda s, v: s + v * v)
    pairs = left.join(right, "c").where((F.col("block") <= F.col("block2")) & (apart <= (eps + SLACK) ** 2))
    pairs = pairs.select("block", "block2", "file", "file2").distinct()

    wide = np.float32 if rows.schema["e"].dataType.elementType == T.FloatType() else np.float64

    def load(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        files, inner = locate(f"{path}/{name}")
        r = pq.read_table(inner, filesystem=files, columns=["mults", "sizes", "e"]).to_pylist()[0]
        mults = np.frombuffer(r["mults"], dtype=np.int64)
        u = _units(np.frombuffer(r["e"], dtype=wide).reshape(len(mults), -1))
        return u, _projected(u, axes), mults, np.frombuffer(r["sizes"], dtype=np.int64)

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, a = None, None
        for frame in frames:
            for r in frame.itertuples(index=False):
                same = r.block == r.block2
                if last != r.block:
                    last, a = r.block, load(r.file)
                b = a if same else load(r.file2)
                width = max(a[0].shape[1], b[0].shape[1])
                ua, ub = (np.pad(x[0], ((0, 0), (0, width - x[0].shape[1]))) for x in (a, b))
                na, nb = len(a[2]), len(b[2])
                links_a, links_b = np.zeros(na, dtype=np.int64), np.zeros(nb, dtype=np.int64)
                forest = (np.zeros(0, dtype=np.int64),) * 2
                for x, y in _join_blocks((ua, a[1]), (ub, b[1]), same, eps + SLACK, cosine):
                    like = a[3][x] == b[3][y]
                    x, y = x[like], y[like]
                    links_a += np.bincount(x, weights=b[2][y], minlength=na).astype(np.int64)
                    other = links_a if same else links_b
                    other += np.bincount(y, weights=a[2][x], minlength=nb).astype(np.int64)
                    u, v = np.r_[forest[0], x], np.r_[forest[1], y if same else y + na]
                    forest = _reduced(na + (0 if same else nb), u, v)
                counts = links_a if same else np.r_[links_a, links_b]
                names = r.block + np.arange(na) if same else np.r_[r.block + np.arange(na), r.block2 + np.arange(nb)]
                peer = np.arange(len(names))
                peer[forest[0]] = forest[1]
                hit = np.flatnonzero(counts)
                if len(hit):
                    yield pd.DataFrame({"class": names[hit], "links": counts[hit], "peer": names[peer[hit]]})

    pairs = materialize(pairs, "block-pairs")
    jobs = pairs.repartition(max(1, min(pairs.count(), MAX_TASKS)), "block", "block2").sortWithinPartitions("block")
    links = materialize(jobs.mapInPandas(join, "class bigint, links bigint, peer bigint"), "vector-links")

    roots = connected_components(links.select(F.col("class").alias("u"), F.col("peer").alias("v")), "vectors")
    sums = links.groupBy("class").agg(F.sum("links").alias("links"))
    named = blocks.select("block", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h")).select(
        (F.col("block") + F.col("i")).alias("class"), "h.h1", "h.h2")
    named = named.join(roots, F.col("class") == F.col("node"), "left").join(sums, "class", "left")
    rooted = classes.select("h1", "h2", "low", "mult").join(named, ["h1", "h2"]).select(
        "h1", "h2", "low", F.coalesce("root", "class").alias("root"), (F.coalesce(F.col("links"), F.lit(0)) + F.col("mult") - 1).alias("n"))
    rooted = materialize(rooted, "rooted-vectors")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    found = rooted.join(lowest, "root").select("h1", "h2", "n", "component")
    own = [F.when(F.col("ok"), h).alias(h_name) for h, h_name in zip(_name("e"), ("h1", "h2"))]
    return (
        rows.select("key", *own).join(found, ["h1", "h2"], "left")
        .select("key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "key").alias("component"))
        .withColumn("kept", F.col("key").eqNullSafe(F.col("component")))
    )
