"""Near-duplicate search over SimHash fingerprints, blocked by bit segments."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import connected_components, unused
from threatloom.session import materialize

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints of a shard that are compared by shifting the whole batch; larger shards get a tree each.
SMALL_SHARD = 128
#: Fingerprints of a shard that one task compares; larger shards are compared by pairs of blocks.
BLOCK = 16_384
#: Mean shard size from which on the trees split by one more bit segment.
SHARD_ROWS = 2_048


def _fingerprint(data: bytes, words: int) -> int:
    tokens = data.lower().split()  # bytes: A-Z and the six ASCII blanks, as the contract has it
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(t) + 1 for t in tokens])
        starts = [0, *ends[: n - 1].tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1:] - 1).tolist())]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        part = np.array(hashes[at:at + 65_536], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, identity: bool = False) -> DataFrame:
    """``key, fp``: the 64-bit SimHash of each row's whole text, as a signed BIGINT; with ``identity`` also ``ROW_ID``.

    Word shingles with repeats, XXH64 with seed 42; a bit is set if it is in over half of the hashes. Fewer words than a
    shingle are one shingle; NULL, empty and blank texts get 0. Rows are independent; no row is left out.
    """
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_fingerprint(x.as_py() or b"", words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64()), *batch.columns[2:]], names=["key", "fp", *batch.schema.names[2:]])

    kind = docs.schema[key].dataType.simpleString()
    more = row_identity(docs, text) if identity else {}
    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), *[c.alias(n) for n, c in more.items()]).mapInArrow(
        compute, f"key {kind}, fp bigint" + (f", {ROW_ID}" if identity else ""))


#: What tells rows with one key apart: their text's MD5, and a hash of all columns.
ROW_ID = "digest string, whole bigint"


def row_identity(docs: DataFrame, text: str) -> dict[str, Column]:
    """The columns of ``ROW_ID``."""
    return {"digest": F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), "whole": F.xxhash64(*docs.columns)}


def survivors(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """One row of ``docs`` for each component of ``found(key, digest, whole, component)``.

    The first by key (NULL last), then by the text's MD5, then by the other columns. A component is a matter of the
    text, so key and digest name rows of one component; only rows that equal the survivor in all columns are left, and
    one of them stays. All steps are partially aggregated, and texts meet only where rows are equal.
    """
    rows = found.groupBy("component", "key", "digest", "whole").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.isnull("key").alias("none"), "key", "digest", "whole", "n")).alias("s"))
    k, d, w, n = (unused(docs.columns, x) for x in ("stay_key", "stay_digest", "stay_whole", "stay_n"))
    first = materialize(first.select(F.col("s.key").alias(k), F.col("s.digest").alias(d), F.col("s.whole").alias(w), F.col("s.n").alias(n)), "survivors")
    own = row_identity(docs, text)

    def rows_of(part: DataFrame) -> DataFrame:
        return docs.join(part, docs[key].eqNullSafe(part[k]) & (own["digest"] == part[d]) & (own["whole"] == part[w]))

    once = rows_of(first.where(F.col(n) == 1))
    repeated = rows_of(first.where(F.col(n) > 1)).dropDuplicates([k, d, w])
    return once.select(*docs.columns).union(repeated.select(*docs.columns))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the links ``a-b``, for each of ``n`` indices."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
    return label


def shard_links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one shard: every fingerprint that is linked to another gets one link to its component's root.

    The fingerprints are sorted by their Hamming distance to a vantage point, level by level: the innermost level is
    this sorted list itself. A search from a fingerprint at distance x visits only distances x - r to x + r (triangle
    bound); what it finds joins its component and is never searched for again, so copies cost one visit each.
    """
    far = np.bitwise_count(fps ^ fps[0]).astype(np.int64)
    vantage = fps[int(far.argmax())]
    dist = np.bitwise_count(fps ^ vantage).astype(np.int64)
    order = np.argsort(dist, kind="stable")
    fps, dist = fps[order], dist[order]
    lo, hi = np.searchsorted(dist, dist - max_bits, "left"), np.searchsorted(dist, dist + max_bits, "right")
    open_ = np.ones(len(fps), dtype=bool)
    root = np.arange(len(fps))
    for start in range(len(fps)):
        if not open_[start]:
            continue
        open_[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            window = slice(lo[i], hi[i])
            near = np.flatnonzero(open_[window] & (np.bitwise_count(fps[window] ^ fps[i]) <= max_bits)) + lo[i]
            if len(near):
                open_[near] = False
                root[near] = start
                stack.extend(near.tolist())
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _compare(max_bits: int):
    """Links within the shards of a partition sorted by shard; a shard may span Arrow batches."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(shard: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            sizes = np.diff(np.r_[starts, len(shard)])
            small = np.repeat(sizes <= SMALL_SHARD, sizes)
            code, at = shard[small], np.flatnonzero(small)
            left, right = [], []
            for step in range(1, int(sizes[sizes <= SMALL_SHARD].max(initial=1))):
                x, y = at[:-step], at[step:]
                ok = (code[:-step] == code[step:])
                ok[ok] = np.bitwise_count(fps[x[ok]] ^ fps[y[ok]]) <= max_bits
                left.append(x[ok])
                right.append(y[ok])
            a = np.concatenate(left) if left else np.zeros(0, dtype=np.int64)
            b = np.concatenate(right) if right else a
            label = _labels(len(fps), a, b)
            moved = np.flatnonzero(label != np.arange(len(fps)))
            us, vs = [fps[moved]], [fps[label[moved]]]
            for s, n in zip(starts[sizes > SMALL_SHARD], sizes[sizes > SMALL_SHARD]):
                u, v = shard_links(fps[s:s + n], max_bits)
                us.append(u)
                vs.append(v)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            n += batch.num_rows
            if n < 4 * BLOCK:
                continue
            shard, fps = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(shard, shard[-1], "left"))
            if cut:
                yield search(shard[:cut], fps[:cut])
            held, n = [(shard[cut:], fps[cut:])], len(shard) - cut
        if n:
            yield search(*(np.concatenate(x) for x in zip(*held)))

    return links


def deal(keyed: DataFrame, member: str, block: int) -> DataFrame:
    """``keyed(shard, member, ...)`` with each shard of over ``block`` rows replaced by one shard per pair of its blocks."""
    large = keyed.groupBy("shard").count().where(F.col("count") > block).select(
        F.col("shard").alias("big"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    large = materialize(large, "large-shards")
    if large.isEmpty():
        return keyed
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    return (
        keyed.join(large, keyed["shard"] == large["big"], "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
            F.sequence(F.lit(0), F.col("blocks") - 1))))
        .withColumn("shard", F.when(F.col("blocks").isNull(), F.col("shard")).otherwise(
            F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))))
        .select(*keyed.columns)
    )


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(u, v)``: links between fingerprints of ``distinct(fp)`` that differ in at most ``max_bits`` bits.

    Not all pairs, but enough of them that the components are exact. A forest of vantage-point trees: the 64 bits are
    cut into ``max_bits + k`` segments, and there is a tree for every k of them. Its upper levels measure Hamming
    distance on these segments only. Two fingerprints within ``max_bits`` agree on at least k segments (pigeonhole), so
    in one tree their upper distance is 0, where the triangle bound prunes every branch but one: a fingerprint belongs
    to exactly one shard of each tree, its bits there. The lower levels measure all 64 bits with radius ``max_bits``
    (``shard_links``), searching all branches that overlap a boundary. k grows with the logarithm of the number of
    fingerprints and keeps shards small: no k loses a link. A shard that is still larger than a block is compared by
    pairs of blocks.
    """
    n = distinct.count()
    k = 1
    while k < 4 and n / 2 ** (64 * k // (max_bits + k)) > SHARD_ROWS:
        k += 1
    parts = max_bits + k
    edges = [64 * i // parts for i in range(parts + 1)]
    trees = []
    for subset in itertools.combinations(range(parts), k):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in subset)
        trees.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in trees])).alias("tree", "mask"))
    keyed = keyed.select("fp", F.xxhash64("tree", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"))
    dealt = deal(keyed, "fp", BLOCK)
    return dealt.select("shard", "fp").repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _compare(max_bits), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``key, fp, component``: each row's fingerprint and the smallest key reachable by links, its own included.

    Rows with equal fingerprints are one vertex, so any number of copies costs one row in the search. NULL and empty
    texts have fingerprint 0 and link like others; a NULL key is never the smallest unless the component has no other;
    repeated rows count each; an empty table gives no rows; other columns don't matter.
    """
    prints = materialize(fingerprints(docs, key, text, words), "fingerprints")
    named = _component_keys(prints, max_bits)
    return prints.join(named, prints["fp"] == named["p"]).select("key", "fp", "component")


def _component_keys(prints: DataFrame, max_bits: int) -> DataFrame:
    """``p, root, component`` of each fingerprint: its component's smallest fingerprint and smallest key."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("key").alias("low")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(distinct.select("fp"), max_bits), "simhash")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    return materialize(rooted.join(lowest, "root").select(F.col("fp").alias("p"), "root", "component"), "simhash-components")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, the first by key (NULL last) and text (``survivors``).

    Keys need not tell documents apart: rows of different components never displace each other, whatever their keys.
    """
    prints = materialize(fingerprints(docs, key, text, words, identity=True), "fingerprints")
    named = _component_keys(prints, max_bits).select("p", "root")
    found = prints.join(named, prints["fp"] == named["p"]).select("key", "digest", "whole", F.col("root").alias("component"))
    return survivors(docs, found, key, text)
