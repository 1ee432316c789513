"""Packing of tokenised documents into sequences of bounded size."""

from __future__ import annotations

import math
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from threatloom.session import materialize

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker remembers.
CACHED_WORDS = 300_000
#: Texts whose words are numbered together.
TEXTS = 2_000
#: Pieces of one length that one task ranks, on average.
RANK_ROWS = 20_000
PIECES = "key {key}, piece int, start bigint, length bigint, ids_crc32 bigint"

#: Texts that only the tokenizer itself may split: its added tokens, and separators that Python alone takes for blanks.
_WHOLE = r"<\|startoftext\|>|<\|endoftext\|>|[\x1c-\x1f]"
#: What may follow a word's letters without changing how they are split: ASCII punctuation, contractions apart.
_TAIL = string.punctuation.replace("'", "")
_BYTES = ByteLevel(add_prefix_space=False, use_regex=False)
#: The plan of bins is broadcast up to this many rows and joined by shuffles beyond.
BROADCAST_ROWS = 100_000


class _Letters(dict):
    """Letters that never join what follows them, by code point, in the form that the vocabulary spells them.

    A letter counts if the tokenizer itself splits it from a stop, and reads it in a word as the vocabulary's letters do;
    others, for example those that normalisation takes apart into a letter and a mark, are blanks here.
    """

    def __init__(self, whole, parts) -> None:
        self.whole, self.parts = whole, parts

    def __missing__(self, code: int) -> str:
        c = chr(code)
        spelled = "".join(part for part, _ in _BYTES.pre_tokenize_str(c.lower()))
        jamo = 0x1100 <= code <= 0x11FF or 0xA960 <= code <= 0xA97F or 0xD7B0 <= code <= 0xD7FF  # these join each other
        safe = (
            c.isalpha() and not jamo and unicodedata.is_normalized("NFC", c)
            and self.whole(c + ",") == self.whole(c) + self.whole(",") and self.whole(f"a{c}a") == self.parts([f"a{spelled}a"])[0])
        self[code] = spelled if safe else " "
        return self[code]


class WordIds:
    """Little-endian 32-bit ids of texts, looked up by blank-separated word.

    The tokenizer never joins characters across white space, so a text's ids are its words' ids. A word of safe letters
    (``_Letters``) and a tail of stops is split between the two, which makes most words of a language repeat; letters
    are merged by the vocabulary alone, past normalisation and pattern. All other words go to the tokenizer whole. A
    worker keeps a bounded number of words and encodes the others each time.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.by_word = bool(self.ends.any())
        self.letters = _Letters(self.encode, self.merged)
        self.known: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def merged(self, cores: list[str]) -> list[bytes]:
        """Ids of runs of letters, spelled as in the vocabulary: one call, cut after each word's last piece."""
        ids = np.array(self.merges.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
        if len(cuts) != len(cores) + 1:
            return [np.array(self.merges.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes() for c in cores]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't known."""
        parts: list[tuple[str, str, str]] = []
        whole: list[str] = []
        for word in words:
            core = word.rstrip(_TAIL)
            if core.isalpha():
                spelled = core.lower() if core.isascii() else core.translate(self.letters)
                if " " not in spelled:
                    parts.append((word, spelled, word[len(core):]))
                    continue
            whole.append(word)
        cores = list({c for _, c, _ in parts if c not in self.plain})
        found = dict(zip(cores, self.merged(cores))) if cores else {}
        out = {}
        for word, core, tail in parts:
            if tail not in self.tails and len(self.tails) < CACHED_WORDS:
                self.tails[tail] = self.encode(tail)
            ids = found.get(core) or self.plain[core]
            out[word] = ids + (self.tails[tail] if tail in self.tails else self.encode(tail))
        for word, ids in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
            out[word] = np.array(ids.ids, dtype="<u4").tobytes()
        if len(self.plain) < CACHED_WORDS:
            self.plain.update(found)
        return out

    def looked_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        known, keep = self.known, len(self.known) < CACHED_WORDS
        new = self.learn([w for w in words if w not in known])
        known.update(new)
        out = list(map(known.__getitem__, words))
        if not keep:
            for word in new:
                del known[word]
        return out

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text. A batch's words are numbered by Arrow, only distinct ones are looked up, numpy gathers."""
        texts = texts.fill_null("")
        alone = pc.match_substring_regex(texts, _WHOLE) if self.by_word else pa.array(np.ones(len(texts), dtype=bool))
        lists = pc.utf8_split_whitespace(pc.if_else(alone, "", texts))
        numbered = lists.flatten().dictionary_encode()
        ids = self.looked_up(numbered.dictionary.to_pylist())
        flat, size = np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        word = numbered.indices.to_numpy()
        many = size[word]
        end = np.cumsum(many)
        flat = flat[np.repeat((np.cumsum(size) - size)[word] - (end - many), many) + np.arange(end[-1] if len(end) else 0)]
        at = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])].tolist()
        out = [flat[i:j].tobytes() for i, j in zip(at, at[1:])]
        for i in np.flatnonzero(alone.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.encode(texts[i].as_py())
        return out


_IDS: dict[str, WordIds] = {}


def tokenised_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                     end_id: int = END_ID) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of every piece of every document.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, each piece but the last full. The
    ids stay in the worker: packing needs lengths alone. NULL counts as an empty text, which is one piece of length 1.
    """
    end = int(end_id).to_bytes(4, "little")
    step = 4 * capacity
    kind = docs.schema[key].dataType

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _IDS.get(tokenizer) or _IDS.setdefault(tokenizer, WordIds(tokenizer))
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for first in range(0, batch.num_rows, TEXTS):
                for i, raw in enumerate(ids(batch.column(1).slice(first, TEXTS)), first):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), step)):
                        part = raw[at:at + step]
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["key", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        pieces, PIECES.format(key=kind.simpleString()))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, max_documents: int | None = None,
              max_attention: int | None = None, score: str = "norm", weights=(1.0, 1.0, 1.0)) -> list[tuple]:
    """Vector best-fit decreasing over a histogram of lengths: placements ``(length, first, n, bin, per_bin, offset)``.

    A bin has three residual capacities: tokens, documents and attention cost (the sum of squared lengths). Lengths are
    taken in falling order; the items of one length go to the class of like bins that can hold one under every
    constraint and has the least weighted norm of what would be left (``norm``), or the largest weighted dot product of
    item and residual (``dot``); a chosen bin takes as many items of the length as fit. Only if no class fits are bins
    opened. Items ``first`` to ``first + n - 1`` of a length, in any fixed order, go to bins from ``bin`` on, ``per_bin``
    to a bin, from ``offset`` on. Work and result are bounded by the number of lengths and classes, not of items.
    """
    full = np.array([capacity, max_documents or capacity, max_attention or capacity * capacity], dtype=np.int64)
    scale = np.asarray(weights, dtype=float) / full.astype(float) ** 2
    residuals = np.zeros((256, 3), dtype=np.int64)  # of the classes; a class without bins has -1
    residuals[:] = -1
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    index: dict[tuple[int, int, int], int] = {}
    free = list(range(255, -1, -1))
    out: list[tuple] = []
    bins = 0

    def put(residual, first, n):
        nonlocal residuals
        at = tuple(int(x) for x in residual)
        k = index.get(at)
        if k is None:
            if not free:
                old = len(residuals)
                residuals = np.vstack([residuals, np.full((old, 3), -1, dtype=np.int64)])
                ranges.extend([] for _ in range(old))
                free.extend(range(2 * old - 1, old - 1, -1))
            k = index[at] = free.pop()
            residuals[k] = at
        ranges[k].append((first, n))

    def fill(residual, first, n_bins, length, item, left, rank):
        """Put up to ``left`` items into the bins from ``first``; how many were placed and how many bins were touched."""
        per = int((residual // item).min())
        whole = min(n_bins, left // per)
        offset = int(capacity - residual[0])
        if whole:
            out.append((length, rank, whole * per, first, per, offset))
            put(residual - per * item, first, whole)
        placed, used = whole * per, whole
        if left - placed and used < n_bins:
            rest = left - placed
            out.append((length, rank + placed, rest, first + used, rest, offset))
            put(residual - rest * item, first + used, 1)
            placed, used = left, used + 1
        return placed, used

    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], dtype=np.int64)
        if (item > full).any():
            raise ValueError(f"an item of length {length} exceeds an empty bin")
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero((residuals >= item).all(axis=1))
            if not len(fits):
                per = int((full // item).min())
                need = -(-left // per)
                placed, _ = fill(full.copy(), bins, need, length, item, left, rank)
                bins += need
                left -= placed
                rank += placed
                continue
            after = residuals[fits]
            value = (after * item * scale).sum(axis=1) if score == "dot" else -(((after - item) ** 2) * scale).sum(axis=1)
            k = int(fits[int(value.argmax())])
            residual = residuals[k].copy()
            own, ranges[k] = ranges[k], []
            del index[tuple(int(x) for x in residual)]
            residuals[k] = -1
            free.append(k)
            for j, (first, n) in enumerate(own):
                if not left:
                    for rest in own[j:]:
                        put(residual, *rest)
                    break
                placed, used = fill(residual, first, n, length, item, left, rank)
                left -= placed
                rank += placed
                if used < n:
                    put(residual, first + used, n - used)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``key, piece, start, length, ids_crc32``: no sequence exceeds ``capacity``.

    The driver gets the histogram of lengths, at most ``capacity`` rows, and plans all bins from it (``plan_bins``), so
    the packing is the one that a single machine would find, while the pieces are only ranked within their length, in
    salted buckets, and joined to the plan. Repeated rows are packed each; an empty table gives no rows. ``pieces``
    must be a written table (it is read three times).
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    salts = max(1, math.ceil(max(counts.values(), default=0) / RANK_ROWS))
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "salt").orderBy("key", "piece", "ids_crc32", "start")
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead"))
    placements = plan_bins(counts, capacity, **options)
    plan = spark.createDataFrame(
        placements, "p_length bigint, p_first bigint, p_n bigint, p_bin bigint, p_per bigint, p_offset bigint")
    if len(placements) <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    j = F.col("rank") - F.col("p_first")
    return ranked.join(plan, (F.col("length") == F.col("p_length")) & (j >= 0) & (j < F.col("p_n"))).select(
        "key", "piece", "start", "length", "ids_crc32",
        (F.col("p_bin") + F.expr("(rank - p_first) div p_per")).alias("sequence_id"),
        (F.col("p_offset") + (j % F.col("p_per")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, **options) -> DataFrame:
    """Tokenises and packs a table: see ``tokenised_pieces`` and ``pack``. Other columns don't matter."""
    return pack(materialize(tokenised_pieces(docs, tokenizer, key, text, capacity, end_id), "pieces"), capacity, **options)
