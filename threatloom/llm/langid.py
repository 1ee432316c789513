"""Language identification by prediction by partial matching."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.common import unused

#: Documents of one language that the model is fitted on, at most: the first in the order of a hash of their ids.
FIT_ROWS = 600
#: Longest context in bytes.
ORDER = 3
#: Contexts of full length with fewer symbols in the sample, over all languages, are left to their shorter context.
MIN_CONTEXT = 4
#: Bytes that are scored at once.
CHUNK = 1 << 17

UNKNOWN = "und"
#: ASCII letters and all bytes of other characters are symbols, anything else separates words.
_TO_SPACE = bytes(i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))


def normalise(data: bytes) -> bytes:
    """Lower-case UTF-8 words with one space before each; empty if the text has no letter."""
    text = data.decode("utf-8", "replace")
    if not any(map(str.isalpha, text)):
        return b""
    return b" " * ORDER + b" ".join(text.lower().encode().translate(_TO_SPACE).split())


def window_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, code, n``: how often each ``ORDER + 1`` bytes (big-endian code) occur in a language's documents."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name, rows in frame.groupby("lang"):
                codes = [np.zeros(0, dtype=np.int64)]
                for data in rows["text"]:
                    s = np.frombuffer(normalise(data), dtype=np.uint8).astype(np.int64)
                    if len(s) > ORDER:
                        codes.append(sum(s[i:len(s) - ORDER + i] << 8 * (ORDER - i) for i in range(ORDER + 1)))
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pd.DataFrame({"lang": name, "code": code, "n": n})

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    return rows.mapInPandas(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen byte context trees of all languages as one table of code lengths in bits.

    Row ``r`` of the table is a context: first those of full length that the sample has, then all of one byte less. The
    code length of a symbol follows PPM with escape method C: its count over count + kinds of symbols in the longest
    known context, or else the escape, kinds over the same, and the code length in the next shorter context; at the end
    stands a uniform symbol. As the counts are frozen, a text's code length is a sum over its windows.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> None:
        self.langs = langs
        symbols = np.unique(np.concatenate([code >> 8 * i & 255 for i in range(ORDER + 1)]))
        a = self.size = len(symbols) + 1  # symbol 0 stands for all bytes that the sample lacks
        self.table = bytearray(256)
        for i, s in enumerate(symbols.tolist(), 1):
            self.table[s] = i
        self.table = bytes(self.table)
        index = np.frombuffer(self.table, dtype=np.uint8).astype(np.int64)
        window = sum(index[code >> 8 * (ORDER - i) & 255] * a ** (ORDER - i) for i in range(ORDER + 1))
        context, k = window // a, len(langs)
        totals = np.bincount(context, weights=n, minlength=a ** ORDER)
        kept = np.flatnonzero(totals >= MIN_CONTEXT)
        short = a ** (ORDER - 1)
        self.row = (len(kept) + np.arange(a ** ORDER) % short).astype(np.int32)
        self.row[kept] = np.arange(len(kept))
        self.cost = np.empty(((len(kept) + short) * a, k), dtype=np.float32)
        for j in range(k):
            own = lang == j
            w, m = window[own], n[own].astype(float)
            cost = np.full((1, a), np.log2(a))
            for order in range(ORDER):
                counts = np.bincount(w % a ** (order + 1), weights=m, minlength=a ** (order + 1)).reshape(-1, a)
                cost = self._step(counts, np.tile(cost, (len(counts) // len(cost), 1)))
            self.cost[len(kept) * a:, j] = cost.ravel()
            rank = np.full(a ** ORDER, -1)
            rank[kept] = np.arange(len(kept))
            at = rank[w // a]
            counts = np.bincount((at * a + w % a)[at >= 0], weights=m[at >= 0], minlength=len(kept) * a).reshape(-1, a)
            self.cost[:len(kept) * a, j] = self._step(counts, cost[kept % short]).ravel()

    @staticmethod
    def _step(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        kinds = (counts > 0).sum(axis=1, keepdims=True)
        total = counts.sum(axis=1, keepdims=True) + kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, -np.log2(kinds / total), 0.0)
            return np.where(counts > 0, -np.log2(counts / total), escape + shorter)

    def lengths(self, data: bytes) -> np.ndarray:
        """Bits that each language's tree needs for a normalised text."""
        s = np.frombuffer(data.translate(self.table), dtype=np.uint8)
        bits, a = np.zeros(len(self.langs)), self.size
        for at in range(0, len(s) - ORDER, CHUNK):
            part = s[at:at + CHUNK + ORDER].astype(np.int32)
            context = part[:-ORDER]
            for i in range(1, ORDER):
                context = context * a + part[i:i - ORDER]
            found = self.cost[self.row[context] * a + part[ORDER:]]
            bits += np.ones(len(found), dtype=np.float32) @ found
        return bits

    def predict(self, data: bytes | None) -> tuple[str, float]:
        plain = normalise(data) if data else b""
        if not plain:
            return UNKNOWN, 0.0
        bits = self.lengths(plain)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


_TREES: dict[str, ContextTrees] = {}


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = FIT_ROWS) -> tuple:
    """``(langs, lang, code, n)``: window counts from at most ``max_rows`` documents of each language.

    NULL texts, languages and keys are never learned from. The languages' first documents in the order of a hash of the
    key are chosen from keys alone; the counts of this bounded sample are what the driver gets.
    """
    slim = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l")).where("k is not null and l is not null")
    first = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    chosen = slim.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max_rows).select("k", "l").distinct()
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).join(
        F.broadcast(chosen.withColumnsRenamed({"k": "k2", "l": "l2"})), (F.col("k") == F.col("k2")) & (F.col("l") == F.col("l2")))
    found = window_counts(sample, "t", "l").toPandas().sort_values(["lang", "code"])
    langs = sorted(set(found["lang"]))
    return langs, found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), found["code"].to_numpy(), found["n"].to_numpy()


def with_language(docs: DataFrame, model: tuple, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language of the shortest code, and its posterior under equal priors (0 to 1).

    Whole texts are scored, in chunks. ``und`` and 0 for NULL, for texts without a letter, and for all if nothing was
    learned; ties go to the smaller name. Other columns stay; repeated rows are scored each; the names of the new
    columns are arguments. A worker builds the table of code lengths once.
    """
    langs, lang, code, n = model
    mark = hashlib.sha256(repr(langs).encode() + lang.tobytes() + code.tobytes() + n.tobytes()).hexdigest()

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not langs:
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0})
        if mark not in _TREES:
            _TREES.clear()
            _TREES[mark] = ContextTrees(langs, lang, code, n)
        trees = _TREES[mark]
        return pd.DataFrame([trees.predict(x) for x in texts], columns=["lang", "score"])

    found = unused(docs.columns, "language")
    return (
        docs.withColumn(found, predict.asNondeterministic()(F.col(text).cast("binary")))
        .withColumn(into[0], F.col(f"{found}.lang")).withColumn(into[1], F.col(f"{found}.score")).drop(found)
    )
