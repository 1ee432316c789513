"""Importance resampling: CRCs of n-grams against zlib, and the whole draw against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threatloom.llm import resample


def words(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features(text, lo, hi):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, lo=1, hi=1, buckets=10_000, seed=2024, percent=10):
    s, t = (Counter(zlib.crc32(f.encode()) % buckets for x in part for f in features(x, lo, hi)) for part in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for key, text in docs:
        f = features(text, lo, hi)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(drawn):
        r[4] = i + 1 if i < len(drawn) * percent // 100 else None
    return [tuple(r[:4] + [r[4] or None]) for r in out]


def sample():
    rng = random.Random(4)
    vocabulary = ["Ärger", "the", "THE", "x1", "naïve", "foo", "bar", "日本", "K", "\U0001f600", "z" * 300]
    docs = [(i, rng.choice([" ", "-", "\n", "__", " \x00"]).join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, " \n-- "), (503, "foo bar " * 40_000)]
    return docs, ["foo bar foo", "THE x1", "", None]


@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 3), (2, 4)])
def test_crcs_of_ngrams_are_those_of_their_bytes(lo, hi):
    docs, _ = sample()
    n_words, n, crcs = resample.ngram_crcs([(t or "").encode() for _, t in docs], lo, hi)
    assert n_words.tolist() == [len(words(t)) for _, t in docs]
    want = [features(t, lo, hi) for _, t in docs]
    assert n.tolist() == [len(w) for w in want]
    assert crcs.tolist() == [zlib.crc32(f.encode()) for w in want for f in w]


def test_shift_is_the_crc_of_a_longer_string():
    for a, b in ((b"", b""), (b"x", b""), (b"head", b"t"), (b"head", bytes(range(256)) * 17)):
        got = resample.shifted(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([len(b)]))
        assert int(got[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_no_texts_give_no_features():
    for texts in ([], [b""], [b"- ", b""]):
        n_words, n, crcs = resample.ngram_crcs(texts, 1, 2)
        assert n_words.tolist() == n.tolist() == [0] * len(texts) and not len(crcs)


@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 2)])
def test_draw_is_that_of_plain_python(spark, monkeypatch, lo, hi):
    monkeypatch.setattr(resample, "CHUNK", 1_000)
    docs, target = sample()
    frame = spark.createDataFrame([(k, t, -1, "r") for k, t in docs], "doc_id bigint, text string, weight int, row string").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.importance_resample(frame, goal, min_n=lo, max_n=hi).select("key", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, target, lo, hi))
    if hi == 1:
        drawn = {r["key"] for r in got if r["rank"] is not None}
        kept = resample.resampled(frame, goal)
        assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == drawn


def test_ties_and_repeated_rows_have_ranks_of_their_own(spark):
    text = "same words all over again " * 5
    docs = [(7, text)] * 60 + [(None, text)] * 50 + [(8, None)] * 5
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = resample.importance_resample(frame, frame.where("doc_id = 7"), percent=50).collect()
    assert len(got) == len(docs)
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, 56))
    best = max({r["score"] for r in got if r["key"] != 8})
    assert all(r["score"] == best for r in got if r["rank"] is not None and r["rank"] <= 50)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    one = spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    assert resample.importance_resample(none, one).collect() == []
    row = resample.importance_resample(one, none, percent=100).first()
    assert row["rank"] == 1 and row["n_features"] == 40
