"""Mixing and packing: targets by repeated resharing, streams by a loop, pieces by the tokenizer, bins by their limits."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest

from threatloom.llm import mixing, packing
from threatloom.llm.queries import TOKENIZER


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def reshared(sizes):
    """Targets by the contract's own words: caps, and the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def documents():
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)) if i % 11 else None, rng.choice(["a", "b", "b", "b", "c", "d", None, "é"])) for i in range(400)]
    return rows + [(900 + i, "x " * 9, "tiny") for i in range(2)] + [(1_000, "", "void"), (1_000, "", "void"), (None, "n m", "a")]


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
def test_mix_meets_reshared_targets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    docs = documents()
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(words(t))
    want = reshared(sizes)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = mixing.mix(frame).collect()
    assert len(got) == len(docs)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] < 1
    for s, t in want.items():
        assert abs(taken[s] - t) < 1 + 1e-6
    # within a source, positions follow the stream
    own = sorted((r for r in got if r["source"] == "b" and r["taken"]), key=lambda r: hashlib.md5(str(r["key"]).encode()).hexdigest())
    assert [r["position"] for r in own] == sorted(r["position"] for r in own)
    mixed = mixing.mixed_rows(frame)
    out = Counter()
    for r in mixed.collect():
        out[r["source"]] += len(words(r["text"]))
    assert out == Counter({s: n for s, n in taken.items() if n}) and mixed.columns == frame.columns


def test_mix_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string, n_chars bigint, taken int")
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty, n_chars="n_chars").columns == empty.columns
    void = spark.createDataFrame([(1, None, None), (1, "", "a")], "doc_id bigint, text string, source string")
    assert [r["taken"] for r in mixing.mix(void).collect()] == [0, 0] and mixing.mixed_rows(void).count() == 0
    cut = spark.createDataFrame([(1, "  a b\nc d ", "x", 10), (2, "e f g h", "y", 7)], "doc_id bigint, text string, source string, n_chars bigint")
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in mixing.mixed_rows(cut, n_chars="n_chars").collect())
    assert got == [(1, "  a b\n", 6), (2, "e ", 2), (2, "e f g h", 7)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


HARD = [None, "", "a", "Don't stop's 'tis", "x<|endoftext|>y <|startoftext|>", "a\x1cb \x85 c\xa0d e", "ΣΑΣ İstanbul ﬁ é ½ ²", "日本語 テスト한국어", "word,word;;word!!! (paren) \"q\" a_b-c 12,345.67", "퟿ \U0001f600‍\U0001f600"]


def pieces(tokenizer, docs, capacity):
    out = {}
    for d, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            out[d, k // capacity] = (k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    return out


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_bins(spark, tokenizer, rows, folder, monkeypatch):
    docs = rows("documents", "doc_id, text") + [(10_000 + i, t) for i, t in enumerate(HARD)] + [(20_000, " ".join(f"q{i}z" for i in range(9_000)))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for cached, ranked in ((300_000, 20_000), (50, 3)):
        monkeypatch.setattr(packing, "CACHED_WORDS", cached)
        monkeypatch.setattr(packing, "RANK_ROWS", ranked)
        got = packing.pack_documents(frame, TOKENIZER).collect()
        assert {(r["key"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces(tokenizer, docs, 4096)
        assert len(got) == len({(r["key"], r["piece"]) for r in got})
        n = check_bins(got, 4096)
        assert n <= 1.01 * sum(r["length"] for r in got) / 4096 + 1
    assert packing.pack_documents(frame.limit(0), TOKENIZER).count() == 0
    twice = packing.pack_documents(spark.createDataFrame([(None, "a b")] * 3, "doc_id bigint, text string"), TOKENIZER).collect()
    assert len(twice) == 3 and check_bins(twice, 4096) == 1


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"max_documents": 5}, {"max_attention": 3_000}, {"max_documents": 3, "max_attention": 5_000}])
def test_plan_keeps_every_constraint_and_places_every_item(score, limits):
    rng = random.Random(7)
    for _ in range(20):
        capacity = 100
        counts = Counter(min(capacity, 1 + int(rng.expovariate(1 / 18))) for _ in range(rng.randrange(1, 500)))
        counts = {k: v for k, v in counts.items() if k * k <= limits.get("max_attention", 10 ** 9)}
        placed, bins = Counter(), {}
        for length, first, n, start, per, offset in packing.plan_bins(counts, capacity, score=score, **limits):
            for j in range(n):
                placed[length, first + j] += 1
                bins.setdefault(start + j // per, []).append((offset + j % per * length, length))
        assert placed == Counter({(k, i): 1 for k, v in counts.items() for i in range(v)})
        assert sorted(bins) == list(range(len(bins)))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity and len(own) <= limits.get("max_documents", capacity)
            assert sum(k * k for _, k in own) <= limits.get("max_attention", capacity ** 2)
        if not limits and score == "norm":
            assert len(bins) <= best_fit(counts, capacity)


def best_fit(counts, capacity):
    """Bins of plain best-fit decreasing."""
    free = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, f in enumerate(free) if f >= length]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= length
            else:
                free.append(capacity - length)
    return len(free)


def test_too_long_items_are_refused():
    with pytest.raises(ValueError):
        packing.plan_bins({11: 1}, 10)
