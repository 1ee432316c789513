"""SimHash: fingerprints and components against brute force, dense clusters, block pairs, edge cases."""

import re

import numpy as np
import pytest
import xxhash

from threatloom.llm import common, simhash


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, bits):
    """Smallest key reachable for ``values``: key to fingerprint."""
    low = {k: k for k in values}
    while True:
        new = {k: min(low[j] for j, w in values.items() if (v ^ w).bit_count() <= bits) for k, v in values.items()}
        new = {k: min(low[k], new[k]) for k in new}
        if new == low:
            return low
        low = new


def test_query(spark, folder, rows):
    from threatloom.llm.queries import QUERIES

    want = {d: fingerprint(t) for d, t in rows("documents", "doc_id, text")}
    got = {r["doc_id"]: r for r in QUERIES["op3_simhash"](spark, folder).collect()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{v:016x}" for d, v in want.items()}
    assert {d: r["component_id"] for d, r in got.items()} == components(want, 4)


def signed(v):
    return int(np.array(v, dtype=np.uint64).view(np.int64))


def cloud(n_centres, n_each, flips, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 1 << 63, n_centres):
        for _ in range(n_each):
            v = int(c)
            for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
                v ^= 1 << int(b)
            out.append(v)
    return out


@pytest.mark.parametrize("shape", [(40, 5, 6), (2, 150, 4), (1, 300, 9)])
@pytest.mark.parametrize("small, block", [(128, 16_384), (2, 16_384), (2, 8)])
def test_links_give_exact_components(spark, monkeypatch, shape, small, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL_SHARD", small)
    values = sorted({signed(v) for v in cloud(*shape)})
    table = spark.createDataFrame([(v,) for v in values], "fp bigint").coalesce(2)
    found = common.connected_components(simhash.fingerprint_links(table, 4), "t")
    got = {r["node"]: r["root"] for r in found.collect()}
    want = components({v: v & (1 << 64) - 1 for v in values}, 4)
    assert {v: got.get(v, v) for v in values} == want


def test_more_segments_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 0.0001)
    values = sorted({signed(v) for v in cloud(60, 4, 5)})
    found = common.connected_components(simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp bigint"), 4), "t")
    got = {r["node"]: r["root"] for r in found.collect()}
    assert {v: got.get(v, v) for v in values} == components({v: v & (1 << 64) - 1 for v in values}, 4)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1_000, 1_000 + i) for i in range(1, 300)] + [(5_000, 5_000)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), "t").collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1_000 + i: 1_000 for i in range(300)}}
    assert common.connected_components(spark.createDataFrame([], "u bigint, v bigint"), "t").count() == 0


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    texts = [None, "", " \n", "One two", "one TWO", "É é", long, long, long + " tail"]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)] + [(None, "one two", 0, 0)], "doc_id bigint, text string, fp int, component int")
    got = {r["key"]: (r["fp"], r["component"]) for r in simhash.near_duplicates(docs).collect()}
    assert [got[i][1] for i in range(9)] == [0, 0, 0, 3, 3, 5, 6, 6, 6] and got[None][1] == 3 and got[0][0] == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 5, 6]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_survivors_are_rows_and_not_keys(spark):
    a, b, c, d = ("".join(f"{w}{i} " for i in range(60)) for w in "abcd")
    rows = [(None, a, 1), (None, b, 1), (None, b, 1), (7, c, 1), (7, d, 1), (7, d, 2), (9, c, 1), (None, d, 0), (None, None, 1), (3, a.upper(), 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, x int")
    got = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
    assert len(got) == 5 and {r[:2] for r in got} == {(3, a.upper()), (None, b), (7, c), (7, d), (None, None)}
    assert sorted(got, key=str) == sorted((tuple(r) for r in simhash.drop_near_duplicates(docs.repartition(7)).collect()), key=str)
