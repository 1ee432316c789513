"""Embedding links and components against all pairs."""

import numpy as np
import pytest

from threatloom.llm import embeddings


def brute(vectors, cosine=0.95):
    """``key: (links, component)`` of a list of (key, vector)."""
    unit = []
    for _, v in vectors:
        fine = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, dtype=float) if fine else None
        unit.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    n = len(vectors)
    near = [[j for j in range(n) if i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    low = list(range(n))
    while True:
        new = [min([low[i], *(low[j] for j in near[i])], key=lambda k: vectors[k][0]) for i in range(n)]
        if new == low:
            return [(k, len(near[i]), vectors[low[i]][0]) for i, (k, _) in enumerate(vectors)]
        low = new


def clustered(seed, n=400, d=24, centres=12, noise=0.045):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(0, centres, n)] * rng.uniform(0.5, 4, (n, 1))
    return (x + noise * np.linalg.norm(x, axis=1, keepdims=True) * rng.normal(size=(n, d))).astype(np.float32)


@pytest.mark.parametrize("block, leaf, dims", [(2_048, 128, 8), (16, 4, 3), (7, 2, 1)])
def test_all_links_in_blocks_of_any_size(spark, monkeypatch, block, leaf, dims):
    monkeypatch.setattr(embeddings, "LEAF", leaf)
    x = clustered(block)
    vectors = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    vectors += [(1_000 + i, vectors[0][1]) for i in range(30)] + [(2_000, [2 * a for a in vectors[1][1]])]
    vectors += [(3_000, None), (3_001, []), (3_002, [0.0] * 24), (3_003, [float("nan")] * 24), (3_004, [None] + [1.0] * 23), (3_005, [float("inf")] + [1.0] * 23), (3_006, [1.0] * 5), (3_007, [1.0] * 5)]
    table = spark.createDataFrame([(k, v, 0, 0) for k, v in vectors], "vec_id bigint, embedding array<float>, kept int, u int")
    exact = [(k, None if v is None else [None if a is None else float(np.float32(a)) for a in v]) for k, v in vectors]
    got = sorted((r["key"], r["n_links"], r["component"]) for r in embeddings.near_duplicates(table, block=block, dims=dims).collect())
    assert got == brute(exact)
    assert sum(n for _, n, _ in got) > 1_000


def test_query(spark, folder, rows):
    from threatloom.llm.queries import QUERIES

    vectors = rows("embeddings", "vec_id, embedding")
    got = {r["vec_id"]: r for r in QUERIES["op4_embedding_neighbours"](spark, folder).collect()}
    for k, n, c in brute(vectors):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (n, c, k == c)


def test_empty_table_and_tiny_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embeddings.near_duplicates(empty).count() == 0
    small = spark.createDataFrame([(1, [1e-200, 1e-200]), (2, [1e200, 1e200]), (None, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = sorted((str(r["key"]), r["n_links"], r["component"]) for r in embeddings.near_duplicates(small).collect())
    assert got == [("1", 2, 1), ("2", 2, 1), ("None", 2, 1)]


def test_pairs_of_blocks_shuffle_no_vectors(spark, monkeypatch):
    plans, kept = {}, embeddings.materialize

    def recorded(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(embeddings, "materialize", recorded)
    table = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(clustered(5, n=60))], "vec_id bigint, embedding array<float>")
    embeddings.near_duplicates(table, block=8).count()
    assert "Join" not in plans["vector-links"] and "Repartition" in plans["vector-links"]


def test_links_come_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(embeddings, "HELD", 100)
    monkeypatch.setattr(embeddings, "LEAF", 8)
    a = (np.ones((64, 2)) / 2 ** 0.5, np.zeros((64, 1)))
    parts = list(embeddings._join_blocks(a, a, True, 0.3, 0.95))
    assert len(parts) > 10 and max(len(x) for x, _ in parts) < 100 + 8 * 8
    assert sorted((int(i), int(j)) for x, y in parts for i, j in zip(x, y)) == [(i, j) for i in range(64) for j in range(i + 1, 64)]
