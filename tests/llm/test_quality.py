"""Quality rules: statistics against a plain count, rules on planted labels, base check, edge cases."""

import re
from collections import Counter

import numpy as np

from threatloom.llm import quality

EDGES = [None, "", " \n\t", "a", "a b a b a", "a b c a b c", "x\nx\n \n \nx", "#*$%&|<> é😀", "a b c\x0b\x0cd\re", "w " * 70_000]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_plain_counts(rows):
    for text in [t for _, t in rows("documents", "doc_id, text")] + EDGES:
        assert quality.document_statistics((text or "").encode())[:5] == plain(text), text


def test_query(spark, folder, rows):
    from threatloom.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op5_quality_rules"](spark, folder).collect()}
    texts, labels = dict(rows("documents", "doc_id, text")), dict(rows("labels", "doc_id, quality"))
    assert got.keys() == texts.keys()
    for d, r in got.items():
        want = plain(texts[d])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["rule"] == 0)
    judged = [(labels[d], r["kept"]) for d, r in got.items() if d in labels and not r["base_failed"]]
    assert sum(k for q, k in judged if q == 1) >= 0.99 * sum(q == 1 for q, _ in judged)
    assert sum(not k for q, k in judged if q == 0) >= 0.9 * sum(q == 0 for q, _ in judged)


def test_covering_finds_a_planted_list():
    rng = np.random.default_rng(3)
    n = 3_000
    s = {k: rng.integers(0, 5, n) for k in quality.STATISTICS}
    s["n_words"], s["word_chars"] = rng.integers(60, 400, n), rng.integers(400, 2_000, n)
    s["n_symbols"] = np.where(rng.random(n) < 0.2, s["n_words"], 0)
    s["n_bangs"] = np.where(rng.random(n) < 0.2, s["n_words"], 0)
    bad = (s["n_symbols"] > 0) | (s["n_bangs"] > 0) & (s["n_words"] > 200)
    rules = quality.learn_rules(s, bad, rng.integers(0, 3, n))
    x = quality.features(lambda k: s[k].astype(float))
    caught = np.zeros(n, dtype=bool)
    for rule in rules:
        caught |= quality._covers(rule, x, n)
    assert 2 <= len(rules) <= quality.MAX_RULES and all(len(r) <= quality.MAX_CONDITIONS for r in rules)
    assert (caught & bad).sum() > 0.98 * bad.sum() and (caught & ~bad).sum() < 0.02 * bad.sum()
    # labels that follow nothing give no rules
    assert quality.learn_rules(s, rng.random(n) < 0.1, rng.integers(0, 3, n)) == []


def test_edges_clashing_names_and_order_of_rules(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(EDGES)] * 2, "doc_id bigint, text string, kept string")
    none = spark.createDataFrame([(None, 0), (1, None), (99, 1)], "doc_id bigint, quality int")
    assert quality.fit_rules(docs, none) == []
    assert quality.keep_good(docs, none).count() == 0
    assert quality.keep_good(docs.limit(0), none).columns == docs.columns
    good = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "k")], docs.schema)
    assert quality.keep_good(good, none).collect() == good.collect()
    rules = [[("n_words", ">=", 50.0)], [("n_words", ">=", 10.0)]]
    got = quality.with_verdict(good, rules, kept="keep_it").select("kept", "rule", "keep_it").collect()
    assert got == [("k", 1, False)]
