"""Personal data: base spans against Python's re, labelers on planted cases, estimation on simulated votes."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from threatloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def base(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return ",".join(f"{list(PATTERNS)[i]}:{s}:{e}" for s, i, e in sorted(found)), [list(PATTERNS)[i] for _, i, _ in found]


def hostile(n=400):
    rng = random.Random(5)
    parts = ["a@b.co", "a.b_c@d.e_f@g.h.i", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (743) 555-3824", "+12", "+ 1", "--", " ", "é", "𝒳", "@", "x@y", "12345678901234567890", "0", "-", "\u0001", "5", ".", "\n", "a@-.-", "%"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_base_spans_equal_plain_search(spark, rows):
    texts = [t for _, t in rows("documents", "doc_id, text")] + hostile() + ["", None, "1 " * 30_000, "9" * 50_000, "a." * 30_000 + "@", "+1" + " " * 9_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = pii.find_personal_data(docs).select("*", pii.span_text("base").alias("b"), pii.span_text("spans").alias("a")).collect()
    assert len(got) == len(texts)
    for r in got:
        want, kinds = base(texts[r["key"]])
        assert r["b"] == want, texts[r["key"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [kinds.count(k) for k in pii.KINDS]
        assert set(filter(None, want.split(","))) <= set(r["a"].split(","))


def test_query_digest(spark, folder, rows):
    from threatloom.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op7_personal_data"](spark, folder).collect()}
    for d, t in rows("documents", "doc_id, text"):
        assert got[d]["base_sha256"] == hashlib.sha256(base(t)[0].encode()).hexdigest()


def test_method_adds_hidden_spans_and_leaves_clean_texts(spark):
    planted = ["my card 4111111111111111 4111111111111111 thanks", "call (415) 555-2671 now", "write jane.doe [at] example.com please"]
    clean = ["isbn 1234567890123456 1234567890123456", "order 0000 1111", "nothing here at all", "ratio 100-200-3000 of it"]
    ordinary = [f"mail user{i}@mail{i}.example.com or call +1 (743) 555-{3824 + i}" for i in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(planted + clean + ordinary)], "doc_id bigint, text string, base string")
    got = {r["key"]: r["a"] for r in pii.find_personal_data(docs).select("key", pii.span_text("spans").alias("a")).collect()}
    assert got[0] == "card:8:24,card:25:41"
    assert got[1] == "phone:5:19" and got[2] == "email:6:31"
    assert [got[i] for i in range(3, 7)] == [""] * 4


def test_reliabilities_of_simulated_labelers():
    rng, hit, alarm = random.Random(1), (0.95, 0.9, 0.7, 0.9), (0.05, 0.2, 0.4, 0.1)
    counts, truth = {}, {}
    for _ in range(20_000):
        yes = rng.random() < 0.4
        v = "".join("2" if rng.random() < (hit if yes else alarm)[i] else "1" for i in range(4))
        counts[v] = counts.get(v, 0) + 1
        truth[v] = truth.get(v, 0) + yes
    rows = [(0, v, n) for v, n in counts.items()]
    post = pii.estimate_reliabilities(rows)
    for v, n in counts.items():
        if n > 300:
            assert post[0, v] == pytest.approx(truth[v] / n, abs=0.08)
    weights = pii.train_classifier(rows, post)
    assert weights[0, 0, "2"] > 0 > weights[0, 0, "1"]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find_personal_data(empty).count() == 0
    twice = spark.createDataFrame([(None, "a@b.co")] * 2, "doc_id bigint, text string")
    assert [r["n_email"] for r in pii.find_personal_data(twice).collect()] == [1, 1]


def test_offsets_over_many_blocks_and_time_of_a_long_text(spark, monkeypatch):
    import time

    monkeypatch.setattr(pii, "SPAN_BLOCK", 3)
    texts = ["é a1b22c333 " * n for n in range(0, 9)] + ["7", "", None, "x"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in frame.select("text", pii.spans(F.col("text"), "[0-9]+").alias("s")).collect():
        want = None if r["text"] is None else [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", r["text"])]
        assert (None if r["s"] is None else [tuple(x) for x in r["s"]]) == want
    monkeypatch.undo()
    long = "".join(f"u{i}@mail.example.com " for i in range(40_000))
    start = time.time()
    found = spark.createDataFrame([(long,)], "text string").select(pii.spans(F.col("text"), pii.EMAIL).alias("s")).first()["s"]
    assert len(found) == 40_000 and found[-1]["e"] == len(long) - 1
    assert time.time() - start < 20
