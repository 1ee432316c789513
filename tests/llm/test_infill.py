"""Fill-in-the-middle: forms by plain Python, exact round trips, hostile and long texts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from threatloom.llm import infill


def brute(key, text, rate=100, spm_rate=50, seed=7, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    parts = ["a", "\n", "\n\n", "é", "\U0001f600", "<", "<P", "S>", "$1", "\\", "\r\n", " ", "\x85", "x y", "\x00"]
    made = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(400)]
    return [*enumerate(made), (900, None), (901, ""), (902, "\n"), (903, "one line"), (904, "a<P>b\nc"), (905, "a\n<M>"), (906, "<S>"), (None, "no\nkey\n")]


def rows(frame, **options):
    made = infill.with_infill(frame, **options)
    return made, made.select("doc_id", "text", "infill.*", infill.restore(F.col("infill.output"), F.col("infill.form")).alias("back")).collect()


def test_forms_and_round_trip(spark):
    docs = texts()
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id bigint, text string, n int, form string")
    made, got = rows(frame)
    assert made.columns == [*frame.columns, "infill"] and len(got) == len(docs)
    for r in got:
        want = brute(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rates_and_other_units(spark):
    frame = spark.createDataFrame(texts(), "doc_id bigint, text string")
    for options in ({"rate": 30, "spm_rate": 0}, {"unit": r"(?s:.)", "seed": 11}):
        for r in rows(frame, **options)[1]:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"], **options)
            assert r["back"] == (r["text"] or "")


def test_long_texts_and_repeated_rows(spark):
    long = [(i, t) for t in ("line\n" * 300_000, "x" * 2_000_000, "\n" * 500_000, "tail\n" * 200_000 + "y" * 500_000) for i in (1, 2, 3)]
    _, got = rows(spark.createDataFrame(long + long[:2], "doc_id bigint, text string"))
    assert len(got) == len(long) + 2
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == r["text"]


def test_empty_table(spark):
    assert rows(spark.createDataFrame([], "doc_id bigint, text string"))[1] == []
