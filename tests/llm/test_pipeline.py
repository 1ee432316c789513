"""The pipeline's stages against brute force, each on its predecessor's rows, and its contract."""

import hashlib
from collections import Counter

import pytest
from test_langid_lines_chat import clean
from test_mixing_packing import check_bins, pieces, reshared, words
from test_quality import plain
from test_shingles import survivors

import corpus_pipeline as cp
from threatloom.llm import lines, quality
from threatloom.llm.queries import TOKENIZER
from threatloom.session import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def states(spark, folder):
    out = [table(spark, folder, "documents")]
    for name, stage in cp.STAGES:
        out.append(materialize(stage(spark, out[-1], folder), name))
    return [[r.asDict() for r in s.collect()] for s in out]


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_order_of_stages():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "best_fit_packing"]


def test_quality_stage_rejects_by_base_check_and_rules(spark, folder, states):
    rules = quality.fit_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    kept = by_id(states[1])
    for d, r in by_id(states[0]).items():
        n_words, chars, symbols, dup, repeat = plain(r["text"])
        stats = dict(zip(quality.STATISTICS, quality.document_statistics(r["text"].encode())))
        x = quality.features(lambda k: float(stats[k]))
        hit = any(all(x[n] >= c if op == ">=" else x[n] < c for n, op, c in rule) for rule in rules)
        assert (d in kept) == (n_words >= 50 and 100 * repeat <= 50 * n_words and not hit)
        assert d not in kept or kept[d] == r


def test_line_stage(states):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in states[1]]
    got = by_id(states[2])
    assert {d: r["text"] for d, r in got.items()} == dict(clean(docs, lines.RATIO, lines.MIN_PAGES))
    assert all(r["n_chars"] == len(r["text"]) for r in states[2]) and len(states[2]) == len(states[1])


def test_near_dedup_stage_keeps_one_of_each_group(states):
    assert sorted(r["doc_id"] for r in states[3]) == survivors({r["doc_id"]: r["text"] for r in states[2]})
    before = by_id(states[2])
    assert all(before[r["doc_id"]] == r for r in states[3])


def test_mixing_stage_takes_target_words_and_only_cuts_ends(states):
    sizes, taken, whole = Counter(), Counter(), by_id(states[3])
    for r in states[3]:
        sizes[r["source"]] += len(words(r["text"]))
    for r in states[4]:
        taken[r["source"]] += len(words(r["text"]))
        assert whole[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"]) and list(r) == COLUMNS
    for s, t in reshared(sizes).items():
        assert abs(taken[s] - t) < 1 + 1e-6
    times = Counter(r["doc_id"] for r in states[4])
    assert max(times.values()) <= 3
    cut = Counter(r["source"] for r in states[4] if r["text"] != whole[r["doc_id"]]["text"])
    assert max(cut.values(), default=0) <= 1


def test_packing_stage(states):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, r in enumerate(states[4]):
        want.update((r["doc_id"], k[1], *v) for k, v in pieces(tokenizer, [(i, r["text"])], 4096).items())
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in states[5])
    assert check_bins(states[5], 4096) <= 1.01 * sum(r["length"] for r in states[5]) / 4096 + 1


def test_run_equals_the_stages(spark, folder, states):
    got = cp.run(spark, folder)
    assert got.columns == list(states[5][0])
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    digest = lambda rows: hashlib.sha256(repr(sorted(tuple(r[k] for k in key) for r in rows)).encode()).hexdigest()
    assert digest(got.collect()) == digest(states[5])


def test_stages_on_an_empty_table_and_odd_rows(spark, folder):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, folder), "t")
        assert docs.count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (2, long, None, "s", len(long)), (2, long, None, "s", len(long)), (None, long + " x", None, None, None)], schema)
    for _, stage in cp.STAGES:
        odd = materialize(stage(spark, odd, folder), "t")
    assert odd.count() > 0
