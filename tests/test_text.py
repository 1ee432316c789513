"""Hand-computed cases for text functions, features and the rule guards."""

import random
import re
import time
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.operators import features as fe
from threatloom.operators import terms as tm


def one(spark, value, column, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("Don't stop a1b", "dont stop ab"),                       # deleted, not spaced
    ("see httpfoo and www.x.y now", "see and now"),           # any word beginning http
    ("mail a@b.c 01234567890 ok", "mail ok"),
    ("@a b@ x@y", "a b"),                                     # an @ needs neighbours on both sides
    ("A B\x1cC", "a b c"),                               # Unicode and separator blanks
    ("", ""),
])
def test_clean(spark, raw, want):
    assert one(spark, raw, tx.clean(F.col("t"))) == want


def test_strip_and_words_follow_unicode_space(spark):
    assert one(spark, " \x1fab ", tx.strip(F.col("t"))) == "ab"
    assert one(spark, " a b  c ", tx.words(F.col("t"))) == ["a", "b", "c"]
    assert one(spark, "   ", F.size(tx.words(F.col("t")))) == 0


def test_fold_covers_letters_that_fold_to_ascii(spark):
    assert one(spark, "İıſKAÉ", tx.fold(F.col("t"))) == "iiskaé"


def test_boundaries_are_unicode(spark):
    urgency = rules.EXTRACTOR_FAMILIES["urgency"]
    assert one(spark, "énow now", tx.family_count(F.col("t"), urgency)) == 1


def test_overlapping_patterns_count_twice(spark):
    # "expire" is in two urgency patterns
    assert one(spark, "expire", tx.family_count(F.col("t"), rules.EXTRACTOR_FAMILIES["urgency"])) == 2


def test_email_matches_resume_after_the_previous_match(spark):
    assert one(spark, "a@b.com_x@y.org z", tx.email_count(F.col("t"))) == len(
        re.findall(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "a@b.com_x@y.org z"))


def test_long_hostile_texts_stay_linear(spark):
    big = "x" * 200_000 + " http" * 20_000 + " manager" * 20_000
    low = F.col("t")
    out = spark.createDataFrame([(big,)], "t string").select(
        tx.at_token_count(low), tx.email_count(low), F.length(tx.clean(low)),
        *[tx.rule_hit(low, r) for fam in rules.THREAT_CATEGORIES.values() for r in fam],
    ).first()
    assert out[0] == 0 and out[1] == 0


def test_entropy(spark):
    assert one(spark, "PayPal", tx.entropy(F.col("t"))) == pytest.approx(1.9182958340544893)
    assert one(spark, "", tx.entropy(F.col("t"))) == 0.0
    assert one(spark, None, tx.entropy(F.col("t"))) == 0.0


def test_empty_and_null_texts_give_zero_vectors(spark):
    df = spark.createDataFrame([("",), (None,), ("  ",)], "t string")
    for row in fe.with_combined_features(df, "t", suffixes=("com",)).select(*fe.COMBINED_FEATURES).collect():
        assert all(v == 0.0 for v in row)
    assert len(fe.COMBINED_FEATURES) == 51


def test_word_shape(spark):
    df = spark.createDataFrame([("ÉTAT ok Abc I 1A internationally",)], "t string")
    r = fe.with_text_features(df, "t").first()
    assert r["all_caps_word_count"] == 2        # ETAT and 1A, not the single I
    assert r["capitalized_word_ratio"] == pytest.approx(3 / 6)
    assert r["short_word_ratio"] == pytest.approx(4 / 6)
    assert r["long_word_ratio"] == pytest.approx(1 / 6)


@pytest.mark.parametrize("raw, want", [
    ("http://a.b c d", "url"), ("http://a.b c d e", "email"), ("HTTP://a.b", "email"),
    ("txt me", "sms"), ("txt " + "a" * 500, "email"),
])
def test_scan_type(spark, raw, want):
    assert one(spark, raw, tx.scan_type(F.col("t"), tx.fold(F.col("t")))) == want


def _every_rule():
    groups = [*rules.EXTRACTOR_FAMILIES.values(), *[f[0] for f in rules.DETECTOR_FAMILIES.values()],
              *rules.THREAT_CATEGORIES.values(), *rules.ATTACK_FAMILIES.values(), rules.SMS_RULES,
              (rules.EXPLAIN_URGENCY, rules.EXPLAIN_SPAM)]
    return [r for g in groups for r in g]


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_every_match_contains_an_anchor(data):
    for rule in _every_rule():
        if rule.anchors:
            text = data.draw(st.from_regex(rule.pattern))
            assert any(a in text for a in rule.anchors), (rule, text)


@pytest.mark.parametrize("rule", [r for f in rules.THREAT_CATEGORIES.values() for r in f if r.scan], ids=lambda r: r.pattern)
def test_scan_form_equals_pattern(spark, rule):
    bits = ["http", "@", "\n", "ethereum", "giveaway", "manager", "urgent", "amazon", "card", "tax", "form", "wire",
            "transfer", "today", "download", "here", "install", "fix", "macro", "allow", "$1,2", "$12 million", "$1 million", " "]
    import itertools

    texts = ["".join(c) for n in (1, 2, 3) for c in itertools.permutations(bits, n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.rule_hit(F.col("t"), rule)).collect()]
    assert got == [bool(re.search(rule.pattern, t)) for t in texts]


@pytest.mark.parametrize("word, stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"),
    ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
    ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"),
    ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"),
    ("today", "today"), ("pay", "pay"), ("enjoy", "enjoy"), ("dies", "die"), ("died", "die"), ("flies", "fli"), ("skies", "sky"),
    ("dying", "die"), ("news", "news"), ("generally", "gener"), ("fully", "fulli"), ("geologi", "geolog"), ("is", "is"), ("", ""),
    ("tanned", "tan"), ("hissing", "hiss"), ("fizzed", "fizz"), ("bled", "bled"), ("feed", "feed"), ("rational", "ration"),
    ("yes", "ye"), ("syzygy", "syzygi"), ("cease", "ceas"), ("probate", "probat"), ("irritant", "irrit"), ("replacement", "replac"),
])
def test_stems(spark, word, stem):
    assert tm.stem_vocabulary(spark.createDataFrame([(word,)], "word string")).first()["stem"] == stem
    assert tm.stem(word) == stem


def test_stems_of_generated_words_agree(spark):
    """The word-wise form equals the SQL steps on random words, half of them with the tables' suffixes."""
    rnd = random.Random(7)
    ends = ["", *[a for a, _ in tm.STEP2 + tm.STEP3], *tm.STEP4, "s", "ies", "ied", "eed", "ed", "ing", "e", "ll", "logi", "y", "sses"]
    words = {"".join(rnd.choices("aeiouybcdlstzwx", k=rnd.randint(0, 6))) + rnd.choice(ends) for _ in range(20000)}
    rows = tm.stem_vocabulary(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()
    assert [(r["word"], r["stem"]) for r in rows if tm.stem(r["word"]) != r["stem"]] == []


def test_stem_texts_is_row_local(spark):
    df = spark.createDataFrame([("running  cats",), ("a",)], "t string")
    plan = tm.stem_texts(df, "t", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "ArrowEvalPython" in plan
    assert [r["s"] for r in tm.stem_texts(df, "t", "s").collect()] == ["run  cat", "a"]


def test_stem_texts(spark):
    df = spark.createDataFrame([("running cats",), (None,), ("",), ("running cats",)], "t string")
    assert sorted((r[0] or "-" if r[0] is not None else "null") for r in tm.stem_texts(df, "t", "s").select("s").collect()) == ["-", "null", "run cat", "run cat"]


def test_term_counts(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "k int, terms array<string>")
    assert sorted(map(tuple, tm.term_counts(df, "k").collect())) == [(1, "a", 1), (1, "b", 2)]


def test_accents_follow_unicode(spark):
    texts = ["Příliš Łódź Ő Ş ﬁ ½ ² Ǆ ㌀", "e\u0301 한국어 각", "plain", "", None, "ﷺ x"]
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.strip_accents(F.col("t"))).collect()] == want


def test_strip_accents_of_long_texts(spark):
    text = "Crème brûlée, sans façon et très légère: ﬁn. " * 2_000
    df = spark.createDataFrame([(i, text) for i in range(40)], "i int, t string").repartition(4)
    start = time.monotonic()
    got = df.select(tx.strip_accents(F.col("t")).alias("p")).distinct().collect()
    assert [r["p"] for r in got] == ["creme brulee, sans facon et tres legere: fin. " * 2_000]
    assert time.monotonic() - start < 20  # 3.6 million characters: a minute if each is compared with every ligature


def test_character_ranges():
    chars = tx._unmarked()[2]
    codes = [int(x, 16) for x in re.findall(r"\\x\{([0-9a-f]+)\}", tx._ranges(chars))][2:]
    assert {chr(c) for a, b in zip(codes[::2], codes[1::2]) for c in range(a, b + 1)} == set(chars)


def test_corpus_statistics_are_the_counts(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (1, ["b", "a", "b"]), (None, ["é b", "a"])]
    df = spark.createDataFrame(rows, "k int, terms array<string>")
    want = sorted(map(tuple, tm.term_statistics(tm.term_counts(df, "k")).collect()))
    assert sorted(map(tuple, tm.corpus_statistics(df, "terms", 5).collect())) == want == [("a", 3, 3), ("b", 4, 2), ("é b", 1, 1)]
    assert tm.corpus_statistics(df.limit(0), "terms", 0).collect() == []


def test_corpus_statistics_tasks_grow_with_the_rows(spark):
    df = spark.createDataFrame([(["a"],)], "terms array<string>")
    plan = tm.corpus_statistics(df, "terms", 333 * tm.TASK_ROWS)._jdf.queryExecution().executedPlan().toString()
    # no table of terms before the shuffle
    assert ", 333)" in plan and "Aggregate" not in plan[plan.index("Exchange"):]


def test_terms_are_coded_in_parts():
    lists = pa.array([["a"] * 3, None, ["b"] * 9, [], ["c"], ["d"] * 2], pa.list_(pa.string()))
    parts = list(tm._parts(lists, 4))
    assert [len(p) for p in parts] == [2, 1, 3] and [len(p.flatten()) for p in parts] == [3, 9, 3]
    assert [x for p in parts for x in p.to_pylist()] == lists.to_pylist()


def test_long_texts_are_stemmed_in_parts(spark):
    texts = ["running " * 300_000, None, "cats", "running " * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = [r[0] for r in tm.stem_texts(df, "t", "s").orderBy("i").select("s").collect()]
    assert got == ["run " * 300_000, None, "cat", "run " * 300_000]


def test_clean_skips_no_part(spark):
    raw = "See WWW.x.y and HTTP://a.b/c, İ@b é  a\u2003b 12345678901 x1\n"
    assert one(spark, raw, tx.clean(F.col("t"))) == "see and a b x"
    assert one(spark, "a@b " * 3 + "wwx htp 1234567890", tx.clean(F.col("t"))) == "wwx htp"
