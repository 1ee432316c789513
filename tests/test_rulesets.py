"""Rule sets from tables: guards, checks, and verdicts that follow the table."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threatloom import rules
from threatloom import rulesets as rs
from threatloom.functions import sql as fs
from threatloom.functions import text as tx
from threatloom.operators import phishing as ph

BUILT_IN = [r.pattern for f in rs.DEFAULT.families for r in f.rules] + [
    r.pattern for found in (rules.EXTRACTOR_FAMILIES, rules.THREAT_CATEGORIES) for f in found.values() for r in f]
SHAPES = ["ab?c", "colou?r", "x{2}yz", "(foo|bar)(baz|q)", r"foo\.com", "fo+bar", "[ab]cd", "win|gewinn", "(ab)|(cd)", r"ab\|cd",
          "aB{2}cd", r"\bx(y|z)*word\b", "a(b(cd)?e)fgh", "ab*cd", r"(one two|three)", "[$]+", r"\d+ euro", "lang(er|es)? text", "ab{0}cd"]


@settings(max_examples=600, deadline=None)
@given(st.data())
def test_every_match_has_a_guard(data):
    pattern = data.draw(st.sampled_from(BUILT_IN + SHAPES))
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=True)).lower()
    found = rs.guards(pattern)
    assert not found or any(g in text for g in found), (pattern, found, text)


def test_guards_of_plain_patterns_and_of_those_that_are_not_read():
    assert rs.guards(r"\b(act now|expires?)\b") == ("act now", "expire")
    for p in ("", "(a|b", "a|", "(?i)abc", r"\x41bc", r"\QAB\E", r"[\]]abc", "[[a]bc]de", "é", "(ab)?", r"(ab)\1"):
        assert rs.guards(p) == (), p


def rows(spark, *found):
    return spark.createDataFrame([("s", *f) for f in found], rs.SCHEMA)


GOOD = ("pattern", "f", r"\bword\b", 0.4, 0.8, "Words", 0)


def test_a_table_gives_back_its_rule_set(spark):
    loaded = rs.load_rule_set(rs.rule_table(spark, a=rs.DEFAULT).union(rs.rule_table(spark, a=rs.DEFAULT)), "a")
    assert [(f.name, [r.pattern for r in f.rules], *f[2:]) for f in loaded.families] == [
        (f.name, [r.pattern for r in f.rules], *f[2:]) for f in rs.DEFAULT.families]
    assert loaded[1:] == rs.DEFAULT[1:]


@pytest.mark.parametrize("bad", [
    [], [("other", "f", "x", 1.0, 1.0, "l", 0)], [("pattern", "f", None, 1.0, 1.0, "l", 0)], [("pattern", None, "x", 1.0, 1.0, "l", 0)],
    [GOOD, ("phrase", "f", "x", 0.5, 0.8, "Words", 1)], [("brand", None, "acme", None, None, None, 0)], [("pattern", "f", "x", None, 1.0, "l", 0)],
    [(None, "f", "x", 1.0, 1.0, "l", 0)],
])
def test_bad_tables_are_refused(spark, bad):
    with pytest.raises(ValueError):
        rs.load_rule_set(rows(spark, *bad), "s")


def test_too_many_rules_and_broken_patterns_are_refused(spark):
    many = spark.range(rs.MAX_RULES + 1).select(
        F.lit("s").alias("rule_set"), F.lit("phrase").alias("kind"), F.lit("f").alias("family"), F.concat(F.lit("w"), "id").alias("pattern"),
        F.lit(0.1).alias("weight"), F.lit(0.1).alias("cap"), F.lit("l").alias("label"), F.col("id").cast("int").alias("rank"))
    with pytest.raises(ValueError, match="over"):
        rs.load_rule_set(many, "s")
    with pytest.raises(Exception, match="(?i)pattern|regex"):
        rs.load_rule_set(rows(spark, ("pattern", "f", "(x", 0.1, 0.1, "l", 0)), "s")


def test_verdicts_follow_the_table(spark):
    loaded = rs.load_rule_set(rows(
        spark, GOOD, ("phrase", "f", "Big Deal", 0.4, 0.8, "Words", 1), ("pattern", "g", "Caps[0-9]", 0.1, 0.1, "Caps", 2),
        ("brand", None, "a.c+me", None, None, None, 3)), "s")
    texts = spark.createDataFrame([
        (0, "a WORD, a word and a big deal"), (1, "urgent: verify your account"), (2, "CAPS7 by a.c+me http://abcme.example.com/x"), (3, None)], "i int, t string")
    got = {r["i"]: r for r in ph.with_phishing_result(texts, "t", suffixes=["com"], rule_set=loaded).collect()}
    assert got[0]["details"]["rule_score"] == pytest.approx(0.8) and got[0]["indicators"] == ["Words (3 patterns)"]
    assert got[1]["details"]["rule_score"] == 0 and got[1]["indicators"] == []
    assert got[2]["brand_impersonation"]["brand"] == "a.c+me"              # a literal, not a pattern
    assert got[2]["indicators"] == ["Caps (1 patterns)", "Possible a.c+me impersonation detected"]
    assert got[3]["details"] is None and got[3]["threat_level"] == "NONE"


def test_sql_function_equals_the_column_function(spark):
    quoted = rs.RuleSet((rs.Family("f", (rs.compile_rule(r"\bIt's \d+\b"),), ("50% 'off'", "back\\slash"), 0.3, 0.9, "l"),))
    texts = spark.createDataFrame([("it's 5 and IT'S 77, 50% 'OFF'",), ("back\\slash",), ("\u2003 \u212aill URGENT, win a pr\u0131ze now $5\u2003",), ("",), (None,)], "t string")
    for name, rule_set in (("score_a", rs.DEFAULT), ("score_b", quoted)):
        fs.register_rule_score(spark, rule_set, name)
        want = F.when(F.col("t").isNotNull(), ph.rule_score(ph.rule_counts(tx.fold(tx.strip(F.col("t"))), rule_set), rule_set))
        got = texts.select(F.expr(f"{name}(t)").alias("got"), want.alias("want")).collect()
        assert [r["got"] for r in got] == [r["want"] for r in got]
        assert any(r["got"] for r in got) and got[-1]["got"] is None
