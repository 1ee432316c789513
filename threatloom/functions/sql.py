"""Scalar functions for SQL users: temporary SQL functions with the bodies of the Column functions.

No Python runs per row: the optimizer inlines a SQL function like any expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from threatloom.functions import text as tx
from threatloom.rulesets import DEFAULT, RuleSet

_SPACE = "".join(f"\\u{ord(c):04x}" for c in tx.WHITESPACE)
#: name -> (arguments, result type, body)
FUNCTIONS = {
    "text_norm_hash": ("t STRING", "STRING", f"md5(btrim(lower(t), '{_SPACE}'))"),
    "text_word_count": ("t STRING", "INT", rf"regexp_count(t, '(?Ud)[^\\s\\x1c-\\x1f]+')"),
    "text_entropy": (
        "t STRING", "DOUBLE",
        "CASE WHEN length(t) > 0 THEN aggregate(array_distinct(split(lower(t), '')), 0D, (acc, ch) -> acc"
        " - (length(lower(t)) - length(replace(lower(t), ch, ''))) / CAST(length(t) AS DOUBLE)"
        " * log2((length(lower(t)) - length(replace(lower(t), ch, ''))) / CAST(length(t) AS DOUBLE))) ELSE 0D END",
    ),
    "url_host": (
        "u STRING", "STRING",
        r"rtrim('.', btrim(substring_index(substring_index(regexp_extract(u, '^(?:(?:[A-Za-z0-9+.-]+:)?//)?([^/?#]*)', 1), '@', -1), ':', 1)))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)


def _any(words) -> str:
    return " OR ".join(f"contains(low, {tx.quote(w)})" for w in words)


def register_rule_score(spark: SparkSession, rule_set: RuleSet = DEFAULT, name: str = "text_rule_score") -> str:
    """Create ``name(t STRING) RETURNS DOUBLE``: the score of a text by the rule set, as in the verdict's details.

    The text is stripped and folded once; patterns run behind their guards. NULL has no score.
    """
    def count(rule) -> str:
        hits = f"regexp_count(low, {tx.quote(tx.FLAGS + rule.pattern)})"
        return f"CASE WHEN {_any(rule.anchors)} THEN {hits} ELSE 0 END" if rule.anchors else hits

    def family(f) -> str:
        found = [count(r) for r in f.rules] + [f"CAST(contains(low, {tx.quote(p)}) AS INT)" for p in f.phrases]
        return f"least({f.cap}D, ({' + '.join(found)}) * {f.weight}D)"

    stripped = f"btrim(t, '{_SPACE}')"
    odd = " OR ".join(f"contains(t, {tx.quote(c)})" for c in tx.FOLDED)
    folded = f"CASE WHEN {odd} THEN lower(translate({stripped}, {tx.quote(tx.FOLDED)}, {tx.quote(tx.FOLDS)})) ELSE lower({stripped}) END"
    score = f"least({' + '.join(map(family, rule_set.families))}, 1D)"
    body = f"element_at(transform(array({folded}), low -> {score}), 1)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS DOUBLE RETURN CASE WHEN t IS NOT NULL THEN {body} END")
    return name
