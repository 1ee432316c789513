"""Detector rules as data: rows of a table become the staged expressions that score a text.

A rule table has the columns ``rule_set, kind, family, pattern, weight, cap, label, rank``. Kinds:

* ``pattern``: a regular expression; every match counts for its family,
* ``phrase``: a literal; its presence counts for its family once,
* ``brand``, ``tld``, ``shortener``, ``url_keyword``: literals of the URL and brand checks (no family, weight or cap).

A family adds ``min(cap, count * weight)`` to the rule score and ``label`` to the indicators; families and literals go by
``rank``. Rules are compiled into the plan: texts meet them row by row, without a join or a shuffle.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import text as tx

#: Rows of one rule set at most: each becomes an expression of the plan.
MAX_RULES = 500
LISTS = {"brand": "brands", "tld": "tlds", "shortener": "shorteners", "url_keyword": "url_keywords"}
SCHEMA = "rule_set string, kind string, family string, pattern string, weight double, cap double, label string, rank int"
#: Characters a guard has at least; shorter literals are in most texts.
GUARD_CHARS = 2


class Family(NamedTuple):
    name: str
    rules: tuple[rules.Rule, ...]
    phrases: tuple[str, ...]
    weight: float
    cap: float
    label: str


class RuleSet(NamedTuple):
    families: tuple[Family, ...]
    brands: tuple[str, ...] = ()
    tlds: tuple[str, ...] = ()
    shorteners: tuple[str, ...] = ()
    url_keywords: tuple[str, ...] = ()


DEFAULT = RuleSet(
    (
        *(Family(name, found, (), weight, cap, label) for name, (found, weight, cap, label) in rules.DETECTOR_FAMILIES.items()),
        Family("phrases", (), rules.SUSPICIOUS_PHRASES, rules.PHRASE_WEIGHT, rules.PHRASE_CAP, rules.PHRASE_LABEL),
    ),
    rules.DETECTOR_BRANDS, rules.DETECTOR_SUSPICIOUS_TLDS, rules.DETECTOR_SHORTENERS, rules.DETECTOR_URL_KEYWORDS,
)


# ------------------------------------------------------------------ guards
def _alternatives(pattern: str) -> list[str] | None:
    """The pattern cut at the bars outside groups and classes; None where brackets don't pair up."""
    parts, start, depth, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.find("]", i + 2)
            if i < 0:
                return None
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                return None
        elif c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]] if depth == 0 else None


def _longest_literal(alternative: str) -> str:
    """The longest run of characters that every match has, outside groups."""
    runs, depth, i = [""], 0, 0
    while i < len(alternative):
        c = alternative[i]
        if c == "\\":
            i += 1
            literal = not alternative[i:i + 1].isalnum()
            c = alternative[i:i + 1]
        else:
            literal = c not in "[](){}?*+.^$"
        if literal and not depth:
            runs[-1] += c
        elif literal or (depth and c not in "()["):
            pass
        else:
            if c in "?*{" and not depth:
                runs[-1] = runs[-1][:-1]                  # that character may be missing
            if c == "[":
                i = alternative.find("]", i + 2)
            elif c == "{":
                i = alternative.find("}", i)
            depth += (c == "(") - (c == ")")
            runs.append("")
        i += 1
    return max(runs, key=len)


def guards(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of ``pattern`` in a folded text has one; empty where that can't be told.

    Only plain patterns are read: inline options, look-around, nested classes, escapes in classes and escapes with letters
    or digits other than the common classes give no guard, and the pattern is then simply run on every text.
    """
    if "(?" in pattern or re.search(r"\\[^\W_bBdDsSwW]", re.sub(r"\\\\", "", pattern)) or re.search(r"\[[^\]]*[\[\\]|\[\^?\]", pattern):
        return ()
    body = re.sub(r"^(?:\\b)+|(?:\\b)+$", "", pattern) if not pattern.endswith("\\\\b") else pattern
    inner = body[1:-1] if body[:1] == "(" and body[-1:] == ")" else ""
    parts = _alternatives(inner) if inner and _alternatives(inner) is not None else _alternatives(body)
    if parts is None:
        return ()
    found = [_longest_literal(p).lower() for p in parts]
    plain = all(len(f) >= GUARD_CHARS and f.isascii() for f in found)
    return tuple(dict.fromkeys(found)) if plain else ()


def compile_rule(pattern: str) -> rules.Rule:
    """A rule with its guards. Texts are matched folded, so a pattern with capitals is matched without case."""
    capitals = re.sub(r"\\.", "", pattern)
    return rules.Rule("(?i)" + pattern if capitals != capitals.lower() else pattern, guards(pattern))


# ------------------------------------------------------------------ tables
def rule_rows(rule_set: RuleSet, name: str) -> list[tuple]:
    """A rule set as rows of a rule table."""
    rows = [(name, kind, f.name, p, f.weight, f.cap, f.label)
            for f in rule_set.families for kind, found in (("pattern", [r.pattern for r in f.rules]), ("phrase", f.phrases)) for p in found]
    rows += [(name, kind, None, p, None, None, None) for kind, field in LISTS.items() for p in getattr(rule_set, field)]
    return [(*r, i) for i, r in enumerate(rows)]


def rule_table(spark: SparkSession, **rule_sets: RuleSet) -> DataFrame:
    return spark.createDataFrame([r for name, s in rule_sets.items() for r in rule_rows(s, name)], SCHEMA)


def load_rule_set(table: DataFrame, name: str) -> RuleSet:
    """The rule set ``name`` of a rule table, checked: bounded, known kinds, one weight a family, patterns that compile.

    Repeated rows count once; literals are lower-cased. Raises ValueError for a set that is missing, has over
    ``MAX_RULES`` rows, no family, an empty pattern or contradictory families.
    """
    wanted = table.where(F.col("rule_set") == name).select("rank", "kind", "family", "pattern", "weight", "cap", "label")
    rows = wanted.distinct().limit(MAX_RULES + 1).collect()
    if not rows or len(rows) > MAX_RULES:
        raise ValueError(f"rule set {name!r} has {'no rows' if not rows else f'over {MAX_RULES} rows'}")
    rows.sort(key=lambda r: (r["rank"] is None, r["rank"] or 0, r["kind"] or "", r["pattern"] or ""))
    heads: dict[str, tuple] = {}
    found: dict[tuple[str, str | None], dict[str, None]] = {}
    for r in rows:
        in_family = r["kind"] in ("pattern", "phrase")
        if not r["pattern"] or not (in_family or r["kind"] in LISTS):
            raise ValueError(f"rule set {name!r}: no rule {r!r}")
        if in_family:
            head = (r["weight"], r["cap"], r["label"])
            if not r["family"] or None in head or heads.setdefault(r["family"], head) != head:
                raise ValueError(f"rule set {name!r}: family {r['family']!r} needs one weight, cap and label")
        literal = r["pattern"] if r["kind"] == "pattern" else r["pattern"].lower()
        found.setdefault((r["kind"], r["family"] if in_family else None), {})[literal] = None
    if not heads:
        raise ValueError(f"rule set {name!r} has no family")
    families = tuple(
        Family(f, tuple(map(compile_rule, found.get(("pattern", f), ()))), tuple(found.get(("phrase", f), ())), *head)
        for f, head in heads.items())
    patterns = [tx.match_count(F.lit(""), r.pattern) for f in families for r in f.rules]
    if patterns:
        table.sparkSession.range(1).select(*patterns).collect()      # a pattern that doesn't compile raises here
    return RuleSet(families, *(tuple(found.get((kind, None), ())) for kind in LISTS))
