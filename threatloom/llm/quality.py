"""Quality rules: a base check and a decision list learned from labelled documents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.llm.common import unused

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled documents that the rules are learned from, at most: the first ones in the order of a hash of their ids.
FIT_ROWS = 20_000
#: Conditions of a rule, and rules of a list, at most.
MAX_CONDITIONS = 3
MAX_RULES = 12
#: A rule must be right on this share of the rows that it covers, as (right + 1) / (covered + 2).
MIN_PRECISION = 0.9

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_digits")
_BLANKS = b" \t\n\r\x0b\x0c"
_INNER = _BLANKS + bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(code) == n:
        return 0
    ids, m = np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=n), len(code)
    pair = ids[:-1] * m + ids[1:]
    if m > 2_000_000:  # m ** 3 would overflow
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * m + ids[2:]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    for at in (order[1:][same], order[:-1][same]):
        hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def document_statistics(data: bytes) -> tuple[int, ...]:
    """``STATISTICS`` of one UTF-8 text."""
    words = data.split()
    dup, lines, seen = 0, 0, set()
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    size = len(data)
    return (
        len(words), len(data.translate(None, _INNER)), size - len(data.translate(None, b"#*$%&|<>")), dup,
        _repeat_words(words), lines, data.count(b"!"), size - len(data.translate(None, _UPPER)),
        size - len(data.translate(None, _DIGITS)),
    )


def with_statistics(docs: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """``docs`` with a struct of ``STATISTICS``, one pass over the whole texts; NULL counts as an empty text."""
    @F.pandas_udf(", ".join(f"{n} bigint" for n in STATISTICS))
    def compute(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([document_statistics(x or b"") for x in texts], columns=STATISTICS, dtype="int64")

    # not to be copied below filters and into several projections
    return docs.withColumn(into, compute.asNondeterministic()(F.col(text).cast("binary")))


def features(get: Callable) -> dict:
    """The ratios that rules test, from statistics; the same formulas for columns and arrays."""
    words, chars, lines = get("n_words") + 1, get("word_chars") + 1, get("n_lines") + 1
    return {
        "n_words": get("n_words") * 1.0, "chars_per_word": get("word_chars") / words,
        "symbols_per_word": get("n_symbols") / words, "dup_line_share": get("n_dup_lines") / lines,
        "repeat_share": get("n_repeat_words") / words, "bangs_per_word": get("n_bangs") / words,
        "upper_share": get("n_upper") / chars, "digit_share": get("n_digits") / chars,
        "words_per_line": get("n_words") / lines,
    }


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for name, op, cut in rule:
        hit &= x[name] >= cut if op == ">=" else x[name] < cut
    return hit


def _precision(covered: np.ndarray, bad: np.ndarray) -> float:
    """Laplace estimate of the share of bad rows among covered ones."""
    return (int((covered & bad).sum()) + 1) / (int(covered.sum()) + 2)


def _centred(rule: Rule, i: int, x: dict[str, np.ndarray], left: np.ndarray) -> tuple[str, str, float]:
    """The rule's i-th condition, its cut moved to the middle of the gap between the values on both sides."""
    name, op, cut = rule[i]
    values = x[name][left & _covers(rule[:i] + rule[i + 1:], x, len(left))]
    below, above = values[values < cut], values[values >= cut]
    return name, op, float(below.max() + above.min()) / 2 if len(below) and len(above) else cut


def learn_rules(statistics: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, max_rules: int = MAX_RULES,
                max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Ordered rules that reject, by sequential covering; what no rule covers is kept.

    Each rule grows on the rows with ``part`` 0 or 1: the condition ``feature >= cut`` or ``< cut`` of most information
    gain is added while the rule covers good rows, cuts being quantiles of the bad rows left. It is pruned on the rows
    with ``part`` 2: last conditions go while that doesn't lower its precision there. A rule joins the list if its
    precision is at least ``min_precision`` on all rows left and it is right on no less than half of the pruning rows
    that it covers, after each cut has moved to the middle of its gap; its rows leave and the search goes on. Few or one-sided labels give few rules or none.
    """
    x = features(lambda k: statistics[k].astype(float))
    n = len(bad)
    left, rules = np.ones(n, dtype=bool), []
    while len(rules) < max_rules:
        grow, prune = left & (part != 2), left & (part == 2)
        if not (grow & bad).any():
            break
        rule, hit = [], grow.copy()
        while len(rule) < max_conditions and (hit & ~bad).any():
            p0, n0 = int((hit & bad).sum()), int(hit.sum())
            best = (0.0, None, None)
            for name, values in x.items():
                own = values[hit & bad]
                for cut in np.unique(np.quantile(own, np.linspace(0, 1, 41), method="inverted_cdf")):
                    for op in (">=", "<"):
                        new = hit & (values >= cut if op == ">=" else values < cut)
                        p1, n1 = int((new & bad).sum()), int(new.sum())
                        if p1 and n1 < n0:
                            gain = p1 * (np.log2(p1 / n1) - np.log2(p0 / n0))
                            if gain > best[0] + 1e-9:
                                best = (gain, (name, op, float(cut)), new)
            if best[1] is None:
                break
            rule.append(best[1])
            hit = best[2]
        while len(rule) > 1:
            longer, shorter = (_precision(prune & _covers(r, x, n), bad) for r in (rule, rule[:-1]))
            if shorter < longer:
                break
            rule = rule[:-1]
        if not rule:
            break
        rule = [_centred(rule, i, x, left) for i in range(len(rule))]
        hit = left & _covers(rule, x, n)
        held = hit & prune
        if _precision(hit, bad) < min_precision or 2 * int((held & bad).sum()) < int(held.sum()):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rule_expression(rules: list[Rule], stats: str) -> Column:
    """The 1-based number of the first rule that rejects a row, or 0: an ordered conditional expression."""
    x = features(lambda k: F.col(f"{stats}.{k}"))
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, op, cut in rule:
            test = test & (x[name] >= F.lit(cut) if op == ">=" else x[name] < F.lit(cut))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def fit_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
              max_rows: int = FIT_ROWS, **options) -> list[Rule]:
    """Rules from at most ``max_rows`` labelled documents (``label`` 0 is bad); rows with a NULL key or label don't count.

    The bounded sample of keys is broadcast to the documents, and the statistics of those rows alone reach the driver.
    The rows that fail the base check are left out: they are rejected without rules.
    """
    h = F.xxhash64("k")
    chosen = labels.select(F.col(key).alias("k"), F.col(label).alias("label")).where("k is not null and label is not null")
    chosen = chosen.orderBy(h, "k", "label").limit(max_rows)
    rows = docs.select(F.col(key).alias("d"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("d") == F.col("k"))
    rows = with_statistics(rows.select("k", "t", "label"), "t").select("stats.*", "label", F.pmod(h, F.lit(3)).alias("part"))
    found = rows.orderBy(*rows.columns).limit(4 * max_rows).toPandas()  # a key may have a few rows
    if found.empty:
        return []
    fails = _base(lambda k: found[k]).to_numpy()
    found = found[~fails]
    return learn_rules({k: found[k].to_numpy() for k in STATISTICS}, found["label"].to_numpy() == 0, found["part"].to_numpy(), **options)


def _base(get: Callable):
    return (get("n_words") < MIN_WORDS) | (get("n_repeat_words") * 100 > get("n_words") * MAX_REPEAT_PERCENT)


def with_verdict(docs: DataFrame, rules: list[Rule], text: str = "text", stats: str = "stats", failed: str = "base_failed",
                 rule: str = "rule", kept: str = "kept") -> DataFrame:
    """``docs`` with statistics, ``base_failed``, the ``rule`` that rejects (0: none) and ``kept``; one pass, no shuffle.

    NULL and empty texts have no words and fail the base check; repeated rows are judged each; an empty table gives no
    rows; the names of the new columns are arguments, for tables that have such columns.
    """
    return (
        with_statistics(docs, text, stats)
        .withColumn(failed, _base(lambda k: F.col(f"{stats}.{k}")))
        .withColumn(rule, rule_expression(rules, stats))
        .withColumn(kept, ~F.col(failed) & (F.col(rule) == 0))
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that pass the base check and the rules learned from ``labels``, with their own columns."""
    names = {x: unused(docs.columns, x) for x in ("stats", "failed", "rule", "kept")}
    return with_verdict(docs, fit_rules(docs, labels, key, text, **options), text, **names).where(names["kept"]).select(*docs.columns)
