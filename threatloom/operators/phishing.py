"""Phishing scoring: rules, URLs, brand, ensemble, indicators, level, type, advice.

All of it is row-local: one scan, no shuffle, whatever the table size.  The
model and transformer probabilities are optional input columns that default to
the neutral score.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.functions import url as ux
from threatloom.rulesets import DEFAULT, Family, RuleSet


def _family_count(low: Column | str, family: Family) -> Column:
    parts = [tx.family_count(low, family.rules)] if family.rules else []
    return tx.total(parts + ([tx.contains_count(low, family.phrases)] if family.phrases else []))


def rule_counts(low: Column | str, rule_set: RuleSet = DEFAULT) -> Column:
    """Struct of hit counts per family; a phrase counts once."""
    return F.struct(*[_family_count(low, f).alias(f.name) for f in rule_set.families])


def rule_score(counts: Column, rule_set: RuleSet = DEFAULT) -> Column:
    parts = [F.least(F.lit(f.cap), counts[f.name] * F.lit(f.weight)) for f in rule_set.families]
    return F.least(tx.total(parts), F.lit(1.0))


def rule_indicators(counts: Column, rule_set: RuleSet = DEFAULT) -> Column:
    def sentence(f: Family) -> Column:
        unit = " patterns" if f.rules else ""
        return F.when(counts[f.name] > 0, F.concat(F.lit(f"{f.label} ("), counts[f.name].cast("string"), F.lit(f"{unit})")))

    return F.array_compact(F.array(*map(sentence, rule_set.families)))


def brand_mentions(low: Column | str, urls: Column, brands: Iterable[str] = DEFAULT.brands) -> Column:
    """Brand words in the text and, once more, in its URLs."""
    if not brands:
        return F.array().cast("array<string>")
    both = F.concat_ws(" ", tx.as_column(low), tx.fold(F.array_join(urls, " ")))
    return F.when(
        tx.contains_any(low, brands),
        F.regexp_extract_all(both, F.lit(tx.FLAGS + ux.brand_pattern(brands)), F.lit(1)),
    ).otherwise(F.array().cast("array<string>"))


def top_brand(mentions: Column) -> Column:
    """Most frequent brand, ties by name; null when there is none."""
    ranked = F.array_sort(
        F.transform(
            F.array_distinct(mentions),
            lambda b: F.struct(
                (-F.size(F.filter(mentions, lambda m: m == b))).alias("neg"), b.alias("brand")
            ),
        )
    )
    return F.try_element_at(ranked, F.lit(1))["brand"]


def impersonated(brand: Column, urls_analyzed: Column) -> Column:
    """A brand is mentioned while some URL's registered domain lacks it."""
    return F.coalesce(
        F.exists(urls_analyzed, lambda u: ~F.lower(u["registered"]).contains(brand)), F.lit(False)
    )


def ensemble(ml: Column, rule: Column, url: Column, brand_hit: Column, transformer: Column) -> Column:
    w, limit = rules.ENSEMBLE_WEIGHTS, rules.SIGNAL_THRESHOLDS
    brand = F.when(brand_hit, rules.BRAND_SIMILARITY).otherwise(0.0)
    score = tx.total([
        F.lit(w["ml"]) * ml, F.lit(w["rule"]) * rule, F.lit(w["url"]) * url,
        F.lit(w["brand"]) * brand, F.lit(w["transformer"]) * transformer,
    ])
    signals = tx.total(
        hit.cast("int")
        for hit in (
            ml > limit["ml"], rule > limit["rule"], url > limit["url"], brand_hit,
            transformer > limit["transformer"],
        )
    )
    boosted = F.when(signals >= rules.BOOST_SIGNALS, score * rules.BOOST_FACTOR).otherwise(score)
    return F.least(boosted, F.lit(1.0))


def indicators(rule_found: Column, urls_analyzed: Column, brand_hit: Column, brand: Column) -> Column:
    """Distinct indicator sentences, sorted."""
    domains = F.transform(
        F.filter(urls_analyzed, lambda u: u["bad_tld"]),
        lambda u: F.concat(F.lit(rules.INDICATOR_DOMAIN), u["registered"]),
    )
    extra = F.array_compact(F.array(
        F.when(brand_hit, F.concat(F.lit("Possible "), brand, F.lit(" impersonation detected"))),
        F.when(F.exists(urls_analyzed, lambda u: u["shortened"]), F.lit(rules.INDICATOR_SHORTENER)),
    ))
    return F.array_sort(F.array_distinct(F.concat(rule_found, domains, extra)))


def threat_level(score: Column, n_indicators: Column) -> Column:
    out = None
    for level, minimum, count in rules.THREAT_LEVELS:
        hit = (score >= minimum) | (n_indicators >= count)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.otherwise("NONE")


def phishing_type(scan: Column, urls_analyzed: Column) -> Column:
    all_bad = (F.size(urls_analyzed) > 0) & F.forall(urls_analyzed, lambda u: u["is_suspicious"])
    some_bad = F.exists(urls_analyzed, lambda u: u["is_suspicious"])
    return (
        F.when((scan == "url") | all_bad, "URL")
        .when(scan == "sms", "SMS")
        .when(scan == "email", "EMAIL")
        .when(some_bad, "URL")
        .otherwise("NONE")
    )


def recommendation(level: Column) -> Column:
    out = None
    for name, sentence in rules.RECOMMENDATIONS.items():
        out = F.when(level == name, sentence) if out is None else out.when(level == name, sentence)
    return out


def phishing_probability(label: Column, score: Column) -> Column:
    """Turn a classifier's (label, score) into the probability of phishing."""
    return F.when(tx.one_of(F.lower(label), rules.PHISHING_POSITIVE_LABELS), score).otherwise(1.0 - score)


def with_phishing_result(
    df: DataFrame,
    text: str,
    scan_type: str | Column = "auto",
    ml: Column | None = None,
    transformer: Column | None = None,
    *,
    suffixes: Iterable[str],
    rule_set: RuleSet = DEFAULT,
) -> DataFrame:
    """Append the full phishing verdict of column ``text``, by the given rules (``rulesets.load_rule_set`` reads a table).

    Adds is_phishing, confidence, phishing_type, threat_level, indicators,
    urls_analyzed, brand_impersonation, recommendation and details.
    """
    neutral = F.lit(rules.NEUTRAL_SCORE)
    ml = neutral if ml is None else F.coalesce(ml, neutral)
    transformer = neutral if transformer is None else F.coalesce(transformer, neutral)
    asked = F.lit(scan_type) if isinstance(scan_type, str) else scan_type
    c = F.col
    staged = (
        df.withColumns({"__t": tx.strip(tx.text_or_empty(c(text)))})
        .withColumns({
            "__skip": F.length("__t") < rules.MIN_ANALYSED_CHARS,
            "__low": tx.fold(c("__t")),
            "__urls": tx.extract_urls(c("__t")),
        })
        .withColumns({
            "__counts": rule_counts("__low", rule_set),
            "__ua": ux.analyse(c("__urls"), suffixes, rule_set),
            "__mentions": brand_mentions("__low", c("__urls"), rule_set.brands),
            "__scan": F.when(asked == "auto", tx.scan_type(c("__t"), "__low")).otherwise(asked),
        })
        .withColumns({"__brand": top_brand(c("__mentions")), "__rule": rule_score(c("__counts"), rule_set)})
        .withColumns({
            "__hit": impersonated(c("__brand"), c("__ua")),
            "__url": F.coalesce(F.array_max(F.transform("__ua", lambda u: u["score"])), F.lit(0.0)),
            "__ml": ml.cast("double"),
            "__tr": transformer.cast("double"),
        })
        .withColumns({
            "__score": ensemble(c("__ml"), c("__rule"), c("__url"), c("__hit"), c("__tr")),
            "__ind": indicators(rule_indicators(c("__counts"), rule_set), c("__ua"), c("__hit"), c("__brand")),
        })
        .withColumns({"__level": threat_level(c("__score"), F.size("__ind"))})
    )
    skip = c("__skip")
    result = {
        "is_phishing": ~skip & (c("__score") >= rules.PHISHING_THRESHOLD),
        "confidence": F.when(skip, 0.0).otherwise(F.round("__score", 4)),
        "phishing_type": F.when(skip, "NONE").otherwise(phishing_type(c("__scan"), c("__ua"))),
        "threat_level": F.when(skip, "NONE").otherwise(c("__level")),
        "indicators": F.when(skip, F.array().cast("array<string>")).otherwise(c("__ind")),
        "urls_analyzed": F.transform(
            F.filter("__ua", lambda _: ~skip),
            lambda u: F.struct(u["url"], u["is_suspicious"], u["score"], u["reasons"]),
        ),
        "brand_impersonation": F.when(
            ~skip & c("__hit"),
            F.struct(
                c("__hit").alias("detected"), c("__brand").alias("brand"),
                F.lit(rules.BRAND_SIMILARITY).alias("similarity_score"),
            ),
        ),
        "recommendation": F.when(skip, rules.EMPTY_RECOMMENDATION).otherwise(recommendation(c("__level"))),
        "details": F.when(
            ~skip,
            F.struct(
                c("__ml").alias("ml_score"), c("__rule").alias("rule_score"),
                c("__tr").alias("transformer_score"), F.size("__urls").alias("url_count"),
                c("__scan").alias("scan_type"),
            ),
        ),
    }
    temporary = [n for n in staged.columns if n.startswith("__")]
    return staged.withColumns(result).drop(*temporary)


def batch_summary(scored: DataFrame) -> DataFrame:
    """One row: total, phishing_detected, safe."""
    hits = F.sum(F.col("is_phishing").cast("long"))
    return scored.agg(
        F.count("*").alias("total"),
        F.coalesce(hits, F.lit(0)).alias("phishing_detected"),
        (F.count("*") - F.coalesce(hits, F.lit(0))).alias("safe"),
    )


def level_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("threat_level").agg(F.count("*").alias("n"))


def level_map(scored: DataFrame) -> DataFrame:
    """The histogram as one map (at most five entries)."""
    return level_histogram(scored).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("threat_level", "n")))).alias("threat_levels")
    )


def legacy_flags(low: Column, urls: Column, suffixes: Iterable[str]) -> Column:
    """Struct of the four boolean checks: any suspicious URL, all checks on raw text."""
    def bad(u: Column) -> Column:
        return is_suspicious_domain(u, suffixes)

    return F.struct(
        F.exists(urls, bad).alias("suspicious_urls"),
        ux.has_brand(low, rules.DETECTOR_BRANDS).alias("brand_present"),
        tx.any_of(
            tx.rule_hit(low, r) for r in rules.DETECTOR_FAMILIES["urgency"][0]
        ).alias("urgency_present"),
    )


def is_suspicious_domain(u: Column, suffixes: Iterable[str]) -> Column:
    """Case-sensitive test of the suffix as written."""
    return tx.one_of(ux.host_parts(u, suffixes)["suffix"], rules.DETECTOR_SUSPICIOUS_TLDS)
