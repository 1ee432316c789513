"""Feature vectors: 27 text features, 24 URL features, 51 combined.

Each step is a ``withColumns`` stage, so a shared intermediate (stripped text,
folded text, tokens, URL parts) is computed once per row and no shuffle occurs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.functions import url as ux

# Names of the output columns
TEXT_FEATURES = [
    "text_length", "word_count", "url_count", "email_count", "phone_count",
    "has_url", "has_email", "has_phone",
    "urgency_score", "threat_score", "credential_score", "financial_score",
    "action_score", "impersonation_score",
    "uppercase_ratio", "exclamation_count", "question_count", "punctuation_ratio",
    "avg_word_length", "short_word_ratio", "long_word_ratio",
    "all_caps_word_count", "capitalized_word_ratio",
    "has_currency", "has_percentage", "digit_ratio", "phishing_indicator_score",
]
URL_FEATURES = [
    "url_length", "domain_length", "path_length", "subdomain_count", "path_depth",
    "query_param_count", "digit_count", "special_char_count", "digit_ratio",
    "has_https", "has_http", "has_ip_address", "has_at_symbol", "has_double_slash",
    "has_hexadecimal", "suspicious_tld", "tld_length", "has_brand_name",
    "suspicious_keyword_count", "is_shortened", "domain_entropy", "url_entropy",
    "has_hyphen_in_domain", "consecutive_digits",
]
COMBINED_FEATURES = [f"text_{n}" for n in TEXT_FEATURES] + [f"url_{n}" for n in URL_FEATURES]


def _text_columns(t: Column, low: Column, words: Column, urls: Column, families: Column) -> dict[str, Column]:
    n = F.greatest(F.length(t), F.lit(1))
    n_words = F.greatest(F.size(words), F.lit(1))
    digits = F.col("__digits")
    emails, phones = tx.email_count(low), tx.phone_count(t, digits)
    caps = F.filter(words, lambda w: (F.length(w) > 1) & (F.lower(w) != w) & (F.upper(w) == w))
    out: dict[str, Column] = {
        "text_length": F.length(t),
        "word_count": F.size(words),
        "url_count": F.size(urls),
        "email_count": emails,
        "phone_count": phones,
        "has_url": ux.flag(F.size(urls) > 0),
        "has_email": ux.flag(emails > 0),
        "has_phone": ux.flag(phones > 0),
    }
    for name in rules.EXTRACTOR_FAMILIES:
        out[f"{name}_score"] = families[name]
    out |= {
        "uppercase_ratio": tx.upper_count(t) / n,
        "exclamation_count": tx.char_count(t, "!"),
        "question_count": tx.char_count(t, "?"),
        "punctuation_ratio": tx.char_count(t, ".,!?;:") / n,
        "avg_word_length": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / n_words,
        "short_word_ratio": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / n_words,
        "long_word_ratio": F.size(F.filter(words, lambda w: F.length(w) >= 10)) / n_words,
        "all_caps_word_count": F.size(caps),
        "capitalized_word_ratio": F.regexp_count(
            t, F.lit(rf"(?U)(?<!{tx.NON_SPACE})\p{{IsUppercase}}")
        ) / n_words,
        "has_currency": ux.flag(tx.contains_any("__t", tx.CURRENCY_CHARS)),
        "has_percentage": ux.flag(t.contains("%") & tx.matches(t, r"\d%")),
        "digit_ratio": digits / n,
        "phishing_indicator_score": tx.total(
            families[name] * F.lit(weight) for name, weight in rules.INDICATOR_WEIGHTS
        ),
    }
    return out


def with_text_features(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Append the 27 text features of column ``text`` as DOUBLE columns."""
    staged = df.withColumns({"__t": tx.strip(tx.text_or_empty(F.col(text)))}).withColumns(
        {"__low": tx.fold(F.col("__t")), "__words": tx.words(F.col("__t")), "__urls": tx.extract_urls(F.col("__t"))}
    ).withColumns(
        {"__digits": tx.digit_count(F.col("__t")), "__fam": F.struct(*[
            tx.family_count("__low", family).cast("double").alias(name)
            for name, family in rules.EXTRACTOR_FAMILIES.items()
        ])}
    )
    cols = _text_columns(*[F.col(c) for c in ("__t", "__low", "__words", "__urls", "__fam")])
    return staged.withColumns(
        {prefix + k: cols[k].cast("double") for k in TEXT_FEATURES}
    ).drop("__t", "__low", "__words", "__urls", "__digits", "__fam")


def _url_columns(u: Column, parts: Column, dom: Column) -> dict[str, Column]:
    return {
        "url_length": F.length(u),
        "domain_length": F.length(parts["netloc"]),
        "path_length": F.length(parts["path"]),
        "subdomain_count": F.when(dom["subdomain"] == "", 0).otherwise(
            F.size(F.split(dom["subdomain"], r"\."))
        ),
        "path_depth": ux.path_depth(parts["path"]),
        "query_param_count": ux.query_param_count(parts["query"]),
        "digit_count": tx.digit_count(u),
        "special_char_count": ux.special_char_count(u),
        "digit_ratio": tx.digit_count(u) / F.greatest(F.length(u), F.lit(1)),
        "has_https": ux.flag(parts["scheme"] == "https"),
        "has_http": ux.flag(parts["scheme"] == "http"),
        "has_ip_address": ux.flag(ux.has_ip_host(parts["netloc"])),
        "has_at_symbol": ux.flag(u.contains("@")),
        "has_double_slash": ux.flag(parts["path"].contains("//")),
        "has_hexadecimal": ux.flag(u.rlike("%[0-9a-fA-F]{2}")),
        "suspicious_tld": ux.flag(tx.one_of(F.lower(dom["suffix"]), rules.EXTRACTOR_SUSPICIOUS_TLDS)),
        "tld_length": F.length(dom["suffix"]),
        "has_brand_name": ux.flag(ux.has_brand("__low", rules.EXTRACTOR_BRANDS)),
        "suspicious_keyword_count": tx.contains_count("__low", rules.EXTRACTOR_URL_KEYWORDS),
        "is_shortened": ux.flag(tx.contains_any("__low", rules.EXTRACTOR_SHORTENERS)),
        "domain_entropy": tx.entropy(dom["domain"]),
        "url_entropy": tx.entropy(u),
        "has_hyphen_in_domain": ux.flag(dom["domain"].contains("-")),
        "consecutive_digits": ux.longest_digit_run(dom["domain"]),
    }


def with_url_features(
    df: DataFrame, url: str, prefix: str = "", *, suffixes: Iterable[str]
) -> DataFrame:
    """Append the 24 URL features of column ``url``; empty or unparsable URLs give zeros."""
    u = tx.strip(tx.text_or_empty(F.col(url)))
    staged = (
        df.withColumns({"__u": u})
        .withColumns({"__low": tx.fold(F.col("__u")), "__parts": ux.parts(F.col("__u")), "__host": ux.host(F.col("__u"))})
        .withColumns({"__suffix": ux.longest_suffix(F.col("__host"), suffixes)})
        .withColumns({"__dom": ux.domain_parts(F.col("__host"), F.col("__suffix"))})
    )
    cols = _url_columns(*[F.col(c) for c in ("__u", "__parts", "__dom")])
    usable = (F.col("__u") != "") & F.col("__parts.valid")
    return staged.withColumns(
        {prefix + k: F.when(usable, cols[k].cast("double")).otherwise(0.0) for k in URL_FEATURES}
    ).drop("__u", "__low", "__parts", "__host", "__suffix", "__dom")


def with_combined_features(
    df: DataFrame, text: str, url: str | None = None, *, suffixes: Iterable[str]
) -> DataFrame:
    """Append the 51 combined features: text, then the given URL or the first one in the text."""
    first = F.try_element_at(tx.extract_urls(F.col(text)), F.lit(1))
    chosen = first if url is None else F.coalesce(F.when(F.col(url) != "", F.col(url)), first)
    staged = with_text_features(df.withColumns({"__url": chosen}), text, "text_")
    return with_url_features(staged, "__url", "url_", suffixes=suffixes).drop("__url")


def explain_features(t: Column, folded: Column) -> Column:
    """Struct of the eleven explainability features of a raw text."""
    n = F.length(t)
    return F.struct(
        n.cast("long").alias("length"),
        tx.word_count(t).cast("long").alias("word_count"),
        (tx.contains_any(folded, ("http", "www")) & tx.matches(folded, rf"http{tx.NON_SPACE}|www{tx.NON_SPACE}")).alias("has_url"),
        (t.contains("@") & tx.matches(t, tx.AT_TOKEN_PATTERN)).alias("has_email"),
        tx.matches(t, tx.LONG_NUMBER_PATTERN).alias("has_phone"),
        F.when(n > 0, tx.upper_count(t) / F.greatest(n, F.lit(1))).otherwise(0.0).alias("uppercase_ratio"),
        tx.char_count(t, "!").cast("long").alias("exclamation_count"),
        tx.char_count(t, "?").cast("long").alias("question_count"),
        tx.contains_any(t, tx.CURRENCY_CHARS).alias("currency_symbols"),
        tx.rule_hit(folded, rules.EXPLAIN_URGENCY).alias("urgency_words"),
        tx.rule_hit(folded, rules.EXPLAIN_SPAM).alias("spam_keywords"),
    )


def statistics(t: Column) -> Column:
    """Struct of the ten statistical features of the threat detector (raw text)."""
    n = F.length(t)
    safe = F.greatest(n, F.lit(1))
    special = n - F.length(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}\s\x1c-\x1f]+", ""))
    return F.struct(
        n.cast("long").alias("length"),
        tx.word_count(t).cast("long").alias("word_count"),
        (tx.upper_count(t) / safe).alias("uppercase_ratio"),
        (tx.digit_count(t) / safe).alias("digit_ratio"),
        (special / safe).alias("special_char_ratio"),
        tx.char_count(t, "!").cast("long").alias("exclamation_count"),
        tx.char_count(t, "?").cast("long").alias("question_count"),
        F.regexp_count(t, F.lit("[$£€¥]")).cast("long").alias("currency_count"),
        tx.at_token_count(t).cast("long").alias("email_count"),
        tx.match_count(t, tx.LONG_NUMBER_PATTERN).cast("long").alias("phone_count"),
    )


def suspicion(stats: Column) -> Column:
    """Suspicion score of the statistical features."""
    # Feature, limit, weight
    checks = (
        ("uppercase_ratio", 0.3, 0.2), ("exclamation_count", 3, 0.2),
        ("currency_count", 0, 0.1), ("special_char_ratio", 0.2, 0.1),
    )
    score = tx.total(F.when(stats[name] > limit, x).otherwise(0.0) for name, limit, x in checks)
    return F.least(score, F.lit(1.0))
