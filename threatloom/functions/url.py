"""URL scalar functions: splitting, hosts, suffixes and per-URL risk.

A URL is parsed once into a struct; everything else reads the struct's fields.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.rulesets import DEFAULT, RuleSet

# RFC 3986 appendix B, with the scheme restricted to legal characters
_RFC = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
_HOST = r"^(?:(?:[A-Za-z0-9+.-]+:)?//)?([^/?#]*)"
_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"


def parts(url: Column) -> Column:
    """Struct scheme, netloc, path, query, fragment, valid."""
    u = F.regexp_replace(F.translate(url, "\t\r\n", ""), r"^[\x00-\x20]+", "")

    def group(i: int) -> Column:
        return F.regexp_extract(u, _RFC, i)

    return F.struct(
        F.lower(group(1)).alias("scheme"),
        group(2).alias("netloc"),
        F.regexp_replace(group(3), r";[^/]*$", "").alias("path"),
        group(4).alias("query"),
        group(5).alias("fragment"),
        (group(2).contains("[") == group(2).contains("]")).alias("valid"),
    )


def host(url: Column) -> Column:
    """Host without user info, port and trailing dots (works without a scheme too)."""
    authority = F.regexp_extract(url, _HOST, 1)
    bare = F.substring_index(F.substring_index(authority, "@", -1), ":", 1)
    return F.rtrim(tx.strip(bare), F.lit("."))


def suffix_candidates(host_labels: Column) -> Column:
    """Every trailing label sequence, longest first."""
    n = F.size(host_labels)
    return F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(host_labels, i, n), ".")
    )


def longest_suffix(hostname: Column, suffixes: Iterable[str]) -> Column:
    """Public suffix of a host by a rule list, '' if none (or an IPv4 address).

    The longest matching rule counts: ``name`` matches itself, ``*.name`` one
    label more; an exception ``!name`` wins and leaves out its first label.
    """
    known = set(suffixes)
    plain = sorted(s for s in known if s[:1] not in "!*")
    above = sorted(s[2:] for s in known if s.startswith("*."))
    exceptions = sorted(s[1:] for s in known if s.startswith("!"))
    candidates = suffix_candidates(F.split(F.lower(hostname), r"\."))

    def listed(c: Column) -> Column:
        hit = c.isin(plain)
        return hit | (c.contains(".") & parent(c).isin(above)) if above else hit

    found = F.try_element_at(F.filter(candidates, listed), F.lit(1))
    if exceptions:
        found = F.coalesce(parent(F.try_element_at(F.filter(candidates, lambda c: c.isin(exceptions)), F.lit(1))), found)
    return F.when(hostname.rlike(_IPV4), F.lit("")).otherwise(F.coalesce(found, F.lit("")))


def parent(name: Column) -> Column:
    """A host name without its first label."""
    return F.regexp_replace(name, r"^[^.]*\.", "")


def domain_parts(hostname: Column, suffix: Column) -> Column:
    """Struct subdomain, domain, suffix from a host and its public suffix."""
    n_suffix = F.when(suffix == "", 0).otherwise(F.size(F.split(suffix, r"\.")))
    labels = F.split(hostname, r"\.")
    n = F.size(labels) - n_suffix
    is_ip = hostname.rlike(_IPV4)
    return F.struct(
        F.when(is_ip | (n < 2), "")
        .otherwise(F.array_join(F.slice(labels, F.lit(1), F.greatest(n - 1, F.lit(0))), "."))
        .alias("subdomain"),
        F.when(is_ip, hostname)
        .when(n >= 1, F.element_at(labels, F.greatest(n, F.lit(1))))
        .otherwise("")
        .alias("domain"),
        F.when(suffix == "", "")
        .otherwise(F.array_join(F.slice(labels, F.greatest(n, F.lit(0)) + 1, F.greatest(n_suffix, F.lit(1))), "."))
        .alias("suffix"),
    )


def host_parts(url: Column, suffixes: Iterable[str]) -> Column:
    """Struct subdomain, domain, suffix of a URL."""
    return tx.let(host(url), lambda h: tx.let(longest_suffix(h, suffixes), lambda s: domain_parts(h, s)))


def has_ip_host(netloc: Column) -> Column:
    """IPv4 prefix, or the loose IPv6 form that any host starting with a hex digit meets."""
    h = F.substring_index(netloc, ":", 1)
    return h.rlike(r"(?U)^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}") | h.rlike(r"^\[?[0-9a-fA-F:]+")


def path_depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda s: s != ""))


def query_param_count(query: Column) -> Column:
    """Distinct decoded names that carry a non-blank value."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike(r"^[^=]*=(?s:.)"))
    names = F.transform(
        pairs,
        lambda p: F.coalesce(
            F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)
        ),
    )
    return F.size(F.array_distinct(names))


def special_char_count(url: Column) -> Column:
    return F.regexp_count(url, F.lit(r"[^\p{L}\p{N}:/.]"))


def longest_digit_run(c: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(c, F.lit(tx.DIGIT + "+"), F.lit(0)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def brand_pattern(brands: Iterable[str]) -> str:
    return r"\b(" + "|".join(map(re.escape, brands)) + r")\b"


def has_brand(folded: Column | str, brands: Iterable[str]) -> Column:
    if not brands:
        return F.lit(False)
    return tx.contains_any(folded, brands) & tx.matches(tx.as_column(folded), brand_pattern(brands))


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def analyse(urls: Column, suffixes: Iterable[str], lists: RuleSet = DEFAULT) -> Column:
    """Per-URL risk of the phishing detector, for a whole array of URLs.

    Two chained transforms: the first derives host pieces once per URL, the
    second reads them.  No explode, hence no regroup.
    """
    w = rules.URL_WEIGHTS
    derived = F.transform(
        urls,
        lambda u: F.struct(
            u.alias("url"),
            tx.fold(u).alias("low"),
            host_parts(u, suffixes).alias("dom"),
        ),
    )

    def checks(s: Column) -> list[tuple[Column, float, Column]]:
        url, low, dom = s["url"], s["low"], s["dom"]
        keywords = tx.contains_count(low, lists.url_keywords)
        return [
            (url.rlike(r"(?U)^https?://\d+\.\d+\.\d+\.\d+"), w["ip"], F.lit(rules.REASON_IP)),
            (tx.one_of(F.lower(dom["suffix"]), lists.tlds), w["tld"],
             F.concat(F.lit(rules.REASON_TLD), dom["suffix"])),
            (has_brand(tx.fold(dom["subdomain"]), lists.brands), w["brand_subdomain"],
             F.lit(rules.REASON_BRAND)),
            (tx.contains_any(low, lists.shorteners), w["shortener"],
             F.lit(rules.REASON_SHORTENER)),
            (url.contains("@"), w["at"], F.lit(rules.REASON_AT)),
            (tx.char_count(url, ".") > 4, w["dots"], F.lit(rules.REASON_DOTS)),
            (keywords >= 2, w["keywords"],
             F.concat(F.lit(rules.REASON_KEYWORDS + " ("), keywords.cast("string"), F.lit(")"))),
        ]

    scored = F.transform(
        derived,
        lambda s: F.struct(
            s["url"].alias("url"),
            s["low"].alias("low"),
            s["dom"].alias("dom"),
            tx.total(F.when(hit, x).otherwise(0.0) for hit, x, _ in checks(s)).alias("raw"),
            F.array_compact(F.array(*[F.when(hit, why) for hit, _, why in checks(s)])).alias("reasons"),
        ),
    )
    return F.transform(
        scored,
        lambda s: F.struct(
            s["url"].alias("url"),
            (s["raw"] >= rules.URL_SUSPICIOUS_AT).alias("is_suspicious"),
            F.least(s["raw"], F.lit(1.0)).alias("score"),
            s["reasons"].alias("reasons"),
            tx.one_of(F.lower(s["dom"]["suffix"]), lists.tlds).alias("bad_tld"),
            tx.contains_any(s["low"], lists.shorteners).alias("shortened"),
            F.concat_ws(".", s["dom"]["domain"], s["dom"]["suffix"]).alias("registered"),
        ),
    )
