"""SQL fragments shared by the checks of text, URL and detection queries.

The checks run on an engine whose word boundary is ASCII, so accented letters
are mapped to ``x`` (column ``a``) before patterns with boundaries are tried;
lengths and everything else use the original text.
"""

from __future__ import annotations

from threatloom import rules
from threatloom.plans.fixtures import DETECTOR_SUFFIXES, _q
from threatloom.rulesets import DEFAULT, RuleSet

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
ASCII = "regexp_replace({0}, '[À-ÿ]', 'x', 'g')"
# Contact and URL patterns, as in functions.text
URL = r"""https?://[^\s<>"{}|\\^`\[\]]+"""
LOOSE_URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def count(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {lit('(?i)' + pattern)}))"


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit('(?i)' + pattern)})"


def family(col: str, rule_list) -> str:
    return "(" + " + ".join(count(col, r.pattern) for r in rule_list) + ")"


def contains_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def contains_count(col: str, words) -> str:
    return "(" + " + ".join(f"contains({col}, {lit(w)})::INT" for w in words) + ")"


def brand(brands) -> str:
    return r"\b(" + "|".join(brands) + r")\b"


def prepared(view: str, key: str = "msg_id") -> str:
    """m: key, text, t (stripped), a (accents mapped), low, urls, words."""
    t = STRIP.format("text")
    return rf"""m AS (
  SELECT *, lower(a) AS low, regexp_extract_all(t, {lit('(?i)' + URL)}) AS urls, regexp_extract_all(t, '\S+') AS words,
    greatest(length(t), 1) AS n FROM (
    SELECT {key}, text, {t} AS t, {ASCII.format(t)} AS a FROM {view}))"""


def split_hosts(source: str, suffixes, key: str = "url_id") -> str:
    """split: key, subdomain, domain, suffix of the URLs of ``source``."""
    return rf"""hosts AS (SELECT {key}, lower(regexp_replace(regexp_replace(
    regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), '^.*@', ''), ':.*$', '')) AS host FROM {source}),
listed AS (SELECT unnest({_q(suffixes)}) AS suffix),
best AS (SELECT {key}, host, CASE WHEN regexp_full_match(host, '[0-9.]+') THEN ''
    ELSE coalesce((SELECT max_by(suffix, length(suffix)) FROM listed
                   WHERE host = suffix OR ends_with(host, '.' || suffix)), '') END AS suffix FROM hosts),
rest AS (SELECT {key}, host, suffix, CASE WHEN regexp_full_match(host, '[0-9.]+') THEN NULL
    WHEN suffix = '' THEN host ELSE substring(host, 1, length(host) - length(suffix) - 1) END AS front FROM best),
split AS (SELECT {key}, suffix, coalesce(regexp_extract(front, '([^.]*)$', 1), host) AS domain,
    CASE WHEN contains(coalesce(front, ''), '.') THEN regexp_replace(front, '\.[^.]*$', '') ELSE '' END AS subdomain FROM rest)"""


def text_features() -> dict[str, str]:
    fams = {n: family("a", r) for n, r in rules.EXTRACTOR_FAMILIES.items()}
    w = "greatest(len(words), 1)"
    out = {
        "text_length": "length(t)", "word_count": "len(words)", "url_count": "len(urls)",
        "email_count": count("t", EMAIL), "phone_count": count("t", PHONE),
        "has_url": "(len(urls) > 0)::INT", "has_email": f"({count('t', EMAIL)} > 0)::INT",
        "has_phone": f"({count('t', PHONE)} > 0)::INT",
    }
    out |= {f"{n}_score": sql for n, sql in fams.items()}
    out |= {
        "uppercase_ratio": r"len(regexp_extract_all(t, '\p{Lu}')) / n",
        "exclamation_count": "len(regexp_extract_all(t, '!'))",
        "question_count": r"len(regexp_extract_all(t, '\?'))",
        "punctuation_ratio": "len(regexp_extract_all(t, '[.,!?;:]')) / n",
        "avg_word_length": f"coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) / {w}",
        "short_word_ratio": f"len(list_filter(words, lambda w: length(w) <= 3)) / {w}",
        "long_word_ratio": f"len(list_filter(words, lambda w: length(w) >= 10)) / {w}",
        "all_caps_word_count": r"len(list_filter(words, lambda w: length(w) > 1 AND regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '\p{Ll}')))",
        "capitalized_word_ratio": rf"len(list_filter(words, lambda w: regexp_matches(w, '^\p{{Lu}}'))) / {w}",
        "has_currency": "regexp_matches(t, '[$£€¥]')::INT", "has_percentage": r"regexp_matches(t, '\d+%')::INT",
        "digit_ratio": r"len(regexp_extract_all(t, '\d')) / n",
        "phishing_indicator_score": f"{fams['urgency']} * 0.2::DOUBLE + {fams['threat']} * 0.25::DOUBLE + {fams['credential']} * 0.25::DOUBLE"
        f" + {fams['action']} * 0.15::DOUBLE + {fams['impersonation']} * 0.15::DOUBLE",
    }
    return out


def rounded(columns: dict[str, str], names=None, prefix: str = "") -> str:
    return ",\n  ".join(f"round(({columns[n]})::DOUBLE, 9) AS {prefix}{n}" for n in (names or columns))


def url_parts(source: str = "urls") -> str:
    return rf"""parts AS (SELECT url_id, url, lower(url) AS lowu, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
  regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS netloc,
  regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
  regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM {source})"""


ENTROPY = r"""chars AS (SELECT url_id, kind, n, unnest(regexp_extract_all(lower(s), '(?s).')) AS ch FROM (
    SELECT url_id, 'domain' AS kind, domain AS s, length(domain) AS n FROM split
    UNION ALL SELECT url_id, 'url', url, length(url) FROM parts)),
entropies AS (SELECT url_id, kind, sum(c / n * log2(n / c)) AS e FROM (
    SELECT url_id, kind, n, ch, count(*)::DOUBLE AS c FROM chars GROUP BY ALL) GROUP BY ALL)"""


def url_features() -> dict[str, str]:
    q = r"list_filter(string_split(query, '&'), lambda p: regexp_matches(p, '^[^=]*=.'))"
    return {
        "url_length": "length(url)", "domain_length": "length(netloc)", "path_length": "length(path)",
        "subdomain_count": "CASE WHEN subdomain = '' THEN 0 ELSE len(string_split(subdomain, '.')) END",
        "path_depth": "len(list_filter(string_split(path, '/'), lambda s: s <> ''))",
        "query_param_count": f"len(list_distinct(list_transform({q}, lambda p: string_split(p, '=')[1])))",
        "digit_count": r"len(regexp_extract_all(url, '\d'))",
        "special_char_count": "len(regexp_extract_all(url, '[^A-Za-z0-9:/.]'))",
        "digit_ratio": r"len(regexp_extract_all(url, '\d')) / length(url)",
        "has_https": "(scheme = 'https')::INT", "has_http": "(scheme = 'http')::INT",
        "has_ip_address": r"(regexp_matches(netloc, '^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}') OR regexp_matches(netloc, '^[0-9a-fA-F]'))::INT",
        "has_at_symbol": "contains(url, '@')::INT", "has_double_slash": "contains(path, '//')::INT",
        "has_hexadecimal": "regexp_matches(url, '%[0-9a-fA-F][0-9a-fA-F]')::INT",
        "suspicious_tld": "(suffix IN (" + ", ".join(f"'{x}'" for x in rules.EXTRACTOR_SUSPICIOUS_TLDS) + "))::INT",
        "tld_length": "length(suffix)",
        "has_brand_name": has("url", brand(rules.EXTRACTOR_BRANDS)) + "::INT",
        "suspicious_keyword_count": contains_count("lowu", rules.EXTRACTOR_URL_KEYWORDS),
        "is_shortened": contains_any("lowu", rules.EXTRACTOR_SHORTENERS) + "::INT",
        "domain_entropy": "coalesce(d.e, 0)", "url_entropy": "coalesce(u.e, 0)",
        "has_hyphen_in_domain": "contains(domain, '-')::INT",
        "consecutive_digits": r"coalesce(list_max(list_transform(regexp_extract_all(domain, '\d+'), lambda r: length(r))), 0)",
    }


URL_FROM = """FROM parts JOIN split USING (url_id)
LEFT JOIN entropies d ON d.url_id = parts.url_id AND d.kind = 'domain'
LEFT JOIN entropies u ON u.url_id = parts.url_id AND u.kind = 'url'"""


def detector(suffixes=DETECTOR_SUFFIXES, ml: str = "0.5::DOUBLE", transformer: str = "0.5::DOUBLE", rule_set: RuleSet = DEFAULT) -> str:
    """CTEs after ``m``: per-URL results (ua), brand (b), rule counts (rc) and everything joined (d)."""
    short = {"urgency": "urg", "credential": "cred", "financial": "fin", "phrases": "phr"}
    fams = [(short.get(f.name, f.name), f) for f in rule_set.families]
    counts = ", ".join(f"{family('a', f.rules) if f.rules else contains_count('low', f.phrases)} AS {n}" for n, f in fams)
    sums = " + ".join(f"least({f.cap}::DOUBLE, {n} * {f.weight}::DOUBLE)" for n, f in fams)
    found = ", ".join(f"CASE WHEN {n} > 0 THEN {lit(f.label + ' (')} || {n} || '{' patterns' if f.rules else ''})' END" for n, f in fams)
    tlds = ", ".join(f"'{x}'" for x in rule_set.tlds)
    return rf"""u AS (SELECT msg_id, unnest(urls) AS url, generate_subscripts(urls, 1) AS i FROM m),
du AS (SELECT DISTINCT url FROM u),
{split_hosts('du', suffixes, 'url')},
flags AS (SELECT msg_id, i, u.url, domain || '.' || suffix AS registered, suffix IN ({tlds}) AS tld, suffix,
    regexp_matches(u.url, '^https?://\d+\.\d+\.\d+\.\d+') AS ip, {has('subdomain', brand(rule_set.brands))} AS sub,
    {contains_any('lower(u.url)', rule_set.shorteners)} AS short, contains(u.url, '@') AS at_sign,
    length(u.url) - length(replace(u.url, '.', '')) > 4 AS dots,
    {contains_count('lower(u.url)', rule_set.url_keywords)} AS kw
  FROM u JOIN split ON u.url = split.url),
ua AS (SELECT *, 0::DOUBLE + ip::INT * 0.4::DOUBLE + tld::INT * 0.3::DOUBLE + sub::INT * 0.3::DOUBLE + short::INT * 0.2::DOUBLE
    + at_sign::INT * 0.4::DOUBLE + dots::INT * 0.2::DOUBLE + (kw >= 2)::INT * 0.2::DOUBLE AS raw,
    concat_ws('; ', CASE WHEN ip THEN {lit(rules.REASON_IP)} END, CASE WHEN tld THEN {lit(rules.REASON_TLD)} || suffix END,
      CASE WHEN sub THEN {lit(rules.REASON_BRAND)} END, CASE WHEN short THEN {lit(rules.REASON_SHORTENER)} END,
      CASE WHEN at_sign THEN {lit(rules.REASON_AT)} END, CASE WHEN dots THEN {lit(rules.REASON_DOTS)} END,
      CASE WHEN kw >= 2 THEN {lit(rules.REASON_KEYWORDS + ' (')} || kw || ')' END) AS reasons FROM flags),
um AS (SELECT msg_id, max(least(raw, 1)) AS url_score, bool_and(raw >= 0.3::DOUBLE) AS all_bad, bool_or(raw >= 0.3::DOUBLE) AS any_bad,
    bool_or(short) AS any_short, list(DISTINCT {lit(rules.INDICATOR_DOMAIN)} || registered) FILTER (tld) AS domains FROM ua GROUP BY msg_id),
mentions AS (SELECT msg_id, unnest(regexp_extract_all(low || ' ' || lower(array_to_string(urls, ' ')), {lit(brand(rule_set.brands))})) AS brand FROM m),
mc AS (SELECT msg_id, brand, count(*) AS c FROM mentions GROUP BY msg_id, brand),
tb AS (SELECT msg_id, brand FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY c DESC, brand) AS r FROM mc) WHERE r = 1),
b AS (SELECT tb.msg_id, tb.brand, coalesce(bool_or(NOT contains(lower(registered), tb.brand)), false) AS hit
  FROM tb LEFT JOIN flags USING (msg_id) GROUP BY tb.msg_id, tb.brand),
rc AS (SELECT msg_id, {counts} FROM m),
rs AS (SELECT *, least(1, {sums}) AS rule_score, list_filter([{found}], lambda x: x IS NOT NULL) AS found FROM rc),
j AS (SELECT m.msg_id, t, length(t) < 3 AS skip, urls, rule_score, found, coalesce(url_score, 0) AS url_score,
    coalesce(all_bad, false) AS all_bad, coalesce(any_bad, false) AS any_bad, coalesce(hit, false) AS hit, brand,
    list_sort(list_distinct(list_concat(list_concat(found, coalesce(domains, [])), list_filter([
      CASE WHEN coalesce(hit, false) THEN 'Possible ' || brand || ' impersonation detected' END,
      CASE WHEN coalesce(any_short, false) THEN {lit(rules.INDICATOR_SHORTENER)} END], lambda x: x IS NOT NULL)))) AS ind,
    CASE WHEN (starts_with(t, 'http://') OR starts_with(t, 'https://')) AND len(words) <= 3 THEN 'url'
      WHEN length(t) < 500 AND regexp_matches(low, '\b(txt|sms|text me)\b|\b(click link|tap here)\b') THEN 'sms' ELSE 'email' END AS scan
  FROM m JOIN rs USING (msg_id) LEFT JOIN um USING (msg_id) LEFT JOIN b USING (msg_id)),
d AS (SELECT *, CASE WHEN skip THEN 'NONE' WHEN score >= 0.85 OR len(ind) >= 5 THEN 'CRITICAL' WHEN score >= 0.7 OR len(ind) >= 3 THEN 'HIGH'
    WHEN score >= 0.5 OR len(ind) >= 2 THEN 'MEDIUM' WHEN score >= 0.3 OR len(ind) >= 1 THEN 'LOW' ELSE 'NONE' END AS level,
    CASE WHEN skip THEN 'NONE' WHEN scan = 'url' OR all_bad THEN 'URL' WHEN scan = 'sms' THEN 'SMS' ELSE 'EMAIL' END AS ptype FROM (
  SELECT *, least(1, CASE WHEN (ml > 0.6::DOUBLE)::INT + (tr > 0.6::DOUBLE)::INT + (rule_score > 0.3::DOUBLE)::INT + (url_score > 0.3::DOUBLE)::INT + hit::INT >= 3 THEN base * 1.2::DOUBLE ELSE base END) AS score FROM (
    SELECT *, 0.3::DOUBLE * ml + 0.25::DOUBLE * rule_score + 0.2::DOUBLE * url_score + 0.1::DOUBLE * (hit::INT * 0.8::DOUBLE) + 0.15::DOUBLE * tr AS base FROM (SELECT *, {ml} AS ml, {transformer} AS tr FROM j))))"""


def threat() -> str:
    """CTEs after ``m``: category hits (cat) and loose-URL risk (risk)."""
    cats = ",\n    ".join(
        f"list_filter([{', '.join(f'CASE WHEN {has(chr(97), r.pattern)} THEN {lit(r.pattern)} END' for r in fam)}], lambda x: x IS NOT NULL) AS {name}"
        for name, fam in rules.THREAT_CATEGORIES.items()
    )
    names = list(rules.THREAT_CATEGORIES)
    hits = " + ".join(f"(len({n}) > 0)::INT" for n in names)
    notes = ", ".join(f"CASE WHEN len({n}) > 0 THEN '{n}: ' || len({n}) || ' matches' END" for n in names)
    return rf"""cat AS (SELECT *, {hits} AS n_cat, concat_ws('; ', {notes}) AS cat_notes,
    CASE WHEN len(phishing_keywords) > 0 THEN 'PHISHING' WHEN len(scam_indicators) > 0 THEN 'SCAM'
      WHEN len(social_engineering) > 0 THEN 'SOCIAL_ENGINEERING' WHEN len(malware_indicators) > 0 THEN 'MALWARE' ELSE 'UNKNOWN' END AS first_type
  FROM (SELECT msg_id, {cats} FROM m)),
lu AS (SELECT msg_id, unnest(l) AS url, generate_subscripts(l, 1) AS i FROM (
    SELECT msg_id, regexp_extract_all(text, {lit(LOOSE_URL)}) AS l FROM m)),
lf AS (SELECT *, regexp_matches(url, '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') AS ip, regexp_matches(lower(url), '\.(tk|ml|ga|cf|gq)') AS tld,
    contains(url, '@') AS at_sign, length(url) - length(replace(url, '.', '')) > 4 AS dots, regexp_matches(lower(url), '(bit\.ly|tinyurl|goo\.gl|ow\.ly)') AS short FROM lu),
risk AS (SELECT msg_id, count(*) AS url_count, string_agg(url, '|' ORDER BY i) FILTER (i <= 5) AS first_urls,
    least(1, sum(ip::INT * 0.3::DOUBLE + tld::INT * 0.4::DOUBLE + at_sign::INT * 0.5::DOUBLE + dots::INT * 0.2::DOUBLE + short::INT * 0.3::DOUBLE)) AS risk_score,
    string_agg(nullif(concat_ws('; ', CASE WHEN ip THEN 'IP address in URL' END, CASE WHEN tld THEN 'Suspicious TLD' END,
      CASE WHEN at_sign THEN '@ symbol in URL' END, CASE WHEN dots THEN 'Excessive subdomains' END, CASE WHEN short THEN 'URL shortener' END), ''), '; ' ORDER BY i) AS notes
  FROM lf GROUP BY msg_id),
st AS (SELECT msg_id, length(text) AS length, len(regexp_extract_all(text, '\S+')) AS word_count,
    len(regexp_extract_all(text, '\p{{Lu}}')) / length(text) AS uppercase_ratio, len(regexp_extract_all(text, '\d')) / length(text) AS digit_ratio,
    len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\s]')) / length(text) AS special_char_ratio,
    len(regexp_extract_all(text, '!')) AS exclamation_count, len(regexp_extract_all(text, '\?')) AS question_count,
    len(regexp_extract_all(text, '[$£€¥]')) AS currency_count, len(regexp_extract_all(text, '\S+@\S+')) AS email_count,
    len(regexp_extract_all(a, '\b\d{{10,}}\b')) AS phone_count FROM m),
sus AS (SELECT *, (uppercase_ratio > 0.3::DOUBLE)::INT * 0.2::DOUBLE + (exclamation_count > 3)::INT * 0.2::DOUBLE + (currency_count > 0)::INT * 0.1::DOUBLE
    + (special_char_ratio > 0.2::DOUBLE)::INT * 0.1::DOUBLE AS suspicion_score FROM st)"""
