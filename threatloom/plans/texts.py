"""Queries over text and URL scalar functions and feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import sql as fs
from threatloom.functions import text as tx
from threatloom.functions import url as ux
from threatloom.operators import features as fe
from threatloom.operators import phishing as ph
from threatloom.operators import terms as tm
from threatloom.plans import fixtures as fx
from threatloom.plans import sqltext as sq
from threatloom.plans.fixtures import with_views
from threatloom.plans.registry import registry
from threatloom.session import spread, table

QUERIES, ORACLES, query = registry()


STOP_WORDS = ("the", "of", "and", "in", "on", "at", "to", "is", "are", "an", "by", "with", "was", "that", "your", "you")
CLEAN_SQL = r"""cleaned AS (SELECT msg_id, label, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
  'http\S+|www\S+', '', 'g'), '\S+@\S+', '', 'g'), '\b\d{10,}\b', '', 'g'), '[^a-zA-Z\s]', '', 'g'), '\s+', ' ', 'g')) AS cleaned FROM messages)"""


def _stems_sql() -> str:
    """stems: word, stem of ``words``."""
    out = "(SELECT word, word AS w FROM words)"
    for step in tm.stem_steps("regexp_matches({0}, '{1}')", "\\1", ", 'g'"):
        out = f"(SELECT word, {step} AS w FROM {out})"
    return f"stems AS (SELECT word, w AS stem FROM {out})"


STEMS_SQL = _stems_sql()


def long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def round9(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 9) for n in names})


# ------------------------------------------------------------------ cleaning and tokens
@query(with_views(CLEAN_SQL + " SELECT msg_id, cleaned FROM cleaned", "messages"))
def txt_clean(spark: SparkSession, folder: str) -> DataFrame:
    return fx.messages(spark, folder).select("msg_id", tx.clean(F.col("text")).alias("cleaned"))


@query(with_views(CLEAN_SQL + f""" SELECT msg_id, array_to_string(list_filter(string_split(cleaned, ' '),
  lambda w: w NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})), ' ') AS kept FROM cleaned""", "messages"))
def txt_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    c = fx.messages(spark, folder).select("msg_id", tx.clean(F.col("text")).alias("cleaned"))
    return c.select("msg_id", tx.drop_stop_words(F.col("cleaned"), STOP_WORDS).alias("kept"))


@query(with_views(CLEAN_SQL + """,
words AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(cleaned, ' ')) AS word FROM cleaned) WHERE word <> ''),
""" + STEMS_SQL + " SELECT word, stem FROM stems", "messages"))
def txt_stem_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct cleaned words and their stems."""
    words = fx.messages(spark, folder).select(F.explode(F.split(tx.clean(F.col("text")), " ")).alias("word"))
    return tm.stem_vocabulary(words.filter(F.col("word") != ""))


@query(with_views(r"""SELECT msg_id, len(regexp_extract_all(text, '\S+')) AS word_count,
  len(regexp_extract_all(text, '\S')) AS word_chars FROM inbox""", "inbox"))
def txt_word_stats(spark: SparkSession, folder: str) -> DataFrame:
    w = fx.inbox(spark, folder).select("msg_id", tx.words(F.col("text")).alias("w"))
    chars = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))
    return long(w.select("msg_id", F.size("w").alias("word_count"), chars.alias("word_chars")), "word_count", "word_chars")


@query(with_views(CLEAN_SQL + r""", k AS (SELECT msg_id, regexp_extract_all(cleaned, '\b\w\w+\b') AS t FROM cleaned)
SELECT msg_id, len(t) AS unigrams, greatest(len(t) - 1, 0) AS bigrams, greatest(len(t) - 2, 0) AS trigrams,
  md5(array_to_string(list_concat(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])),
    list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])), '|')) AS terms_md5 FROM k""", "messages"))
def txt_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    m = fx.messages(spark, folder).select("msg_id", tx.model_tokens(tx.clean(F.col("text"))).alias("tok"))
    g = m.select("msg_id", "tok", tx.ngrams(F.col("tok"), 1, 3).alias("terms"))
    n = F.size("tok").cast("long")
    zero = F.lit(0).cast("long")
    return g.select(
        "msg_id", n.alias("unigrams"), F.greatest(n - 1, zero).alias("bigrams"), F.greatest(n - 2, zero).alias("trigrams"),
        F.md5(F.array_join("terms", "|")).alias("terms_md5"),
    )


@query(with_views("SELECT msg_id, strip_accents(lower(text)) AS plain FROM messages", "messages"))
def txt_strip_accents(spark: SparkSession, folder: str) -> DataFrame:
    return fx.messages(spark, folder).select("msg_id", tx.strip_accents(F.col("text")).alias("plain"))


def _with_html(spark: SparkSession, folder: str) -> DataFrame:
    html = spread(table(spark, folder, "pages").select((-F.col("page_id") - 1).alias("msg_id"), F.col("html").alias("text")), "msg_id")
    return fx.messages(spark, folder).select("msg_id", "text").unionByName(html)


_WITH_HTML = "texts AS (SELECT msg_id, text FROM messages UNION ALL SELECT -page_id - 1, html FROM pages)"


def _urls_sql(pattern: str) -> str:
    return with_views(_WITH_HTML + rf""" SELECT msg_id, len(l) AS n, array_to_string(l, '|') AS urls FROM (
  SELECT msg_id, regexp_extract_all(text, {sq.lit(pattern)}) AS l FROM texts)""", "messages")


@query(_urls_sql("(?i)" + sq.URL))
def txt_extract_urls(spark: SparkSession, folder: str) -> DataFrame:
    u = _with_html(spark, folder).select("msg_id", tx.extract_urls(F.col("text")).alias("l"))
    return u.select("msg_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("urls"))


@query(_urls_sql(sq.LOOSE_URL))
def txt_extract_urls_loose(spark: SparkSession, folder: str) -> DataFrame:
    u = _with_html(spark, folder).select("msg_id", tx.extract_urls_loose(F.col("text")).alias("l"))
    return u.select("msg_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("urls"))


@query(with_views(sq.prepared("messages") + rf""" SELECT msg_id, {sq.count('t', sq.EMAIL)} AS emails, {sq.count('t', sq.PHONE)} AS phones,
  len(regexp_extract_all(t, '\S+@\S+')) AS at_tokens, len(regexp_extract_all(a, '\b\d{{10,}}\b')) AS long_numbers FROM m""", "messages"))
def txt_contact_counts(spark: SparkSession, folder: str) -> DataFrame:
    m = fx.messages(spark, folder).select("msg_id", tx.strip(F.col("text")).alias("t"))
    t = F.col("t")
    out = m.select(
        "msg_id", tx.email_count(tx.fold(t)).alias("emails"), tx.phone_count(t).alias("phones"),
        tx.at_token_count(t).alias("at_tokens"), tx.match_count(t, tx.LONG_NUMBER_PATTERN).alias("long_numbers"),
    )
    return long(out, "emails", "phones", "at_tokens", "long_numbers")


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '^\s+|\s+$', '', 'g')) AS text_hash FROM documents")
def txt_norm_hash(spark: SparkSession, folder: str) -> DataFrame:
    return fx.documents(spark, folder).select("doc_id", tx.norm_hash(F.col("text")).alias("text_hash"))


@query(r"""WITH c AS (SELECT page_id, n, ch, count(*)::DOUBLE AS k FROM (
    SELECT page_id, length(url) AS n, unnest(string_split(lower(url), '')) AS ch FROM pages) GROUP BY ALL),
e AS (SELECT page_id, round(-sum(k / n * log2(k / n)), 9) AS entropy FROM c GROUP BY page_id)
SELECT page_id, md5(lower(trim(url))) AS text_hash, len(regexp_extract_all(url, '\S+'))::INT AS words, entropy,
  regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), ':.*$', '') AS host FROM pages JOIN e USING (page_id)""")
def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    """The functions that SQL users call, in a SQL query."""
    fs.register(spark)
    table(spark, folder, "pages").createOrReplaceTempView("threatloom_pages")
    return spark.sql("""SELECT page_id, text_norm_hash(url) AS text_hash, text_word_count(url) AS words,
        round(text_entropy(url), 9) AS entropy, url_host(url) AS host FROM threatloom_pages""")


# ------------------------------------------------------------------ feature vectors and their parts
_TEXT = sq.text_features()


def _feature_query(names: list[str], view: str = "messages"):
    sql = with_views(sq.prepared(view) + f" SELECT msg_id, {sq.rounded(_TEXT, names)} FROM m", view)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = getattr(fx, view)(spark, folder).select("msg_id", "text")
        return round9(fe.with_text_features(rows, "text"), names).select("msg_id", *names)

    return sql, run


for _name, _cols, _doc in (
    ("txt_style_ratios", ["uppercase_ratio", "punctuation_ratio", "digit_ratio", "exclamation_count", "question_count"],
     "Upper-case, punctuation and digit shares; exclamation and question marks."),
    ("txt_word_shape", ["avg_word_length", "short_word_ratio", "long_word_ratio", "all_caps_word_count", "capitalized_word_ratio"],
     "Word lengths and capitalisation."),
    ("txt_currency_percent", ["has_currency", "has_percentage"], "Currency and percentage flags."),
    ("txt_pattern_families", [f"{n}_score" for n in rules.EXTRACTOR_FAMILIES], "Match counts of the six pattern families."),
    ("txt_indicator_score", ["phishing_indicator_score"], "Weighted indicator score."),
):
    ORACLES[_name], QUERIES[_name] = _feature_query(_cols)
    QUERIES[_name].__name__, QUERIES[_name].__doc__ = _name, _doc


@query(with_views(sq.prepared("inbox") + f" SELECT msg_id, {sq.rounded(_TEXT)} FROM m", "inbox"))
def feat_text_all(spark: SparkSession, folder: str) -> DataFrame:
    """All 27 text features."""
    out = fe.with_text_features(fx.inbox(spark, folder), "text")
    return round9(out, fe.TEXT_FEATURES).drop("text")


@query(with_views(sq.prepared("inbox") + r""" SELECT msg_id, CASE WHEN (starts_with(t, 'http://') OR starts_with(t, 'https://')) AND len(words) <= 3 THEN 'url'
  WHEN length(t) < 500 AND regexp_matches(low, '\b(txt|sms|text me)\b|\b(click link|tap here)\b') THEN 'sms' ELSE 'email' END AS scan_type FROM m""", "inbox"))
def txt_scan_type(spark: SparkSession, folder: str) -> DataFrame:
    m = fx.inbox(spark, folder).withColumns({"t": tx.strip(F.col("text"))})
    return m.select("msg_id", tx.scan_type(F.col("t"), tx.fold(F.col("t"))).alias("scan_type"))


@query(with_views(sq.prepared("messages") + rf""" SELECT msg_id, length(text) AS length, len(regexp_extract_all(text, '\S+')) AS word_count,
  {sq.has('text', r'http\S+|www\S+')} AS has_url, {sq.has('text', r'\S+@\S+')} AS has_email, {sq.has('a', r'\b\d{10,}\b')} AS has_phone,
  round(len(regexp_extract_all(text, '\p{{Lu}}')) / length(text), 9) AS uppercase_ratio,
  len(regexp_extract_all(text, '!')) AS exclamation_count, len(regexp_extract_all(text, '\?')) AS question_count,
  {sq.has('text', '[$£€¥]')} AS currency_symbols, {sq.has('a', rules.EXPLAIN_URGENCY.pattern)} AS urgency_words,
  {sq.has('a', rules.EXPLAIN_SPAM.pattern)} AS spam_keywords FROM m""", "messages"))
def txt_explain_features(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    out = fx.messages(spark, folder).select("msg_id", fe.explain_features(t, tx.fold(t)).alias("e")).select("msg_id", "e.*")
    return round9(out, ["uppercase_ratio"])


@query(with_views(sq.prepared("messages") + ",\n" + sq.threat() + """ SELECT msg_id, length, word_count, round(uppercase_ratio, 9) AS uppercase_ratio,
  round(digit_ratio, 9) AS digit_ratio, round(special_char_ratio, 9) AS special_char_ratio, exclamation_count, question_count, currency_count,
  email_count, phone_count, round(suspicion_score, 9) AS suspicion_score FROM sus""", "messages"))
def txt_suspicion_score(spark: SparkSession, folder: str) -> DataFrame:
    m = fx.messages(spark, folder).select("msg_id", fe.statistics(F.col("text")).alias("s"))
    out = m.select("msg_id", "s.*", fe.suspicion(F.col("s")).alias("suspicion_score"))
    return round9(out, ["uppercase_ratio", "digit_ratio", "special_char_ratio", "suspicion_score"])


@query(with_views(sq.prepared("messages") + ",\n" + sq.detector() + f""" SELECT m.msg_id, coalesce((SELECT bool_or(tld) FROM flags f WHERE f.msg_id = m.msg_id), false) AS suspicious_urls,
  {sq.has('a', sq.brand(rules.DETECTOR_BRANDS))} AS brand_present, urg > 0 AS urgency_present FROM m JOIN rc USING (msg_id)""", "messages"))
def txt_legacy_flags(spark: SparkSession, folder: str) -> DataFrame:
    m = fx.messages(spark, folder).select("msg_id", "text").withColumns(
        {"low": tx.fold(F.col("text")), "urls": tx.extract_urls(F.col("text"))}
    )
    return m.select("msg_id", ph.legacy_flags(F.col("low"), F.col("urls"), fx.DETECTOR_SUFFIXES).alias("f")).select("msg_id", "f.*")


# ------------------------------------------------------------------ URLs
_URL_CTES = sq.split_hosts("urls", fx.SUFFIXES) + ",\n" + sq.url_parts() + ",\n" + sq.ENTROPY
_URL = sq.url_features()


@query(with_views(sq.url_parts() + " SELECT url_id, scheme, netloc, path, query, fragment FROM parts", "urls"))
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    p = fx.urls(spark, folder).select("url_id", ux.parts(F.col("url")).alias("p")).select("url_id", "p.*")
    return p.drop("valid")


def _url_query(names: list[str]):
    sql = with_views(_URL_CTES + f" SELECT parts.url_id, {sq.rounded(_URL, names)} {sq.URL_FROM}", "urls")

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = fe.with_url_features(fx.urls(spark, folder), "url", suffixes=fx.SUFFIXES)
        return round9(out, names).select("url_id", *names)

    return sql, run


for _name, _cols, _doc in (
    ("url_structure", ["url_length", "domain_length", "path_length", "subdomain_count", "path_depth", "query_param_count"],
     "Lengths, subdomains, path depth, query names."),
    ("url_characters", ["digit_count", "digit_ratio", "special_char_count", "has_hyphen_in_domain", "consecutive_digits"],
     "Digits, special characters, hyphens and digit runs."),
    ("url_security_flags", ["has_https", "has_http", "has_ip_address", "has_at_symbol", "has_double_slash", "has_hexadecimal"],
     "Scheme, IP host and obfuscation flags."),
    ("url_tld_features", ["suspicious_tld", "tld_length"], "Suffix features."),
    ("url_brand_keywords", ["has_brand_name", "suspicious_keyword_count", "is_shortened"], "Brand, keyword and shortener features."),
    ("url_entropy", ["domain_entropy", "url_entropy"], "Entropy of domain and URL."),
    ("url_features_all", fe.URL_FEATURES, "All 24 URL features."),
):
    ORACLES[_name], QUERIES[_name] = _url_query(_cols)
    QUERIES[_name].__name__, QUERIES[_name].__doc__ = _name, _doc


@query("""WITH u AS (SELECT page_id, lower(url) AS s, length(url) AS n FROM pages),
c AS (SELECT page_id, n, ch, count(*)::DOUBLE AS k FROM (SELECT page_id, n, unnest(string_split(s, '')) AS ch FROM u) GROUP BY ALL)
SELECT page_id, round(-sum(k / n * log2(k / n)), 9) AS entropy FROM c GROUP BY page_id""")
def agg_char_entropy(spark: SparkSession, folder: str) -> DataFrame:
    p = spread(table(spark, folder, "pages").select("page_id", "url"), "page_id")
    return p.select("page_id", F.round(tx.entropy(F.col("url")), 9).alias("entropy"))


@query(with_views(sq.prepared("inbox") + """,
urls AS (SELECT msg_id AS url_id, urls[1] AS url FROM m WHERE len(urls) > 0),
""" + sq.split_hosts("urls", fx.DETECTOR_SUFFIXES) + ",\n" + sq.url_parts() + ",\n" + sq.ENTROPY + f""",
uf AS (SELECT parts.url_id AS msg_id, {sq.rounded(_URL, None, 'url_')} {sq.URL_FROM})
SELECT m.msg_id, {sq.rounded(_TEXT, None, 'text_')},
  {", ".join(f"coalesce(url_{n}, 0) AS url_{n}" for n in fe.URL_FEATURES)} FROM m LEFT JOIN uf USING (msg_id)""", "inbox"))
def feat_combined(spark: SparkSession, folder: str) -> DataFrame:
    """The 51 combined features: text plus its first URL."""
    out = fe.with_combined_features(fx.inbox(spark, folder), "text", suffixes=fx.DETECTOR_SUFFIXES)
    return round9(out, fe.COMBINED_FEATURES).drop("text")
