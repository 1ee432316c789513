"""Message, URL, feed and score views over the given tables.

Each view is a pure function of whole tables: every row and every character
takes part.  ``SQL`` holds the same definitions as CTE text for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.operators import dataset as ds
from threatloom.session import spread, table

# Our own phrases: 0-9 threat-like, 10-14 benign
PHRASES = (
    "URGENT! Your account suspended, verify your account today",
    "You are a WINNER! Claim your prize of $500 now",
    "Urgent: please confirm your account and verify your account at http://paypal.secure-login.tk/verify",
    "Dear customer, click here http://192.168.1.1/login or http://www.example.com/google",
    "amazon refund: visit https://bit.ly/a1b2",
    "Send bitcoin within 2 hours or a wire transfer today!!!!",
    "txt WIN to claim, call 0123456789012",
    "Buy a gift card for the director, urgent; enter your pin",
    "download the file now setup.exe",
    "http://user@evil.example.com/a//b%20c?x=1&x=2&y=",
    "Are we still on for lunch",
    "The report is attached for review",
    "Write to jane.doe@example.org or call 555-123-4567",
    "See https://www.example.com/docs/page on Google and microsoft",
    "Discount is 20% on Friday? See https://www.spotify.com/offers",
)
PAYLOADS = (
    "' OR '1'='1", "x'; DROP TABLE t", "1 union select 2", "<ScRiPt>alert(1)</sCrIpT>",
    "javascript:void(0)", "a; cat /etc/passwd", "a && ls", "b | whoami", "../../x", "..\\x", "plain words", "",
)
EXTENSIONS = (".exe", ".txt", ".EXE", ".scr", ".pdf")
RAW_LABELS = ("spam", "ham", "phishing", "legitimate", "Smishing ", "safe", "promo")
SUFFIXES = ("com", "net", "org", "co.uk", "tk", "xyz", "top", "ru", "at", "ly", "gd")
# Suffix rules of the detector queries; the library takes them as an input and has no default
DETECTOR_SUFFIXES = (
    "com", "net", "org", "edu", "gov", "mil", "int", "io", "co", "ai", "app", "dev",
    "biz", "me", "tv", "us", "uk", "de", "fr", "es", "it", "nl", "eu", "ch", "at",
    "be", "se", "no", "dk", "fi", "pl", "ru", "ua", "cn", "jp", "in", "br", "au", "ca",
    "ly", "gd", "gl", "gy", "mp", "im", "gs", "to",
    "tk", "ml", "ga", "cf", "gq", "xyz", "top", "work", "click", "link", "info", "online",
    "site", "website", "space", "pw", "cc", "su", "buzz", "fit", "loan", "download", "stream",
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp",
    "co.in", "com.br", "com.cn", "co.nz", "co.za",
)
# With both special kinds of rules: any label above example.com or example.org but www is a suffix of its own
RULE_SUFFIXES = (*SUFFIXES, "*.example.com", "!www.example.com", "*.uk", "!shop.co.uk")


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def hash_int(c: Column, digits: int = 8) -> Column:
    """Leading hex digits of md5 as BIGINT."""
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document behind one of the phrases, with label, source and time."""
    d, n = documents(spark, folder), F.col("doc_id")
    return d.select(
        n.alias("msg_id"),
        F.concat_ws(" ", pick(PHRASES, n % 15), "text").alias("text"),
        F.when(n % 15 < 10, 1).otherwise(0).alias("label"),
        pick(("sms", "email", "url"), n % 3).alias("source"),
        (F.lit("2024-01-01 00:00:00+00:00").cast("timestamp") + F.make_interval(hours=n.cast("int"))).alias("ts"),
    )


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Messages plus one two-letter message per document (the language code)."""
    short = documents(spark, folder).select((-F.col("doc_id") - 1).alias("msg_id"), F.col("lang").alias("text"))
    return messages(spark, folder).select("msg_id", "text").unionByName(short)


def urls(spark: SparkSession, folder: str) -> DataFrame:
    """Every page URL, and for every page one URL of an eight-fold set of shapes."""
    p = spread(table(spark, folder, "pages").select("page_id", "url"), "page_id")
    i = F.col("page_id")
    s = i.cast("string")
    shaped = pick_column(i % 8, [
        F.concat(F.col("url"), F.lit("&q="), s),
        F.concat(F.lit("http://192.168.0.1/x"), s),
        F.concat(F.lit("https://paypal.login.xyz/"), s),
        F.concat(F.lit("http://a.b.c.d.e.example.com/"), s),
        F.concat(F.lit("http://u@h.co.uk:8080/p/q"), s),
        F.concat(F.lit("https://bit.ly/Zz"), s),
        F.concat(F.lit("http://shop-12345.top/%20a?k=v&k=w&z=&p="), s),
        F.concat(F.lit("HTTPS://Face.example.net//dd"), s),
    ])
    both = F.array(F.struct((i * 2).alias("url_id"), F.col("url").alias("url")),
                   F.struct((i * 2 + 1).alias("url_id"), shaped.alias("url")))
    return p.select(F.inline(both))


def pick_column(index: Column, choices: list[Column]) -> Column:
    out = None
    for k, c in enumerate(choices):
        out = F.when(index == k, c) if out is None else out.when(index == k, c)
    return out


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled feed rows of four sources in ingest order; one label is unknown, one needs tidying."""
    d, n = documents(spark, folder), F.col("doc_id")
    src = [s for s, _, _ in rules.FEED_SOURCES]
    kinds = [k for _, k, _ in rules.FEED_SOURCES]
    return d.select(
        F.col("doc_id"), F.col("text"),
        pick(RAW_LABELS, n % 7).alias("label"),
        pick(src, n % 4).alias("source"),
        pick(kinds, n % 4).alias("content_type"),
        ds.ingest_order(n % 4, n).alias("order"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The aggregated feed with a unique key (the ingest order)."""
    return ds.aggregate_feeds(feed(spark, folder)).select(
        F.col("order").alias("key"), "text", "label", "source", "content_type"
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a class label from the ``labels`` table: toxic is the rare class."""
    l = table(spark, folder, "labels").select("doc_id", "toxic")
    return documents(spark, folder).join(l, "doc_id").select(
        F.col("doc_id").alias("key"), "text",
        F.when(F.col("toxic") == 1, rules.POSITIVE).otherwise(rules.NEGATIVE).alias("label"),
        "source", F.lit("text").alias("content_type"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """msg_id, label, score with deliberate ties, prediction at 0.5."""
    return with_scores(messages(spark, folder).select("msg_id", "label"))


def with_scores(m: DataFrame) -> DataFrame:
    score = (hash_int(F.col("msg_id").cast("string")) % 1000 + F.col("label") * 300) / 1300.0
    return m.withColumns({"score": score}).withColumns({"prediction": (F.col("score") >= 0.5).cast("int")})


def phish_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Raw phish rows over the URLs; some fields missing, one URL in nine empty."""
    u, i = urls(spark, folder), F.col("url_id")
    s = i.cast("string")
    return u.select(
        i.alias("seq"),
        F.when(i % 9 == 4, "").otherwise(F.col("url")).alias("url"),
        s.alias("phish_id"),
        F.concat(F.lit("https://example.org/phish/"), s).alias("phish_detail_url"),
        F.lit("2024-01-01T00:00:00").alias("submission_time"),
        F.when(i % 3 != 0, "yes").when(i % 2 == 0, "no").alias("verified"),
        F.when(i % 3 != 0, "2024-01-02T00:00:00").alias("verification_time"),
        F.when(i % 5 != 0, "yes").alias("online"),
        F.when(i % 4 != 0, "Other").alias("target"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: text bytes, or 512 hash bytes for every third one."""
    d, n = documents(spark, folder), F.col("doc_id")
    packed = F.unhex(F.concat(*[F.md5(F.concat("text", F.lit(f"|{i}"))) for i in range(32)]))
    return d.select(
        "doc_id",
        F.concat(F.lit("doc_"), n.cast("string"), pick(EXTENSIONS, n % 5)).alias("path"),
        F.when(n % 3 == 0, packed).otherwise(F.encode("text", "UTF-8")).alias("content"),
    )


def known_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of the benchmark texts and of one document source."""
    b = table(spark, folder, "benchmark").select("text")
    d = documents(spark, folder).filter(F.col("source") == "src7").select("text")
    return b.unionByName(d).select(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


def dialogue_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn behind a phrase, with a label."""
    c, n = spread(table(spark, folder, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn"), F.col("conv_id")
    return c.select(
        F.concat_ws("-", n.cast("string"), F.col("turn").cast("string")).alias("talk_id"),
        F.concat_ws(" ", pick(PHRASES, n % 15), "text").alias("dialogue"),
        F.when(n % 15 < 10, 1).otherwise(0).alias("label"),
    )


# ---------------------------------------------------------------------------
# The same views as SQL
# ---------------------------------------------------------------------------
def _q(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL = {
    "messages": f"""messages AS (
  SELECT doc_id AS msg_id, ({_q(PHRASES)})[doc_id % 15 + 1] || ' ' || text AS text,
         CASE WHEN doc_id % 15 < 10 THEN 1 ELSE 0 END AS label,
         (['sms', 'email', 'url'])[doc_id % 3 + 1] AS source,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS ts
  FROM documents)""",
    "inbox": """inbox AS (
  SELECT msg_id, text FROM messages UNION ALL SELECT -doc_id - 1, lang FROM documents)""",
    "urls": """urls AS (
  SELECT page_id * 2 AS url_id, url FROM pages
  UNION ALL
  SELECT page_id * 2 + 1, CASE page_id % 8
    WHEN 0 THEN url || '&q=' || page_id
    WHEN 1 THEN 'http://192.168.0.1/x' || page_id
    WHEN 2 THEN 'https://paypal.login.xyz/' || page_id
    WHEN 3 THEN 'http://a.b.c.d.e.example.com/' || page_id
    WHEN 4 THEN 'http://u@h.co.uk:8080/p/q' || page_id
    WHEN 5 THEN 'https://bit.ly/Zz' || page_id
    WHEN 6 THEN 'http://shop-12345.top/%20a?k=v&k=w&z=&p=' || page_id
    ELSE 'HTTPS://Face.example.net//dd' || page_id END
  FROM pages)""",
    "feed": f"""feed AS (
  SELECT doc_id, text, ({_q(RAW_LABELS)})[doc_id % 7 + 1] AS label,
         ({_q([s for s, _, _ in rules.FEED_SOURCES])})[doc_id % 4 + 1] AS source,
         ({_q([k for _, k, _ in rules.FEED_SOURCES])})[doc_id % 4 + 1] AS content_type,
         (doc_id % 4) * 72057594037927936 + doc_id AS ord
  FROM documents)""",
    "records": r"""seen AS (
  SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped FROM feed),
firsts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(stripped) ORDER BY ord) AS rn
    FROM seen WHERE stripped <> '') WHERE rn = 1),
records AS (
  SELECT ord AS key, stripped AS text,
         CASE WHEN lower(trim(label)) IN ('phishing', 'spam', 'smishing', 'scam', 'malicious') THEN 'phishing'
              ELSE 'legitimate' END AS label, source, content_type
  FROM firsts
  WHERE lower(trim(label)) IN ('phishing', 'spam', 'smishing', 'scam', 'malicious',
                               'legitimate', 'ham', 'safe', 'benign'))""",
    "labelled": """labelled AS (
  SELECT doc_id AS key, text, CASE WHEN toxic = 1 THEN 'phishing' ELSE 'legitimate' END AS label,
         source, 'text' AS content_type
  FROM documents JOIN labels USING (doc_id))""",
    "scores": """scores AS (
  SELECT msg_id, label, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM (
    SELECT msg_id, label,
           (('0x' || substr(md5(msg_id::VARCHAR), 1, 8))::BIGINT % 1000 + label * 300)::DOUBLE / 1300.0::DOUBLE AS score
    FROM messages))""",
    "phish_feed": """phish_feed AS (
  SELECT url_id AS seq, CASE WHEN url_id % 9 = 4 THEN '' ELSE url END AS url, url_id::VARCHAR AS phish_id,
         'https://example.org/phish/' || url_id AS phish_detail_url, '2024-01-01T00:00:00' AS submission_time,
         CASE WHEN url_id % 3 <> 0 THEN 'yes' WHEN url_id % 2 = 0 THEN 'no' END AS verified,
         CASE WHEN url_id % 3 <> 0 THEN '2024-01-02T00:00:00' END AS verification_time,
         CASE WHEN url_id % 5 <> 0 THEN 'yes' END AS online,
         CASE WHEN url_id % 4 <> 0 THEN 'Other' END AS target
  FROM urls)""",
    "dialogues": f"""dialogues AS (
  SELECT conv_id || '-' || turn AS talk_id, ({_q(PHRASES)})[conv_id % 15 + 1] || ' ' || text AS dialogue,
         CASE WHEN conv_id % 15 < 10 THEN 1 ELSE 0 END AS label FROM conversations)""",
}
_NEEDS = {"inbox": ("messages",), "records": ("feed",), "scores": ("messages",), "phish_feed": ("urls",)}


def with_views(body: str, *names: str) -> str:
    """Prefix a SELECT with the views it reads."""
    ordered: list[str] = []
    for n in names:
        for m in (*_NEEDS.get(n, ()), n):
            if m not in ordered:
                ordered.append(m)
    return "WITH " + ",\n".join(SQL[n] for n in ordered) + ("\n" if body.lstrip().startswith("SELECT") else ",\n") + body.lstrip()
