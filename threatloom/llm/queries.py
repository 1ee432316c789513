"""The corpus operators' registered queries and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import chat, embeddings, html, infill, langid, licenses, lines, mixing, packing, pii, quality, resample, simhash
from threatloom.session import table

QUERIES, ORACLES = {}, {}
#: Path of the tokenizer file that the packing query uses.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


MIX_SQL = r"""
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS h, md5(coalesce(text, '')) AS t FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
  FROM rows GROUP BY source),
ramps AS (SELECT *, CASE i % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS a,
  CASE i % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS b FROM sources),
weighed AS (SELECT *, (i % 3 + 1)::DOUBLE * (a + b) / 2 AS w, 3 * size AS cap FROM ramps),
levels AS (SELECT *, (sum(size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT *, least(cap::DOUBLE, w * max(CASE WHEN level <= cap / w THEN level END) OVER ()) AS target FROM levels),
streams AS (SELECT r.*, t.size AS source_size, t.target, t.a, t.b, floor(t.target)::BIGINT AS words,
  coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY h, r.doc_id, r.size, r.t
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, (words // greatest(source_size, 1)) * size
  + greatest(0, least(size, words - (words // greatest(source_size, 1)) * source_size - start)) AS taken FROM streams)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN
  CASE WHEN a = b THEN start / words ELSE (sqrt(a * a + (b * b - a * a) * (start / words)) - a) / (b - a) END END AS position
FROM taken"""


@query(MIX_SQL)
def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a curriculum mix takes of every document."""
    return mixing.mix(table(spark, folder, "documents")).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "position")


@query()
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


@query()
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 4,096 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), TOKENIZER).withColumnRenamed("key", "doc_id")


@query()
def op1_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html.with_main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op4_embedding_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every embedding."""
    return embeddings.near_duplicates(table(spark, folder, "embeddings")).select(
        F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query()
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics, base check and the learned verdict of every document."""
    docs = table(spark, folder, "documents")
    rules = quality.fit_rules(docs, table(spark, folder, "labels"))
    return quality.with_verdict(docs, rules).select(
        "doc_id", *[f"stats.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed", "kept", F.col("rule").cast("bigint").alias("rule"))


@query()
def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, digest of the base spans and all spans of personal data of every document."""
    found = pii.find_personal_data(table(spark, folder, "documents"))
    return found.select(
        F.col("key").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


LINES_SQL = r"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS n FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source),
lines AS (SELECT DISTINCT source, text, unnest(string_split(text, chr(10))) AS line FROM pages),
often AS (SELECT l.source, line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY l.source, line, n HAVING count(*) >= 5 AND count(*) > 0.02 * n),
split AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
each AS (SELECT r, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split),
kept AS (SELECT e.r, string_agg(e.line, chr(10) ORDER BY i) AS text, count(*) AS n FROM each e JOIN split s ON e.r = s.r
  LEFT JOIN often o ON o.source IS NOT DISTINCT FROM s.source AND o.line = e.line WHERE o.line IS NULL GROUP BY e.r)
SELECT doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(len(parts) - coalesce(k.n, 0), 0)::BIGINT AS n_dropped FROM split s LEFT JOIN kept k ON s.r = k.r"""


@query(LINES_SQL)
def op8_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its site's boilerplate lines."""
    return lines.with_clean_lines(table(spark, folder, "documents")).select("doc_id", "text", "n_dropped")


#: Schemas of the calls that plain turns make.
TURN_SCHEMAS = [
    ("reply", '{"type":"object","required":["text","turn"],"additionalProperties":false,"properties":'
              '{"text":{"type":"string","minLength":1},"turn":{"type":"integer","minimum":0}}}'),
    ("configure", '{"type":"object","required":["text","turn"],"properties":{"turn":{"type":"integer","maximum":0}}}'),
]

CHAT_SQL = r"""
WITH RECURSIVE calls AS (SELECT conv_id AS conv, turn, conv_id || '-' || turn AS id, text,
    CASE role WHEN 'system' THEN 'configure' ELSE 'reply' END AS name FROM conversations WHERE role IN ('user', 'system')),
results AS (SELECT conv_id AS conv, turn, conv_id || '-' || (turn - 1) AS id, text FROM conversations WHERE role = 'assistant'),
chains AS (SELECT DISTINCT conv, turn, 0 AS level FROM calls
  UNION SELECT c.conv, c.turn, level + 1 FROM chains l JOIN calls c ON c.conv = l.conv AND c.turn = l.turn + 2 AND c.turn >= 2 AND c.name = 'reply'),
levels AS (SELECT conv || '-' || turn AS call, max(level) AS level FROM chains GROUP BY ALL)
SELECT conv, turn, 0 AS seq, 'call' AS kind, id,
  CASE WHEN id IN (SELECT id FROM results) THEN 'linked' ELSE 'unanswered' END AS status, level,
  CASE WHEN name = 'configure' THEN CASE WHEN turn > 0 THEN '$.turn: out of range' END
    WHEN text IS NULL THEN '$.text: not string' WHEN text = '' THEN '$.text: length' WHEN turn < 0 THEN '$.turn: out of range' END AS error,
  '{"arguments":{"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || turn || '},"id":"' || id || '","name":"' || name || '"}' AS json
FROM calls LEFT JOIN levels ON call = id UNION ALL
SELECT conv, turn, 0, 'result', id, CASE WHEN id IN (SELECT id FROM calls) THEN 'linked' ELSE 'orphan' END, coalesce(level, 0), NULL,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"id":"' || id || '"}' FROM results LEFT JOIN levels ON call = id"""


@query(CHAT_SQL)
def op9_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and results of all conversations, linked, ordered, validated and serialised: tool calls, and turns as calls."""
    messages = table(spark, folder, "conversations")
    calls, results = (a.union(b) for a, b in zip(chat.parse_messages(messages), chat.turns_as_calls(messages)))
    return chat.link_calls(calls, results, spark.createDataFrame(TURN_SCHEMAS, "name string, schema string"))


@query()
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those outside of the held-out fold."""
    docs = table(spark, folder, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.fit(docs.where(fold != 2))
    return langid.with_language(docs, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: CRC-32 of the distinct words by a table of 256 entries, built from the polynomial.
RESAMPLE_SQL = r"""
WITH RECURSIVE steps AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL
  SELECT i, CASE c & 1 WHEN 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
docs AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
goal AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
each AS (SELECT r, unnest(w) AS w FROM docs),
words AS (SELECT DISTINCT w FROM (SELECT w FROM each UNION ALL SELECT w FROM goal)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), 2 * i::BIGINT + 1, 2))::BIGINT)),
  lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM words, crc),
s AS (SELECT bucket, count(*) AS s FROM each JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM goal JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
  / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM each JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked"""


@query(RESAMPLE_SQL)
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weight, noisy score and draw of every document, towards the words of the benchmark."""
    return resample.importance_resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


INFILL_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM hashed),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts"""


@query(INFILL_SQL)
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of every document's fill-in-the-middle form, and of the text rebuilt from it."""
    made = infill.with_infill(table(spark, folder, "documents"))
    output, form = F.col("infill.output"), F.col("infill.form")
    return made.select(
        "doc_id", "infill.n", "infill.form", "infill.prefix_chars", "infill.middle_chars",
        F.sha2(output, 256).alias("output_sha256"), F.sha2(infill.restore(output, form), 256).alias("restored_sha256"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: Words of notices and phrases as tables; the rest is joins and groups.
LICENSE_SQL = rf"""
WITH notices(t, label, words) AS (SELECT i, label, string_split(words, ' ') FROM
    (VALUES {_values([(i, label, text) for i, (label, text, _) in enumerate(licenses.NOTICES)])}) v(i, label, words)),
keys(t, phrase) AS (VALUES {_values([(i, k) for i, (_, _, keys) in enumerate(licenses.NOTICES) for k in keys])}),
base(phrase, label) AS (VALUES {_values(list(licenses.BASE.items()))}),
vocabulary(w) AS (VALUES {_values([(w,) for w in licenses.license_words()])}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM documents),
each AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM docs),
phrases AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS parts FROM (SELECT phrase FROM keys UNION ALL SELECT phrase FROM base)),
places AS (SELECT e.r, e.p, phrase FROM each e JOIN phrases ON e.w = parts[1] JOIN docs d ON e.r = d.r WHERE d.words[p + 1:p + len(parts)] = parts),
based AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS labels FROM places JOIN base USING (phrase) GROUP BY r),
hits AS (SELECT r, w, p FROM each SEMI JOIN vocabulary USING (w)),
frequent AS (SELECT w, count(DISTINCT r) AS df FROM hits GROUP BY w),
idf AS (SELECT w, floor(1000 * ln(1 + (SELECT count(*) FROM docs) / (coalesce(df, 0) + 1)))::BIGINT AS idf FROM vocabulary LEFT JOIN frequent USING (w)),
postings AS (SELECT t, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM notices),
listed AS (SELECT t, w, i, idf FROM postings JOIN idf USING (w)),
heaviest AS (SELECT t, idf FROM (SELECT DISTINCT t, w, idf FROM listed)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC) <= {licenses.RARE_WORDS}),
facts AS (SELECT t, sum(idf) AS weight FROM heaviest GROUP BY t),
votes AS (SELECT r, t, w, idf, p - i AS o FROM hits JOIN listed USING (w)
  QUALIFY dense_rank() OVER (PARTITION BY r, t ORDER BY idf DESC, w) <= {licenses.RARE_WORDS}),
binned AS (SELECT DISTINCT r, t, w, idf, unnest([2 * floor(o / {2.0 * licenses.SLACK}), 2 * floor((o + {licenses.SLACK}) / {2.0 * licenses.SLACK}) + 1])::BIGINT AS bin FROM votes),
aligned AS (SELECT r, t, bin, sum(idf) AS idf FROM binned GROUP BY r, t, bin),
key_at AS (SELECT k.t, k.phrase, i FROM keys k JOIN phrases USING (phrase) JOIN notices n ON n.t = k.t,
  unnest(range(len(n.words))) u(i) WHERE n.words[i + 1:i + len(parts)] = parts),
key_bins AS (SELECT DISTINCT r, t, phrase, unnest([2 * floor((p - i) / {2.0 * licenses.SLACK}), 2 * floor((p - i + {licenses.SLACK}) / {2.0 * licenses.SLACK}) + 1])::BIGINT AS bin
  FROM places JOIN key_at USING (phrase)),
verified AS (SELECT r, t, bin FROM key_bins GROUP BY r, t, bin HAVING count(*) = (SELECT count(*) FROM keys WHERE keys.t = key_bins.t)),
matched AS (SELECT r, list(DISTINCT label) AS labels, max(idf::DOUBLE / weight::DOUBLE) AS share FROM aligned JOIN verified USING (r, t, bin) JOIN facts USING (t)
  JOIN notices USING (t) WHERE 100 * idf >= {licenses.MIN_SHARE} * weight GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM docs LEFT JOIN based b USING (r) LEFT JOIN matched m USING (r)"""


@query(LICENSE_SQL)
def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Places of license phrases and labels of license notices of every document."""
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    base = F.col("base")
    return found.select(
        F.col("key").alias("doc_id"), "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min("base.p").cast("bigint").alias("first_word"), F.array_max("base.p").cast("bigint").alias("last_word"),
        licenses.joined(F.col("base.label")).alias("base_labels"),
        licenses.joined(F.concat("base.label", "matches.label")).alias("labels"), "score")
