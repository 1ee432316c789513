"""Queries over the detectors: phishing, threats, payloads, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom import rules
from threatloom import rulesets as rt
from threatloom.functions import sql as fs
from threatloom.functions import text as tx
from threatloom.functions import url as ux
from threatloom.operators import phishing as ph
from threatloom.operators import threats as th
from threatloom.plans import fixtures as fx
from threatloom.plans import sqltext as sq
from threatloom.plans.fixtures import with_views
from threatloom.plans.registry import registry
from threatloom.rulesets import Family, RuleSet
from threatloom.session import scratch_path, spread, table
from threatloom.sources import fileblocks as fb

QUERIES, ORACLES, query = registry()


def _det(select: str, view: str = "inbox") -> str:
    return with_views(sq.prepared(view) + ",\n" + sq.detector() + " " + select, view)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return ph.with_phishing_result(fx.inbox(spark, folder), "text", suffixes=fx.DETECTOR_SUFFIXES)


def _analysed(spark: SparkSession, folder: str) -> DataFrame:
    m = fx.inbox(spark, folder).select("msg_id", tx.strip(F.col("text")).alias("t"))
    return m.withColumns({"low": tx.fold(F.col("t")), "urls": tx.extract_urls(F.col("t"))}).withColumns(
        {"ua": ux.analyse(F.col("urls"), fx.DETECTOR_SUFFIXES), "counts": ph.rule_counts(F.col("low"))}
    )


@query(_det("""SELECT msg_id, urg::BIGINT AS urgency, cred::BIGINT AS credential, fin::BIGINT AS financial, phr::BIGINT AS phrases,
  round(rule_score, 9) AS rule_score, array_to_string(found, '; ') AS found FROM rs"""))
def det_rule_score(spark: SparkSession, folder: str) -> DataFrame:
    a, c = _analysed(spark, folder), F.col("counts")
    return a.select(
        "msg_id", *[c[n].cast("long").alias(n) for n in ("urgency", "credential", "financial", "phrases")],
        F.round(ph.rule_score(c), 9).alias("rule_score"), F.array_join(ph.rule_indicators(c), "; ").alias("found"),
    )


@query(_det("SELECT msg_id, i::BIGINT AS i, url, raw >= 0.3::DOUBLE AS is_suspicious, round(least(raw, 1), 9) AS score, reasons FROM ua"))
def det_url_score(spark: SparkSession, folder: str) -> DataFrame:
    """One row per URL of every message."""
    u = _analysed(spark, folder).select("msg_id", F.posexplode("ua").alias("p", "u"))
    return u.select(
        "msg_id", (F.col("p") + 1).cast("long").alias("i"), "u.url", "u.is_suspicious",
        F.round("u.score", 9).alias("score"), F.array_join("u.reasons", "; ").alias("reasons"),
    )


@query(_det("SELECT msg_id, brand, coalesce(hit, false) AS hit FROM m LEFT JOIN b USING (msg_id)"))
def det_brand_impersonation(spark: SparkSession, folder: str) -> DataFrame:
    a = _analysed(spark, folder).withColumns({"brand": ph.top_brand(ph.brand_mentions(F.col("low"), F.col("urls")))})
    return a.select("msg_id", "brand", ph.impersonated(F.col("brand"), F.col("ua")).alias("hit"))


@query(_det("""SELECT brand, count(*) AS mentions, count(DISTINCT msg_id) AS messages FROM mentions GROUP BY brand
  ORDER BY mentions DESC, brand LIMIT 5"""))
def agg_top_brand(spark: SparkSession, folder: str) -> DataFrame:
    """Most mentioned brands over the whole table.

    Mentions are counted inside the row first, so the shuffle carries one row
    per brand and task.
    """
    m = _analysed(spark, folder).select("msg_id", ph.brand_mentions(F.col("low"), F.col("urls")).alias("m"))
    per = F.transform(F.array_distinct("m"), lambda b: F.struct(
        b.alias("brand"), F.size(F.filter("m", lambda x: x == b)).cast("long").alias("n")))
    return m.select(F.inline(per)).groupBy("brand").agg(
        F.sum("n").alias("mentions"), F.count("*").alias("messages")
    ).orderBy(F.desc("mentions"), "brand").limit(5)


@query(_det("""SELECT m.msg_id, len(m.urls) AS n_urls, coalesce(all_bad, false) AS all_suspicious, coalesce(any_bad, false) AS any_suspicious
  FROM m LEFT JOIN um USING (msg_id)"""))
def agg_url_any_all(spark: SparkSession, folder: str) -> DataFrame:
    return _analysed(spark, folder).select(
        "msg_id", F.size("ua").cast("long").alias("n_urls"),
        ((F.size("ua") > 0) & F.forall("ua", lambda u: u["is_suspicious"])).alias("all_suspicious"),
        F.exists("ua", lambda u: u["is_suspicious"]).alias("any_suspicious"),
    )


_ML_SQL = "(('0x' || substr(md5(msg_id::VARCHAR), 1, 8))::BIGINT % 100)::DOUBLE / 100"
_TR_SQL = "coalesce(CASE WHEN msg_id % 2 = 0 THEN (('0x' || substr(md5('t' || msg_id), 1, 8))::BIGINT % 100)::DOUBLE / 100 END, 0.5::DOUBLE)"


def _model_columns() -> tuple[Column, Column]:
    """A model probability per message, and a transformer one that is missing for every other message."""
    key = F.col("msg_id").cast("string")
    ml = fx.hash_int(key) % 100 / 100.0
    return ml, F.when(F.col("msg_id") % 2 == 0, fx.hash_int(F.concat(F.lit("t"), key)) % 100 / 100.0)


@query(with_views(sq.prepared("inbox") + ",\n" + sq.detector(ml=_ML_SQL, transformer=_TR_SQL)
                  + " SELECT msg_id, is_phishing, confidence, threat_level FROM (SELECT msg_id, NOT skip AND score >= 0.5 AS is_phishing,"
                  " CASE WHEN skip THEN 0 ELSE round(score, 4) END AS confidence, level AS threat_level FROM d)", "inbox"))
def det_ensemble_score(spark: SparkSession, folder: str) -> DataFrame:
    """Ensemble with model and transformer probabilities; a missing one counts as neutral."""
    ml, transformer = _model_columns()
    out = ph.with_phishing_result(fx.inbox(spark, folder), "text", ml=ml, transformer=transformer, suffixes=fx.DETECTOR_SUFFIXES)
    return out.select("msg_id", "is_phishing", "confidence", "threat_level")


@query(_det("SELECT msg_id, array_to_string(CASE WHEN skip THEN [] ELSE ind END, '; ') AS indicators, CASE WHEN skip THEN 0 ELSE len(ind) END AS n FROM d"))
def det_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select(
        "msg_id", F.array_join("indicators", "; ").alias("indicators"), F.size("indicators").cast("long").alias("n")
    )


@query(_det("SELECT msg_id, level AS threat_level FROM d"))
def det_threat_level(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("msg_id", "threat_level")


_RECOMMEND = "CASE WHEN skip THEN " + sq.lit(rules.EMPTY_RECOMMENDATION) + "".join(
    f" WHEN level = '{k}' THEN {sq.lit(v)}" for k, v in rules.RECOMMENDATIONS.items()
) + " END"
FULL_SQL = f"""SELECT msg_id, NOT skip AND score >= 0.5 AS is_phishing, CASE WHEN skip THEN 0 ELSE round(score, 4) END AS confidence,
  ptype AS phishing_type, level AS threat_level, CASE WHEN skip THEN '' ELSE array_to_string(ind, '; ') END AS indicators,
  CASE WHEN skip THEN 0 ELSE len(urls) END AS n_urls, CASE WHEN hit AND NOT skip THEN brand END AS brand, {_RECOMMEND} AS recommendation,
  CASE WHEN NOT skip THEN round(rule_score, 9) END AS rule_score, CASE WHEN NOT skip THEN scan END AS scan_type FROM d"""


def flat_verdict(scored: DataFrame, key: str) -> DataFrame:
    return scored.select(
        key, "is_phishing", "confidence", "phishing_type", "threat_level",
        F.array_join("indicators", "; ").alias("indicators"), F.size("urls_analyzed").cast("long").alias("n_urls"),
        F.col("brand_impersonation.brand").alias("brand"), "recommendation",
        F.round("details.rule_score", 9).alias("rule_score"), F.col("details.scan_type").alias("scan_type"),
    )


@query(_det(FULL_SQL))
def det_phishing_full(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: the full phishing verdict of every message."""
    return flat_verdict(_scored(spark, folder), "msg_id")


@query(_det("SELECT msg_id, round(rule_score, 9) AS rule_score FROM rs"))
def sql_rule_score(spark: SparkSession, folder: str) -> DataFrame:
    """The rule score as a function that SQL users call."""
    fs.register_rule_score(spark)
    fx.inbox(spark, folder).createOrReplaceTempView("threatloom_inbox")
    return spark.sql("SELECT msg_id, round(text_rule_score(text), 9) AS rule_score FROM threatloom_inbox")


#: Another rule set than the built-in one: changed and new families, no family of phrases alone, other lists.
CHANGED = RuleSet(
    (
        Family("urgency", (rules.Rule(r"\b(urgent|today|now)\b"), rules.Rule(r"\b(within \d+ hours?)\b")), (), 0.2, 0.5, "Pressure"),
        Family("lottery", (rules.Rule(r"\b(win(ner|ning)?|prize)\b"), rules.Rule(r"\$\d+")), (), 0.3, 0.45, "Lottery words"),
        Family("hints", (), ("lunch", "attached", "gift card"), 0.15, 0.3, "Hints"),
    ),
    ("google", "example", "spotify"), ("com", "tk"), ("a1b2", "bit.ly"), ("page", "docs", "verify"),
)


@query(with_views(sq.prepared("inbox") + ",\n" + sq.detector(rule_set=CHANGED) + " " + FULL_SQL, "inbox"))
def det_changed_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The full verdict by a rule set that is read from a table of two."""
    path = scratch_path(spark, "rules")
    rt.rule_table(spark, builtin=rt.DEFAULT, changed=CHANGED).write.parquet(path)
    loaded = rt.load_rule_set(spark.read.parquet(path), "changed")
    return flat_verdict(
        ph.with_phishing_result(fx.inbox(spark, folder), "text", suffixes=fx.DETECTOR_SUFFIXES, rule_set=loaded), "msg_id")


@query(with_views("inbox AS (SELECT url_id AS msg_id, url AS text FROM urls),\n" + sq.prepared("inbox") + ",\n" + sq.detector(ml=_ML_SQL)
                  .replace("'sms' ELSE 'email' END AS scan", "'url' ELSE 'url' END AS scan") + " " + FULL_SQL, "urls"))
def det_scan_url(spark: SparkSession, folder: str) -> DataFrame:
    """URL-only scan."""
    u = fx.urls(spark, folder).select(F.col("url_id").alias("msg_id"), F.col("url").alias("text"))
    return flat_verdict(ph.with_phishing_result(u, "text", scan_type="url", ml=_model_columns()[0], suffixes=fx.DETECTOR_SUFFIXES), "msg_id")


@query(_det("SELECT count(*) AS total, count(*) FILTER (NOT skip AND score >= 0.5) AS phishing_detected, count(*) FILTER (skip OR score < 0.5) AS safe FROM d"))
def agg_batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ph.batch_summary(_scored(spark, folder))


@query(_det("SELECT level AS threat_level, count(*) AS n FROM d GROUP BY level"))
def agg_threat_levels(spark: SparkSession, folder: str) -> DataFrame:
    return ph.level_histogram(_scored(spark, folder))


# ------------------------------------------------------------------ threats
def _threat_sql(select: str, view: str = "inbox") -> str:
    return with_views(sq.prepared(view) + ",\n" + sq.threat() + select, view)


_CATEGORY_ROWS = " UNION ALL ".join(
    f"SELECT msg_id, '{c}' AS category, len({c}) AS n, array_to_string({c}[1:3], ' || ') AS patterns FROM cat WHERE len({c}) > 0"
    for c in rules.THREAT_CATEGORIES
)


@query(_threat_sql(" " + _CATEGORY_ROWS))
def det_threat_categories(spark: SparkSession, folder: str) -> DataFrame:
    """One row per message and matching category; at most three patterns are reported."""
    m = fx.inbox(spark, folder).select("msg_id", tx.fold(F.col("text")).alias("low"))
    rows = m.select("msg_id", F.inline(th.category_matches(F.col("low"))))
    return rows.select("msg_id", "category", F.col("count").cast("long").alias("n"), F.array_join("patterns", " || ").alias("patterns"))


@query(_threat_sql(""" SELECT m.msg_id, coalesce(url_count, 0) AS url_count, coalesce(first_urls, '') AS first_urls,
  round(coalesce(risk_score, 0), 9) AS risk_score, coalesce(notes, '') AS features FROM m LEFT JOIN risk USING (msg_id)"""))
def det_url_risk(spark: SparkSession, folder: str) -> DataFrame:
    m = fx.inbox(spark, folder).select("msg_id", tx.extract_urls_loose(F.col("text")).alias("urls"))
    r = m.select("msg_id", th.url_risk(F.col("urls")).alias("r"))
    return r.select(
        "msg_id", F.col("r.url_count").cast("long").alias("url_count"), F.array_join("r.urls", "|").alias("first_urls"),
        F.round("r.risk_score", 9).alias("risk_score"), F.array_join("r.suspicious_features", "; ").alias("features"),
    )


@query(_threat_sql(""" SELECT 'url' AS kind, msg_id, url AS item FROM lu WHERE i <= 5
  UNION ALL SELECT 'pattern', msg_id, p FROM (SELECT msg_id, unnest(phishing_keywords[1:3]) AS p FROM cat)"""))
def top_array_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Per-row heads: the first five URLs and the first three patterns of a category."""
    m = fx.inbox(spark, folder).select("msg_id", tx.extract_urls_loose(F.col("text")).alias("urls"), tx.fold(F.col("text")).alias("low"))
    urls = m.select(F.lit("url").alias("kind"), "msg_id", F.explode(th.url_risk(F.col("urls"))["urls"]).alias("item"))
    cats = m.select("msg_id", F.inline(th.category_matches(F.col("low")))).filter(F.col("category") == "phishing_keywords")
    return urls.unionByName(cats.select(F.lit("pattern").alias("kind"), "msg_id", F.explode("patterns").alias("item")))


# Result sentences of the threat ensemble
_THREAT_FULL = f""",
ml AS (SELECT m.msg_id, m.text, CASE abs(m.msg_id) % 3 WHEN 0 THEN 'PHISHING' WHEN 1 THEN 'benign' END AS label,
  CASE WHEN abs(m.msg_id) % 30 <> 3 THEN (('0x' || substr(md5(m.msg_id::VARCHAR), 1, 8))::BIGINT % 100)::DOUBLE / 100 END AS mls FROM m),
x AS (SELECT ml.msg_id, length(trim(ml.text)) < 3 AS skip, coalesce(label = 'PHISHING', false) AS pos, mls, n_cat, cat_notes,
    coalesce(risk_score, 0) AS risk, coalesce(notes, '') AS notes, suspicion_score, first_type
  FROM ml JOIN cat USING (msg_id) JOIN sus USING (msg_id) LEFT JOIN risk USING (msg_id)),
y AS (SELECT *, pos AND mls IS NULL AS failed, CASE WHEN pos THEN 'PHISHING' ELSE first_type END AS type,
    least(1, CASE WHEN pos THEN mls * 0.4::DOUBLE ELSE 0 END + n_cat * 0.2::DOUBLE * 0.3::DOUBLE + risk * 0.2::DOUBLE + suspicion_score * 0.1::DOUBLE) AS score FROM x)
SELECT msg_id, NOT skip AND NOT failed AND score >= 0.5 AS is_threat,
  CASE WHEN skip THEN 'NONE' WHEN failed THEN 'ERROR' WHEN score >= 0.5 THEN type ELSE 'NONE' END AS threat_type,
  CASE WHEN skip OR failed THEN 0 ELSE round(score, 9) END AS confidence,
  CASE WHEN skip OR failed THEN NULL WHEN score >= 0.8 THEN 'VERY HIGH' WHEN score >= 0.6 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level,
  CASE WHEN skip OR failed THEN '' ELSE concat_ws('; ', CASE WHEN pos THEN printf('ML Phishing Score: %.2f', mls) END, nullif(cat_notes, ''), nullif(notes, '')) END AS indicators,
  CASE WHEN skip OR failed THEN NULL WHEN score < 0.5 THEN 'Message appears safe. No action needed.'
    WHEN score >= 0.8 THEN 'CRITICAL: High-confidence ' || type || ' detected. Block immediately and report.'
    WHEN score >= 0.6 THEN 'WARNING: Likely ' || type || '. Exercise caution and verify sender.'
    ELSE 'SUSPICIOUS: Possible ' || type || '. Review carefully before taking action.' END AS recommendation,
  CASE WHEN skip THEN 'Text too short to analyze' END AS reason, CASE WHEN failed AND NOT skip THEN 'model label without a score' END AS error FROM y"""


@query(_threat_sql(_THREAT_FULL))
def det_threat_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Threat verdict with a model label and score per message (some scores missing)."""
    n = F.abs("msg_id")
    m = fx.inbox(spark, folder).withColumns({
        "ml_label": F.when(n % 3 == 0, "PHISHING").when(n % 3 == 1, "benign"),
        "ml_score": F.when(n % 30 != 3, fx.hash_int(F.col("msg_id").cast("string")) % 100 / 100.0),
    })
    out = th.with_threat_result(m, "text", F.col("ml_label"), F.col("ml_score"))
    return out.select(
        "msg_id", "threat.is_threat", "threat.threat_type", F.round("threat.confidence", 9).alias("confidence"),
        "threat.confidence_level", F.array_join("threat.threat_indicators", "; ").alias("indicators"),
        "threat.recommendation", "threat.reason",
        F.when(F.col("threat.reason").isNull(), F.col("threat.error")).alias("error"),
    )


# ------------------------------------------------------------------ payloads and files
_PAYLOADS = f"""payloads AS (SELECT conv_id * 1000 + turn AS id, ({fx._q(fx.PAYLOADS)})[(conv_id * 1000 + turn) % 12 + 1] || ' ' || text AS p FROM conversations
  UNION ALL SELECT -page_id - 1, html FROM pages)"""
_ATTACKS = ", ".join(
    f"CASE WHEN {' OR '.join(sq.has('p', r.pattern) for r in fam)} THEN '{name}' END" for name, fam in rules.ATTACK_FAMILIES.items()
)


@query(f"WITH {_PAYLOADS}, f AS (SELECT id, concat_ws('|', {_ATTACKS}) AS attack_types FROM payloads)" + """
SELECT id, attack_types, attack_types <> '' AS is_intrusion, CASE WHEN attack_types <> '' THEN 0.9 ELSE 0.1 END::DOUBLE AS confidence FROM f""")
def det_intrusion(spark: SparkSession, folder: str) -> DataFrame:
    c = spread(table(spark, folder, "conversations"), "conv_id", "turn")
    key = F.col("conv_id") * 1000 + F.col("turn")
    talk = c.select(key.alias("id"), F.concat_ws(" ", fx.pick(fx.PAYLOADS, key % 12), "text").alias("payload"))
    html = spread(table(spark, folder, "pages").select((-F.col("page_id") - 1).alias("id"), F.col("html").alias("payload")), "id")
    out = th.with_intrusion_result(talk.unionByName(html), "payload")
    return out.select("id", F.array_join("attack_types", "|").alias("attack_types"), "is_intrusion", "confidence")


@query(f"""WITH files AS (SELECT doc_id, 'doc_' || doc_id || ({fx._q(fx.EXTENSIONS)})[doc_id % 5 + 1] AS path,
    CASE WHEN doc_id % 3 = 0 THEN {" || ".join(f"md5(text || '|{i}')" for i in range(32))} ELSE hex(encode(text)) END AS hx,
    CASE WHEN doc_id % 3 = 0 THEN sha256(unhex({" || ".join(f"md5(text || '|{i}')" for i in range(32))})) ELSE sha256(text) END AS file_hash FROM documents),
bytes AS (SELECT doc_id, length(hx) / 2 AS n, b, count(*) AS c FROM (SELECT doc_id, hx, unnest(regexp_extract_all(lower(hx), '..')) AS b FROM files) GROUP BY ALL),
ent AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS e FROM bytes GROUP BY doc_id),
known AS (SELECT sha256(text) AS h FROM benchmark UNION SELECT sha256(text) FROM documents WHERE source = 'src7'),
r AS (SELECT doc_id, path, file_hash, round(coalesce(e, 0), 9) AS byte_entropy, file_hash IN (SELECT h FROM known) AS is_malware,
    regexp_matches(path, '(\\.exe|\\.dll|\\.bat|\\.cmd|\\.scr)$')::INT * 0.3::DOUBLE + (coalesce(e, 0) > 7)::INT * 0.2::DOUBLE AS risk_score
  FROM files LEFT JOIN ent USING (doc_id))
SELECT *, CASE WHEN is_malware THEN 'MALICIOUS' WHEN risk_score > 0.4 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS scan_result FROM r""")
def det_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    out = th.with_file_scan(fx.files(spark, folder), fx.known_hashes(spark, folder))
    return out.select(
        "doc_id", "path", "file_hash", F.round("byte_entropy", 9).alias("byte_entropy"), "is_malware", "risk_score", "scan_result"
    )


@query("""WITH b AS (SELECT source, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))) || '0A', '..')) AS b FROM documents),
c AS (SELECT source, b, count(*) AS n FROM b GROUP BY source, b)
SELECT source, sum(n)::BIGINT AS bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS byte_entropy FROM c GROUP BY source""")
def agg_file_block_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Byte entropy of each source's files, written for the purpose: read by byte ranges, histograms merged per source."""
    path = scratch_path(spark, "source-files")
    table(spark, folder, "documents").select("source", "text").write.partitionBy("source").text(path)
    name = F.regexp_extract("path", "/source=([^/]*)/", 1)
    counts = fb.byte_counts(fb.file_blocks(fb.list_files(spark, path), 1 << 18))
    of_source = counts.select(F.when(name != "__HIVE_DEFAULT_PARTITION__", name).alias("source"), "byte", "n")
    return fb.entropy(of_source, "source").withColumns({"byte_entropy": F.round("byte_entropy", 9)})
