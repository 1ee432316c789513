"""Threat scoring (categories, URL risk, statistics), attack payloads and file scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.operators import features as fe

_STRINGS = "array<string>"


def category_matches(low: Column | str) -> Column:
    """Array of (category, count, patterns) for the categories that match, in order."""
    entries = []
    for category, family in rules.THREAT_CATEGORIES.items():
        hits = F.array_compact(F.array(*[F.when(tx.rule_hit(low, r), F.lit(r.pattern)) for r in family]))
        entries.append(F.struct(F.lit(category).alias("category"), hits.alias("patterns")))
    found = F.filter(F.array(*entries), lambda e: F.size(e["patterns"]) > 0)
    return F.transform(
        found,
        lambda e: F.struct(
            e["category"].alias("category"),
            F.size(e["patterns"]).alias("count"),
            F.slice(e["patterns"], 1, rules.MAX_REPORTED_PATTERNS).alias("patterns"),
        ),
    )


def url_risk(urls: Column) -> Column:
    """Struct of has_urls, url_count, urls (first five), risk_score, suspicious_features."""
    def hit(u: Column, pattern: str) -> Column:
        return tx.fold(u).rlike("(?U)" + pattern)

    def risk(u: Column) -> list[Column]:
        return [F.when(hit(u, p), x).otherwise(0.0) for _, p, x in rules.THREAT_URL_RISKS]

    summed = F.aggregate(
        urls, F.lit(0.0), lambda acc, u: tx.total([acc, *risk(u)])
    )
    features = F.flatten(F.transform(
        urls,
        lambda u: F.array_compact(F.array(*[F.when(hit(u, p), n) for n, p, _ in rules.THREAT_URL_RISKS])),
    ))
    return F.struct(
        (F.size(urls) > 0).alias("has_urls"),
        F.size(urls).alias("url_count"),
        F.slice(urls, 1, rules.MAX_REPORTED_URLS).alias("urls"),
        F.least(summed, F.lit(1.0)).alias("risk_score"),
        features.alias("suspicious_features"),
    )


def _first_type(matches: Column, ml_positive: Column) -> Column:
    """The model decides first, then the first category that names a type."""
    typed = F.filter(matches, lambda m: m["category"].isin(*rules.CATEGORY_TYPES))
    first = F.try_element_at(typed, F.lit(1))["category"]
    out = F.when(ml_positive, "PHISHING")
    for category, name in rules.CATEGORY_TYPES.items():
        out = out.when(first == category, name)
    return out.otherwise("UNKNOWN")


def with_threat_result(
    df: DataFrame, text: str, ml_label: Column | None = None, ml_score: Column | None = None
) -> DataFrame:
    """Append the threat verdict of column ``text`` as one struct column ``threat``.

    A row with a null model score next to a label cannot be scored: it becomes
    an error row and the rest of the batch continues.
    """
    c = F.col
    label = F.lit(None).cast("string") if ml_label is None else ml_label
    score = F.lit(None).cast("double") if ml_score is None else ml_score.cast("double")
    w = rules.THREAT_WEIGHTS
    staged = (
        df.withColumns({"__t": tx.text_or_empty(c(text)), "__label": label, "__mls": score})
        .withColumns({
            "__skip": tx.short(c("__t")),
            "__low": tx.fold(c("__t")),
            "__urls": tx.extract_urls_loose(c("__t")),
            "__pos": F.coalesce(c("__label").isin(*rules.THREAT_POSITIVE_LABELS), F.lit(False)),
        })
        .withColumns({
            "__m": category_matches("__low"),
            "__u": url_risk(c("__urls")),
            "__s": fe.statistics(c("__t")),
        })
        .withColumns({"__sus": fe.suspicion(c("__s")), "__type": _first_type(c("__m"), c("__pos"))})
        .withColumns({
            "__score": F.least(F.lit(1.0), tx.total([
                F.when(c("__pos"), c("__mls") * w["ml"]).otherwise(0.0),
                F.size("__m") * rules.CATEGORY_WEIGHT * w["rule"],
                c("__u.risk_score") * w["url"],
                c("__sus") * w["features"],
            ])),
        })
        .withColumns({"__is": c("__score") >= rules.THREAT_THRESHOLD})
    )
    level, advice = None, F.when(~c("__is"), rules.THREAT_SAFE)
    for name, minimum in rules.CONFIDENCE_LEVELS:
        hit = c("__score") >= minimum
        level = F.when(hit, name) if level is None else level.when(hit, name)
    for minimum, before, after in rules.THREAT_RECOMMENDATIONS:
        advice = advice.when(
            c("__score") >= minimum, F.concat(F.lit(before), c("__type"), F.lit(after))
        )
    ml_note = F.when(
        c("__pos"),
        F.array(F.concat(F.lit("ML Phishing Score: "), F.format_string("%.2f", c("__mls")))),
    ).otherwise(F.array().cast(_STRINGS))
    notes = F.concat(
        ml_note,
        F.transform("__m", lambda m: F.concat(m["category"], F.lit(": "), m["count"].cast("string"), F.lit(" matches"))),
        c("__u.suspicious_features"),
    )
    failed = c("__pos") & c("__mls").isNull()
    ok = ~c("__skip") & ~failed
    verdict = F.struct(
        (ok & c("__is")).alias("is_threat"),
        F.when(c("__skip"), "NONE").when(failed, "ERROR").when(c("__is"), c("__type")).otherwise("NONE").alias("threat_type"),
        F.when(ok, c("__score")).otherwise(0.0).alias("confidence"),
        F.when(ok, level.otherwise("LOW")).alias("confidence_level"),
        F.when(ok, notes).otherwise(F.array().cast(_STRINGS)).alias("threat_indicators"),
        F.when(ok, F.map_from_entries(F.transform(
            "__m", lambda m: F.struct(m["category"], F.struct(m["count"].alias("count"), m["patterns"].alias("patterns")))
        ))).alias("matches"),
        F.when(ok, c("__u")).alias("url_analysis"),
        F.when(ok, c("__s").withField("suspicion_score", c("__sus"))).alias("features"),
        F.when(ok, advice).alias("recommendation"),
        F.when(c("__skip"), rules.TOO_SHORT_REASON).alias("reason"),
        F.when(failed, "model label without a score").alias("error"),
    )
    temporary = [n for n in staged.columns if n.startswith("__")]
    return staged.withColumns({"threat": verdict}).drop(*temporary)


def attack_types(payload: Column) -> Column:
    """Attack classes found in a payload, first pattern hit per class."""
    low = tx.fold(tx.text_or_empty(payload))
    return F.array_compact(F.array(*[
        F.when(tx.any_of(tx.rule_hit(low, r) for r in family), name)
        for name, family in rules.ATTACK_FAMILIES.items()
    ]))


def with_intrusion_result(df: DataFrame, payload: str) -> DataFrame:
    """Append attack_types, is_intrusion and confidence."""
    found = F.col("attack_types")
    return df.withColumns({"attack_types": attack_types(F.col(payload))}).withColumns({
        "is_intrusion": F.size(found) > 0,
        "confidence": F.when(F.size(found) > 0, rules.ATTACK_CONFIDENCE).otherwise(rules.CLEAN_CONFIDENCE),
    })


#: Bytes counted at once: the counting needs eight times as much for a moment.
COUNTED = 1 << 20


def byte_entropy(data: pa.Buffer) -> float:
    """Base-2 entropy of the byte values; the bytes are not copied."""
    if not len(data):
        return 0.0
    values = np.frombuffer(data, dtype=np.uint8)
    counts = np.zeros(256, dtype=np.int64)
    for at in range(0, len(values), COUNTED):
        counts += np.bincount(values[at:at + COUNTED], minlength=256)
    p = counts[counts > 0] / len(values)
    return float(-(p * np.log2(p)).sum())


def with_byte_entropy(df: DataFrame, content: str) -> DataFrame:
    """Append ``byte_entropy`` (base 2) of a BINARY column.

    Counting 256 values per file has no built-in form that avoids exploding
    every byte, so this is an Arrow function over numpy, on the bytes where Arrow has them.
    """
    @F.arrow_udf(T.DoubleType())
    def bits(data: pa.Array) -> pa.Array:
        return pa.array([byte_entropy(x.as_buffer()) if x.is_valid else 0.0 for x in data], pa.float64())

    return df.withColumns({"byte_entropy": bits(F.col(content))})


def with_file_scan(files: DataFrame, known_hashes: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Append file_hash, risk_score, is_malware and scan_result to a table of files, one row each.

    Files too large for a row are scanned by ``sources.fileblocks.scan_files``.
    """
    scored = with_byte_entropy(files, content).withColumns({"file_hash": F.sha2(F.col(content), 256)})
    return with_file_verdict(scored.drop(content), known_hashes, path)


def with_file_verdict(scored: DataFrame, known_hashes: DataFrame, path: str = "path") -> DataFrame:
    """Append risk_score, is_malware and scan_result to files with a file_hash and byte_entropy.

    ``known_hashes`` has one column ``sha256``; it is joined on the hash, so it
    may be of any size (Spark broadcasts it when it is small).  Repeated hashes
    on the file side (copies of one file) are harmless: the known side is
    distinct, so each file row meets at most one partner, and skewed hashes
    are split by adaptive execution.
    """
    known = known_hashes.select(F.col("sha256").alias("file_hash")).distinct().withColumns({"__known": F.lit(True)})
    extension = tx.any_of(F.col(path).endswith(x) for x in rules.SUSPICIOUS_EXTENSIONS)
    risk = F.least(F.lit(1.0), tx.total([
        F.when(extension, rules.EXTENSION_RISK).otherwise(0.0),
        F.when(F.col("byte_entropy") > rules.ENTROPY_LIMIT, rules.ENTROPY_RISK).otherwise(0.0),
    ]))
    bad = F.coalesce("__known", F.lit(False)) | (F.col("risk_score") > rules.MALICIOUS_ABOVE)
    return (
        scored.join(known, "file_hash", "left")
        .withColumns({"risk_score": risk})
        .withColumns({
            "is_malware": bad,
            "scan_result": F.when(bad, "MALICIOUS")
            .when(F.col("risk_score") > rules.SUSPICIOUS_ABOVE, "SUSPICIOUS")
            .otherwise("CLEAN"),
        })
        .drop("__known")
    )
