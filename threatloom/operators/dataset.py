"""Data-set building: labels, deduplication, class counts, hash-ranked splits, balancing.

Random order is replaced by the order of ``md5(seed | key)``: it is
reproducible, independent of partitioning, and lets a rank cut become a
comparison with a threshold key, so the (wide) rows themselves never shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom import rules
from threatloom.functions import text as tx
from threatloom.session import materialize

UNKNOWN = "unknown"


# ------------------------------------------------------------------ labels
def canonical_label(label: Column) -> Column:
    """Known label names to phishing / legitimate, anything else to unknown (shuffle-free)."""
    name = tx.strip(F.lower(label))
    positives = [k for k, v in rules.LABEL_MAP.items() if v == rules.POSITIVE]
    negatives = [k for k, v in rules.LABEL_MAP.items() if v == rules.NEGATIVE]
    return (
        F.when(name.isin(positives), rules.POSITIVE)
        .when(name.isin(negatives), rules.NEGATIVE)
        .otherwise(UNKNOWN)
    )


def binary_label(label: Column) -> Column:
    """1 / 0 for known labels, null otherwise."""
    known = canonical_label(label)
    return F.when(known == rules.POSITIVE, 1).when(known == rules.NEGATIVE, 0)


def known_labels(df: DataFrame, label: str) -> DataFrame:
    return df.withColumns({"label": canonical_label(F.col(label))}).filter(F.col("label") != UNKNOWN)


def nonblank(df: DataFrame, text: str) -> DataFrame:
    """Drop null and blank texts, strip the rest."""
    return df.withColumns({text: tx.strip(F.col(text))}).filter(F.length(text) > 0)


# ------------------------------------------------------------------ dedup
def ingest_order(priority: Column, seq: Column) -> Column:
    """One BIGINT that sorts by source priority, then row order (fast hash-aggregate buffer).

    7 bits of priority and 56 bits of row order: enough for
    ``monotonically_increasing_id`` over eight million partitions.  Values
    outside these bounds raise: they would sort anywhere.
    """
    p, s = priority.cast("long"), seq.cast("long")
    fits = p.between(0, 127) & s.between(0, (1 << 56) - 1)
    packed = F.shiftleft(p, 56) + s
    return F.when(fits | p.isNull() | s.isNull(), packed).otherwise(F.raise_error(F.lit("priority or row order out of range")))


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Keep, for every key, the row with the smallest ``order`` (unique; a BIGINT or a struct).

    The winners are found by a partial-aggregated minimum (a key holding a
    third of all rows shrinks to one row per map task) and the rows are then
    kept by a semi join on the *unique* order column, which cannot be skewed.
    """
    winners = df.select(key.alias("__key"), F.col(order).alias("__first")).groupBy("__key").agg(
        F.min("__first").alias("__first")
    )
    return df.join(winners.select("__first"), F.col(order) == F.col("__first"), "left_semi")


def aggregate_feeds(feeds: DataFrame, strict: bool = False) -> DataFrame:
    """text,label,source,content_type,order -> clean, first-wins, known-label records.

    A row with an unknown label still claims its text unless ``strict``.
    """
    rows = nonblank(feeds, "text")
    if strict:
        rows = known_labels(rows, "label")
    return known_labels(first_wins(rows, tx.norm_hash(F.col("text")), "order"), "label")


def duplicates_removed(feeds: DataFrame) -> DataFrame:
    """Non-blank rows minus distinct normalised texts (two-step count: no hot key)."""
    hashes = nonblank(feeds, "text").select(tx.norm_hash(F.col("text")).alias("h"))
    return hashes.groupBy("h").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_seen"),
        F.count("*").alias("distinct_texts"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_removed"),
    )


# ------------------------------------------------------------------ counts
def _is(label: str) -> Column:
    return F.when(F.col("label") == label, 1).otherwise(0)


def source_counts(records: DataFrame) -> DataFrame:
    """Overall row and one row per source; ``is_total`` marks the overall row."""
    return records.rollup("source").agg(
        F.grouping("source").cast("int").alias("is_total"),
        F.count("*").alias("total"),
        F.sum(_is(rules.POSITIVE)).alias("phishing"),
        F.sum(_is(rules.NEGATIVE)).alias("legitimate"),
    )


def ingest_summary(feeds: DataFrame, order: str = "order") -> DataFrame:
    """One row: total, phishing, legitimate, duplicates_removed of ``aggregate_feeds(feeds)``.

    One pass: per normalised text the number of rows and the label of the first one.
    """
    rows = nonblank(feeds, "text").select(
        tx.norm_hash(F.col("text")).alias("h"), F.col(order).alias("o"), canonical_label(F.col("label")).alias("label")
    )
    texts = rows.groupBy("h").agg(F.count("*").alias("n"), F.min_by("label", "o").alias("label"))
    return texts.agg(
        F.coalesce(F.sum(_is(rules.POSITIVE) + _is(rules.NEGATIVE)), F.lit(0)).alias("total"),
        F.coalesce(F.sum(_is(rules.POSITIVE)), F.lit(0)).alias("phishing"),
        F.coalesce(F.sum(_is(rules.NEGATIVE)), F.lit(0)).alias("legitimate"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates_removed"),
    )


def split_counts(splits: DataFrame) -> DataFrame:
    """Per split: total, class counts, percentages to one decimal (null for an empty split)."""
    counts = splits.groupBy("split").agg(
        F.count("*").alias("total"),
        F.sum(_is(rules.POSITIVE)).alias("phishing"),
        F.sum(_is(rules.NEGATIVE)).alias("legitimate"),
    )
    return counts.withColumns({
        f"{n}_pct": F.round(F.col(n) / F.nullif("total", F.lit(0)) * 100, 1) for n in ("phishing", "legitimate")
    })


def content_type_counts(splits: DataFrame) -> DataFrame:
    kind = F.coalesce("content_type", F.lit(UNKNOWN)).alias("content_type")
    return splits.groupBy("split", kind).agg(F.count("*").alias("n")).orderBy("split", "content_type")


# ------------------------------------------------------------------ hash ranks
BUCKET_ROWS = 50_000
BUCKET_HEX = 3  # 4,096 buckets: the rank tables below stay tiny at any row count


def hash_order(key: Column, seed: int = rules.SEED) -> Column:
    """Position of a row in the seeded pseudo-random order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def _bucket_starts(keys: DataFrame) -> DataFrame:
    """stratum, bucket -> rows in earlier buckets, rows here, rows in the stratum.

    Partial aggregation leaves at most 4,096 rows per stratum for the window.
    """
    counts = keys.groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("__s")
    ordered = w.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns({
        "__start": F.sum("__n").over(ordered) - F.col("__n"),
        "__total": F.sum("__n").over(w),
    })


def _keys(df: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    h = hash_order(F.col(key), seed)
    return df.select(
        _stratum(stratum).alias("__s"), h.alias("__h"), F.substring(h, 1, BUCKET_HEX).alias("__b")
    )


def _stratum(stratum: str) -> Column:
    """A never-null name of the stratum: rows without one are a stratum of their own."""
    return F.to_json(F.struct(F.col(stratum).alias("s")))


def rank_thresholds(df: DataFrame, stratum: str, key: str, cuts: dict[str, Column], seed: int = rules.SEED) -> DataFrame:
    """``__s`` -> one threshold hash per cut: the first ``cut`` rows in hash order lie below it.

    ``cuts`` maps a name to an expression over ``n`` (rows in the stratum).
    ``key`` must be unique within the stratum.  The input is read once, to write
    (stratum, hash); only the rows of the buckets that contain a cut are ever
    ranked: 1/4,096 of a stratum per cut.  A cut at or past the end has no
    threshold and admits every row.
    """
    keys = materialize(_keys(df, stratum, key, seed), "ranks")
    starts = _bucket_starts(keys)
    named = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), expr.cast("long").alias("at")) for name, expr in cuts.items()
    ]))
    edges = (
        starts.withColumns({"n": F.col("__total")}).withColumns({"__cut": named})
        .filter((F.col("__cut.at") >= F.col("__start")) & (F.col("__cut.at") < F.col("__start") + F.col("__n")))
        .select("__s", "__b", "__start", F.col("__cut.name").alias("__name"), F.col("__cut.at").alias("__at"))
    )
    buckets = edges.select("__s", "__b", "__start").distinct()
    in_order = Window.partitionBy("__s", "__b").orderBy("__h")
    ranked = keys.join(buckets, ["__s", "__b"]).withColumns({
        "__rank": F.col("__start") + F.row_number().over(in_order) - 1
    })
    found = ranked.join(edges.select("__s", "__name", "__at"), "__s").filter(F.col("__rank") == F.col("__at"))
    per_cut = [F.max(F.when(F.col("__name") == name, F.col("__h"))).alias(f"__{name}") for name in cuts]
    # every stratum keeps a row, also when none of its cuts has a threshold
    return starts.select("__s").distinct().join(found.groupBy("__s").agg(*per_cut), "__s", "left")


def below(hash_value: Column, threshold: Column) -> Column:
    return threshold.isNull() | (hash_value < threshold)


def ranked_split(df: DataFrame, stratum: str, key: str, cuts: dict[str, Column], last: str, seed: int = rules.SEED) -> DataFrame:
    """Assign each row to the first cut (in order) whose threshold exceeds its hash, else ``last``.

    The rows meet one row per stratum.  That table is written first, so its
    size is known and Catalyst broadcasts it while it is small: the wide rows
    then do not shuffle.  Rows with a NULL stratum are a stratum of their own.
    """
    limits = materialize(rank_thresholds(df, stratum, key, cuts, seed), "thresholds")
    h = hash_order(F.col(key), seed)
    split = None
    for name in cuts:
        hit = below(h, F.col(f"__{name}"))
        split = F.when(hit, name) if split is None else split.when(hit, name)
    return (
        df.withColumns({"__s": _stratum(stratum)}).join(limits, "__s")
        .withColumns({"split": split.otherwise(last)})
        .drop("__s", *[f"__{name}" for name in cuts])
    )


def copy_key(key: str) -> Column:
    """Unique key of a balanced row: the source row's key and the copy's number."""
    return F.concat_ws("#", F.col(key).cast("string"), F.col("copy").cast("string"))


def stratified_split(
    df: DataFrame, key: str, label: str = "label",
    train: float = rules.TRAIN_RATIO, validation: float = rules.VALIDATION_RATIO, seed: int = rules.SEED,
) -> DataFrame:
    """Per class: the first int(n*train) rows, then up to int(n*(train+validation)), then the rest."""
    n = F.col("n")
    cuts = {
        "train": (n * F.lit(train)).cast("long"),
        "val": (n * F.lit(train + validation)).cast("long"),
    }
    return ranked_split(df, label, key, cuts, "test", seed)


def holdout_split(df: DataFrame, key: str, label: str = "label", fraction: float = 0.2, name: str = "test",
                  rest: str = "train", seed: int = rules.SEED) -> DataFrame:
    """Per class ceil(n*fraction) rows go to ``name``, the others to ``rest``."""
    return ranked_split(df, label, key, {name: F.ceil(F.col("n") * F.lit(fraction))}, rest, seed)


# ------------------------------------------------------------------ balancing
def class_sizes(records: DataFrame) -> tuple[int, int]:
    """(phishing, legitimate) row counts: two numbers."""
    row = records.agg(F.sum(_is(rules.POSITIVE)), F.sum(_is(rules.NEGATIVE))).first()
    return int(row[0] or 0), int(row[1] or 0)


def sample_exact(df: DataFrame, key: str, size: int, seed: int = rules.SEED) -> DataFrame:
    """Exactly ``size`` rows (or all), the first in hash order."""
    one = df.withColumns({"__all": F.lit(1)})
    kept = ranked_split(one, "__all", key, {"in": F.lit(size)}, "out", seed)
    return kept.filter(F.col("split") == "in").drop("__all", "split").select(*df.columns)


def hash_ranks(df: DataFrame, key: str, seed: int = rules.SEED) -> DataFrame:
    """``key``, ``rank`` (0-based, gap-free) of every row in hash order; only keys and hashes shuffle.

    Two levels: a row number per hash bucket plus the start of the bucket.  The
    bucket width follows the row count, so no task sorts more than about
    ``BUCKET_ROWS`` rows.
    """
    h = hash_order(F.col(key), seed)
    keyed = materialize(df.select(F.col(key), F.lit(1).alias("__s"), h.alias("__h")), "ranks")
    digits = max(BUCKET_HEX, math.ceil(math.log(keyed.count() / BUCKET_ROWS + 1, 16)))
    keyed = keyed.withColumns({"__b": F.substring("__h", 1, digits)})
    starts = _bucket_starts(keyed.select("__s", "__b")).select("__b", "__start")
    local = F.row_number().over(Window.partitionBy("__b").orderBy("__h"))
    return keyed.join(starts, "__b").select(key, (F.col("__start") + local - 1).alias("rank"))


def draw_ranks(spark, extra: int, n: int, seed: int = rules.SEED) -> DataFrame:
    """``extra`` seeded draws with replacement from 0..n-1, counted per rank."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}#"), F.col("id").cast("string"))), 1, 15), 16, 10)
    return spark.range(1, extra + 1).select(
        (draw.cast("long") % F.lit(n)).alias("rank")
    ).groupBy("rank").agg(F.count("*").alias("__copies"))


def oversample_exact(df: DataFrame, key: str, size: int, n: int, seed: int = rules.SEED) -> DataFrame:
    """Every original once plus seeded draws with replacement up to ``size`` rows.

    ``copy`` is 0 for the original and 1.. for its draws.  ``key`` must be
    unique: the copy counts join back on it, so the rows shuffle once at most.
    """
    extra = size - n
    if extra <= 0:
        return df.withColumns({"copy": F.lit(0)})
    counts = hash_ranks(df, key, seed).join(draw_ranks(df.sparkSession, extra, n, seed), "rank").select(key, "__copies")
    drawn = df.join(counts, key, "left")
    copies = F.sequence(F.lit(0), F.coalesce("__copies", F.lit(0)).cast("int"))
    return drawn.withColumns({"copy": F.explode(copies)}).select(*df.columns, "copy")


def balance(records: DataFrame, key: str, ratio: float = 1.0, strategy: str = "undersample",
            seed: int = rules.SEED) -> DataFrame:
    """Balance phishing against legitimate rows to ``ratio``; adds ``copy`` (with it, keys repeat).

    Unknown strategies undersample; with an empty class nothing changes.
    Materialise ``records`` first when it is expensive: several passes read it.
    """
    n_bad, n_good = class_sizes(records)
    bad = records.filter(F.col("label") == rules.POSITIVE)
    good = records.filter(F.col("label") == rules.NEGATIVE)
    zero = {"copy": F.lit(0)}
    if n_bad == 0 or n_good == 0:
        return bad.unionByName(good).withColumns(zero)
    if strategy == "oversample":
        if n_bad < n_good * ratio:
            bad = oversample_exact(bad, key, int(n_good * ratio), n_bad, seed)
            good = good.withColumns(zero)
        else:
            good = oversample_exact(good, key, int(n_bad / ratio), n_good, seed)
            bad = bad.withColumns(zero)
        return bad.unionByName(good)
    if n_bad > n_good * ratio:
        bad = sample_exact(bad, key, min(int(n_good * ratio), n_bad), seed)
    else:
        good = sample_exact(good, key, min(int(n_bad / ratio), n_good), seed)
    return bad.unionByName(good).withColumns(zero)


# ------------------------------------------------------------------ unions and heads
def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
